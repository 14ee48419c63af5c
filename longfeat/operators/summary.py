"""Person-level rollups of the person-day facts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import positive
from longfeat.operators.indicators import DAY_KEY


def person_summary(
    days: DataFrame,
    cohort: DataFrame,
    maxima: Mapping[str, str],
    averages: Mapping[str, str],
    sums: Mapping[str, str],
    leave_out: Iterable[str] = (),
    zero_is_missing: bool = False,
) -> DataFrame:
    """Cohort columns plus one rollup per person; persons without days stay.

    ``maxima``, ``averages`` and ``sums`` map a column to its output; every other column but ``leave_out`` becomes
    ``<column>_indicator``, its maximum. Averages run over all days; ``zero_is_missing`` skips filled zeros.
    """
    named = {*maxima, *averages, *sums, *leave_out, *DAY_KEY}
    averaged = (lambda c: F.nullif(F.col(c), F.lit(0))) if zero_is_missing else F.col
    rollup = days.groupBy("person_id").agg(
        *[F.max(c).alias(out) for c, out in maxima.items()],
        *[F.avg(averaged(c)).alias(out) for c, out in averages.items()],
        *[F.max(c).alias(f"{c}_indicator") for c in days.columns if c not in named],
        *[F.sum(c).alias(out) for c, out in sums.items()],
    )
    return cohort.distinct().join(rollup, "person_id", "left")


def positive_stats(days: DataFrame, lowest: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """Per person over values above 0: smallest (``min_<c>``) and last by day (``last_<c>``)."""
    columns: list[Column] = [F.min(positive(F.col(c))).alias(f"min_{c}") for c in lowest]
    for c in latest:
        columns.append(F.max_by(c, F.when(F.col(c) > 0, F.col("day"))).alias(f"last_{c}"))
    return days.groupBy("person_id").agg(*columns)


def column_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, variance): sample variance of each column, from one aggregate."""
    one = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "variance")
