"""Person-level base table: demographics, encounter counts, observation span, scaling, categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import birth_date, flag, plausible, whole_years
from longfeat.sources.tables import inline

BIRTH_PARTS = ("year_of_birth", "month_of_birth", "day_of_birth")
EARLIEST_BIRTH = "1902-01-01"


def distinct_persons(person: DataFrame, carry: Sequence[str] = BIRTH_PARTS) -> DataFrame:
    return person.select("person_id", *carry).distinct()


def sample_persons(df: DataFrame, fraction: float = 1.0, seed: int = 111) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df if fraction >= 1.0 else df.sample(False, fraction, seed)


def hash_sample(df: DataFrame, fraction: float, seed: int = 111, key: str = "person_id") -> DataFrame:
    """Sample by a hash of the key: the same persons in every table, on every run and partitioning."""
    return df.where(hash_position(key, seed) < F.lit(int(fraction * 2**32)))


def hash_position(key: str, seed: int):
    """A key's fixed place in [0, 2**32), as bigint."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def demographics(person: DataFrame, as_of, earliest: str = EARLIEST_BIRTH) -> DataFrame:
    """Adds birth_date (imputed, null when implausible) and age in whole years on ``as_of``."""
    born = birth_date(*[F.col(c) for c in BIRTH_PARTS])
    return person.withColumn("birth_date", plausible(born, earliest, as_of)).withColumn(
        "age", whole_years(F.col("birth_date"), as_of)
    )


def encounter_days(encounters: DataFrame) -> DataFrame:
    """One row per (person, day); all undated encounters of a person make one row."""
    return encounters.select("person_id", "day").distinct()


def encounter_summary(encounters: DataFrame) -> DataFrame:
    """Per person: encounter days (undated ones count once) and days between first and last."""
    return (
        encounter_days(encounters)
        .groupBy("person_id")
        .agg(
            F.count(F.lit(1)).alias("encounters"),
            F.date_diff(F.max("day"), F.min("day")).alias("span"),
        )
    )


def build_cohort(
    person: DataFrame, encounters: DataFrame, as_of, sample: float | None = None, seed: int = 111
) -> DataFrame:
    """person_id, encounters, span, age; persons without encounters stay."""
    base = sample_persons(distinct_persons(person), 1.0 if sample is None else sample, seed)
    base = demographics(base, as_of).select("person_id", "age")
    return base.join(encounter_summary(encounters), "person_id", "left").select(
        "person_id", "encounters", "span", "age"
    )


def min_max_scale(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over the whole table; null, and 0 range, become 0. The limits are a scalar subquery."""
    limits = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("limits")).scalar()
    x = F.col(column).cast("double")
    lo, hi = limits["lo"].cast("double"), limits["hi"].cast("double")
    return df.withColumn(out, F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)))


def one_hot(df: DataFrame, column: str, names: Mapping[str, str], other: str | None = None) -> DataFrame:
    """A 0/1 column per category (category -> column); ``other`` flags everything else, null included."""
    hot = {out: flag(F.col(column) == value) for value, out in names.items()}
    if other:
        hot[other] = 1 - flag(F.col(column).isin(list(names)))
    return df.withColumns(hot)


def bucket(
    df: DataFrame, column: str, buckets: Mapping[str, Sequence[str]], out: str, default: str = "Unknown"
) -> DataFrame:
    """Map category labels to buckets (bucket -> labels) through a lookup table; the rest get the default."""
    pairs = [(label, name) for name, labels in buckets.items() for label in labels]
    table = inline(df.sparkSession, pairs, f"`{column}` string, `{out}` string").dropDuplicates([column])
    joined = df.join(F.broadcast(table), column, "left")  # one row per configured label
    return joined.select(*df.columns, F.coalesce(F.col(out), F.lit(default)).alias(out))
