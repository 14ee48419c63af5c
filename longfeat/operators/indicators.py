"""Events to person-day 0/1 indicators.

Each concept carries its indicators as packed bits, so the event table meets the vocabulary in one join without
fan-out and collapses to (person, day) in one hash aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import flag
from longfeat.functions.flags import merge_words, or_words, slot_of, unpack, word_names
from longfeat.functions.joins import lookup_join

DAY_KEY = ["person_id", "day"]


def concept_bits(
    resolved: DataFrame, names: Sequence[str], by: Sequence[str] = ("concept_id",), label: str = "indicator", **kw
) -> DataFrame:
    """One row per concept: its labels as packed bits. Labels outside ``names`` are left out."""
    return (
        resolved.withColumn("slot", slot_of(F.col(label), names))
        .where(F.col("slot").isNotNull())
        .groupBy(*by)
        .agg(*or_words(F.col("slot"), len(names), **kw))
    )


def indicator_rows(
    events: DataFrame,
    resolved: DataFrame,
    indicators: Sequence[str],
    on: Sequence[str] = ("concept_id",),
    small_fits: bool | None = None,
) -> DataFrame:
    """Dated events that hit an indicator, still one row per event: (person_id, day, packed bits)."""
    dated = events.where(F.col("day").isNotNull()).select(*DAY_KEY, *on)
    hits = lookup_join(dated, concept_bits(resolved, indicators, on), on, spread_by=DAY_KEY, small_fits=small_fits)
    return hits.select(*DAY_KEY, *word_names(len(indicators)))


def within_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of cohort persons; never multiplies rows."""
    return df.join(cohort.select("person_id"), "person_id", "left_semi")


def indicator_days(
    events: DataFrame,
    cohort: DataFrame,
    resolved: DataFrame,
    indicators: Sequence[str],
    on: Sequence[str] = ("concept_id",),
    small_fits: bool | None = None,
) -> DataFrame:
    """One row per cohort person and day with a hit; one int column per indicator.

    The cohort restriction runs on collapsed days, so a busy person brings at most one row per calendar day to it.
    """
    rows = indicator_rows(events, resolved, indicators, on, small_fits)
    days = rows.groupBy(*DAY_KEY).agg(*merge_words(len(indicators)))
    return unpack(within_cohort(days, cohort), indicators)


def relative_to_index(
    df: DataFrame, index: DataFrame, day_col: str = "day", before: str = "before_index", since: str = "days_since"
) -> DataFrame:
    """Adds the before-index flag (0 without an index date) and the signed days since the index date."""
    gap = F.date_diff(F.col(day_col), F.col("index_date"))
    joined = df.join(index.select("person_id", "index_date"), "person_id", "left")
    return joined.select(*df.columns, flag(gap < 0).alias(before), gap.alias(since))


def index_dates(days: DataFrame, qualifier: str | None = None) -> DataFrame:
    """First day per person, of all rows or of the rows where the qualifier indicator is 1."""
    rows = days if qualifier is None else days.where(F.col(qualifier) == 1)
    return rows.groupBy("person_id").agg(F.min("day").alias("index_date"))
