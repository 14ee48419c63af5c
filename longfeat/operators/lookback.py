"""Recent rows before each person's last day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.functions.joins import spread_left_join
from longfeat.operators.indicators import DAY_KEY
from longfeat.plans.defaults import LOOKBACK_DAYS

WINDOW_COLUMNS = ["last_day", "cutoff_day", "first_day", "day_offset"]


def recent_rows(days: DataFrame, lookback: int = LOOKBACK_DAYS, ordered: bool = False) -> DataFrame:
    """Rows strictly after (last day - lookback), with the last day, cutoff, first kept day and offset from it.

    Takes person-day facts: one row per person and day, so a window group is bounded by the calendar. One exchange
    by person serves both windows. Undated rows are never recent. ``ordered`` sorts the result for export.
    """
    person = Window.partitionBy("person_id")
    last = days.where(F.col("day").isNotNull()).withColumn("last_day", F.max("day").over(person))
    kept = last.withColumn("cutoff_day", F.date_sub("last_day", lookback)).where(F.col("day") > F.col("cutoff_day"))
    kept = kept.withColumn("first_day", F.min("day").over(person))
    kept = kept.withColumn("day_offset", F.date_diff("day", "first_day"))
    features = [c for c in days.columns if c not in DAY_KEY]
    out = kept.select(*DAY_KEY, *WINDOW_COLUMNS, *features)
    return out.orderBy(*DAY_KEY) if ordered else out


def recent_counts(recent: DataFrame) -> DataFrame:
    """Distinct recent days per person."""
    return recent.groupBy("person_id").agg(F.count_distinct("day").alias("recent_days"))


def join_notes(recent: DataFrame, note_features: DataFrame) -> DataFrame:
    """Note features of the same person and day joined to the recent rows; ``has_note`` is 1.0 where one exists."""
    notes = note_features.drop("visit_id").withColumn("has_note", F.lit(1.0))
    return spread_left_join(recent, notes, DAY_KEY, ["note_id"]).drop("note_id")
