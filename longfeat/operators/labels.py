"""Outcomes and exact person splits. outcome table: person_id, after, prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.operators.cohort import hash_position

SETUPS = ("prior", "after", "both")
SPLIT_BUCKETS = 4096


def outcome_column(setup: str = "both") -> Column:
    """The label of a setup: prior, after, the larger of both (nulls skipped), or any named column."""
    return F.greatest("after", "prior") if setup == "both" else F.col(setup)


def outcome(labels: DataFrame, setup: str = "both") -> DataFrame:
    return labels.select("person_id", outcome_column(setup).alias("outcome"))


def attach_outcome(df: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Left join of the outcome; a missing one is 0."""
    joined = df.join(outcomes.select("person_id", "outcome"), "person_id", "left")
    return joined.withColumn("outcome", F.coalesce(F.col("outcome"), F.lit(0)))


def split_exact(persons: DataFrame, fraction: float = 0.9, seed: int = 0) -> DataFrame:
    """(person_id, split): exactly floor(fraction x n) persons are 'train', the rest 'valid'.

    Persons are ordered by a seeded hash. The hash range is cut into equal buckets; running bucket counts (a table of
    fixed size) plus the rank inside a bucket give the exact global rank without sorting everything in one task.
    """
    placed = persons.select("person_id").distinct().withColumn("place", hash_position("person_id", seed))
    placed = placed.withColumn("bucket", F.shiftright("place", 20).cast("int"))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(  # at most SPLIT_BUCKETS rows
        "bucket",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.floor(F.lit(fraction) * F.sum("size").over(everything)).alias("cut"),
    )
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("place", "person_id"))
    ranked = placed.withColumn("inside", inside).join(F.broadcast(offsets), "bucket")
    train = F.col("offset") + F.col("inside") <= F.col("cut")
    return ranked.select("person_id", F.when(train, "train").otherwise("valid").alias("split"))


def restrict(df: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Rows of the persons in one part of the split."""
    return df.join(split.where(F.col("split") == name).select("person_id"), "person_id", "left_semi")
