"""Note mentions: consistency, concept matching, outcome rates, per-note sign columns.

note:    person_id, note_id, day, visit_id
mention: mention_id, note_id, certainty, concept_id, mention_name
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import column_name
from longfeat.functions.joins import lookup_join, spread_left_join
from longfeat.plans.defaults import MIN_MENTIONS, NEGATED, NO_CONCEPT, POSITIVE, RATE_FLOOR, TOPK_WIDTH

NOTE_COLUMNS = ["note_id", "person_id", "day", "visit_id"]


def note_mentions(notes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Notes left-joined with their mentions. A note may hold very many, so the mentions are spread."""
    return spread_left_join(notes.select(*NOTE_COLUMNS), mentions, ["note_id"], ["mention_id"])


def consistent_mentions(noted: DataFrame) -> DataFrame:
    """Distinct positive and negated mentions whose (note, concept) does not hold both; null concepts always stay.

    The contradictory pairs are one aggregate; the mentions stand on the left of the anti join, where Spark splits a
    hot pair.
    """
    signed = noted.where(F.col("certainty").isin(POSITIVE, NEGATED))
    pair = ["note_id", "concept_id"]
    both = (
        signed.groupBy(*pair)
        .agg(
            F.max(F.col("certainty") == POSITIVE).alias("has_positive"),
            F.max(F.col("certainty") == NEGATED).alias("has_negated"),
        )
        .where(F.col("has_positive") & F.col("has_negated"))
        .select(*pair)
    )
    return signed.join(both, pair, "left_anti").distinct()


def match_concepts(mentions: DataFrame, related: DataFrame, small_fits: bool | None = None) -> DataFrame:
    """Mentions of related concepts, with the set and concept names (one row per set of the concept)."""
    known = related.where(F.col("concept_id").isNotNull()).select("concept_id", "concept_name", "codeset_id", "set_name")
    return lookup_join(mentions, known, "concept_id", "inner", ["note_id", "mention_id"], small_fits)


def positive_only(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("certainty") == POSITIVE)


def concept_rates(mentions: DataFrame, outcome: DataFrame, top: int = TOPK_WIDTH) -> DataFrame:
    """(concept_name, pos, neg, max, count) of the ``top`` most mentioned concepts of persons with an outcome row.

    Mentions are counted per (person, concept) before they meet the outcomes, so a busy person is small by then.
    """
    named = mentions.where(F.col("concept_name") != NO_CONCEPT)
    counted = named.groupBy("person_id", "concept_name").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(outcome.select("person_id", "outcome"), "person_id")
    rates = joined.groupBy("concept_name").agg(
        F.sum("n").alias("count"), F.sum(F.when(F.col("outcome") == 1, F.col("n")).otherwise(0)).alias("hits")
    )
    pos = F.col("hits") / F.col("count")
    ranked = rates.orderBy(F.desc("count"), "concept_name").limit(top)
    return ranked.select(
        "concept_name", pos.alias("pos"), (1 - pos).alias("neg"), F.greatest(pos, 1 - pos).alias("max"), "count"
    )


def score_concepts(rates: DataFrame, floor: float = RATE_FLOOR) -> DataFrame:
    """Adds score: max x count above the floor, otherwise 0."""
    return rates.withColumn("score", F.when(F.col("max") > floor, F.col("max") * F.col("count")).otherwise(F.lit(0.0)))


def select_concepts(scored: DataFrame, mentions: DataFrame, min_count: int = MIN_MENTIONS) -> DataFrame:
    """(concept_name, count, score, concept_id) of scored concepts mentioned more than ``min_count`` times."""
    names = scored.where((F.col("score") > 0) & (F.col("count") > min_count)).select("concept_name", "count", "score")
    ids = mentions.select("concept_name", "concept_id").distinct()
    return ids.join(names, "concept_name").select("concept_name", "count", "score", "concept_id")


def mention_matrix(
    mentions: DataFrame,
    key_col: str,
    values: Sequence[str],
    prefix: str = "",
    carry: Sequence[str] = ("person_id", "day", "visit_id"),
    fanout: bool = False,
) -> DataFrame:
    """One row per note: +1 / -1 / null per value (a set name or concept name), from one aggregate.

    A value met with both signs in a note is null; with ``fanout`` the note gets a row for each sign instead.
    """
    sign = F.when(F.col("certainty") == POSITIVE, 1).when(F.col("certainty") == NEGATED, -1)
    names = [column_name(v, prefix) for v in values]
    lows = [F.min(F.when(F.col(key_col) == v, sign)).alias(f"_lo{i}") for i, v in enumerate(values)]
    highs = [F.max(F.when(F.col(key_col) == v, sign)).alias(f"_hi{i}") for i, v in enumerate(values)]
    keys = ["note_id", *carry]
    notes = mentions.groupBy(*keys).agg(*lows, *highs)
    if not fanout:
        agreed = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).alias(n) for i, n in enumerate(names)]
        return notes.select(*keys, *agreed)
    for i, n in enumerate(names):
        signs = F.array_distinct(F.array(f"_lo{i}", f"_hi{i}"))
        notes = notes.withColumn(n, F.explode(signs))
    return notes.select(*keys, *names)
