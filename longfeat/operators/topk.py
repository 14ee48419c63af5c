"""Frequency-ranked concept matrices.

All domains are stacked into one tagged table, counted and ranked once. The chosen concepts (at most k per domain)
are broadcast; cells travel as packed bits, so even 5 x 1000 columns shuffle as a few longs per person.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.functions.columns import id_text
from longfeat.functions.flags import BITS, bit, unpack, word_names
from longfeat.operators.indicators import DAY_KEY
from longfeat.operators.learn import place_vectors
from longfeat.plans.defaults import LOOKBACK_DAYS, TOPK_PAGE, TOPK_WIDTH


def stack_domains(domains: Mapping[str, DataFrame], keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """(keys, domain, concept_id) of all domains; the mapping key is the column prefix of the domain."""
    tagged = [df.select(*keys, F.lit(name).alias("domain"), "concept_id") for name, df in domains.items()]
    return reduce(DataFrame.unionByName, tagged)


def rank_concepts(stacked: DataFrame, k: int = TOPK_WIDTH, page: int = 0) -> DataFrame:
    """(domain, concept_id, n, rank, feature): ranks (page*k, (page+1)*k] by row count, smaller id first on a tie.

    The window sorts the distinct concepts of a domain in one task: bounded by the vocabulary, not by the events.
    """
    counted = stacked.where(F.col("concept_id").isNotNull()).groupBy("domain", "concept_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("domain").orderBy(F.desc("n"), "concept_id")
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") > page * k) & (F.col("rank") <= (page + 1) * k))
        .withColumn("feature", F.concat("domain", id_text(F.col("concept_id"))))
    )


def cells_of(stacked: DataFrame, keys: Sequence[str], k: int = TOPK_WIDTH, page: int = 0) -> DataFrame:
    """Distinct (keys, feature) of the chosen concepts of a stacked table."""
    chosen = rank_concepts(stacked, k, page).select("domain", "concept_id", "feature")
    # At most k rows per domain.
    return stacked.join(F.broadcast(chosen), ["domain", "concept_id"]).select(*keys, "feature").distinct()


def topk_cells(domains: Mapping[str, DataFrame], k: int = TOPK_WIDTH, page: int = 0) -> DataFrame:
    """Sparse form of the person matrix: the distinct (person_id, feature) that are 1."""
    return cells_of(stack_domains(domains), ["person_id"], k, page)


def chosen_features(
    stacked: DataFrame, domains: Sequence[str], k: int = TOPK_WIDTH, page: int = 0
) -> list[tuple]:
    """(domain, concept_id, feature) in domain and rank order: at most k per domain, so they may name columns."""
    place = {name: i for i, name in enumerate(domains)}
    rows = rank_concepts(stacked, k, page).select("domain", "rank", "concept_id", "feature").collect()
    rows.sort(key=lambda r: (place[r.domain], r["rank"]))
    return [(r.domain, r.concept_id, r.feature) for r in rows]


def packed_matrix(stacked: DataFrame, chosen: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """One row per key with a chosen concept; the chosen concepts as packed bits (see ``unpack``)."""
    slots = [(d, c, i // BITS, i % BITS) for i, (d, c, _) in enumerate(chosen)]
    id_type = stacked.schema["concept_id"].dataType.simpleString()
    table = stacked.sparkSession.createDataFrame(
        slots, f"domain string, concept_id {id_type}, word int, offset int"
    )
    touched = (
        stacked.join(F.broadcast(table), ["domain", "concept_id"])  # one row per chosen concept
        .groupBy(*keys, "word")
        .agg(F.bit_or(bit(F.col("offset"))).alias("bits"))
    )
    words = [
        F.max(F.when(F.col("word") == w, F.col("bits"))).alias(name)
        for w, name in enumerate(word_names(len(chosen)))
    ]
    return touched.groupBy(*keys).agg(*words)


def topk_matrix(
    cohort: DataFrame, domains: Mapping[str, DataFrame], k: int = TOPK_WIDTH, sparse: bool = False
) -> DataFrame:
    """One row per cohort person: 0/1 columns, or with ``sparse`` one ML vector column ``features``.

    The sparse form keeps wide matrices out of generated code: concepts are ranked once and travel as numbers.
    """
    people = cohort.select("person_id").distinct()
    stacked = stack_domains(domains)
    chosen = chosen_features(stacked, list(domains), k)
    names = [feature for _, _, feature in chosen]
    if sparse:
        id_type = stacked.schema["concept_id"].dataType.simpleString()
        places = [(d, c, i) for i, (d, c, _) in enumerate(chosen)]
        table = stacked.sparkSession.createDataFrame(places, f"domain string, concept_id {id_type}, place int")
        placed = stacked.join(F.broadcast(table), ["domain", "concept_id"]).select("person_id", "place")  # k per domain
        return place_vectors(people, placed, len(names))
    packed = packed_matrix(stacked, chosen, ["person_id"])
    return unpack(people.join(packed, "person_id", "left"), names)


def recent_events(domains: Mapping[str, DataFrame], lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Stacked events on the days strictly after (last day of the person in any domain - lookback).

    The last day is one row per person; the events stand on the left of the join, where Spark splits a busy person.
    """
    stacked = stack_domains(domains, DAY_KEY)
    last = stack_days(domains).groupBy("person_id").agg(F.date_sub(F.max("day"), lookback).alias("cutoff_day"))
    return stacked.join(last, "person_id").where(F.col("day") > F.col("cutoff_day")).drop("cutoff_day")


def stack_days(domains: Mapping[str, DataFrame]) -> DataFrame:
    """Event days of all domains (bag union)."""
    return reduce(DataFrame.unionByName, [df.select(*DAY_KEY) for df in domains.values()])


def dated_persons(persons: DataFrame, days: DataFrame) -> DataFrame:
    """Persons with at least one row in ``days`` and no undated row there."""
    seen = days.groupBy("person_id").agg(F.max(F.col("day").isNull()).alias("undated"))
    return persons.select("person_id").distinct().join(
        seen.where(~F.col("undated")).select("person_id"), "person_id", "left_semi"
    )


def topk_day_matrix(
    domains: Mapping[str, DataFrame],
    outcome: DataFrame,
    k: int = TOPK_PAGE,
    page: int = 0,
    lookback: int = LOOKBACK_DAYS,
    sparse: bool = False,
    need_first: bool = False,
) -> DataFrame:
    """Person-day x concept page within the lookback, with the person's outcome.

    Persons of the outcome table without a usable dated row drop out; with ``need_first`` so do those without a chosen
    concept in the first domain (left-joining the domains in turn leaves them an undated row). ``sparse`` gives (person_id, day, feature,
    outcome) of the cells that are 1 instead of columns.
    """
    recent = recent_events(domains, lookback)
    labelled = outcome.select("person_id", "outcome").distinct()
    if need_first:
        first = recent.where(F.col("domain") == next(iter(domains)))
        held = cells_of(first, ["person_id"], k, page).select("person_id").distinct()
        labelled = labelled.join(held, "person_id", "left_semi")
    if sparse:
        return cells_of(recent, DAY_KEY, k, page).join(labelled, "person_id")
    chosen = chosen_features(recent, list(domains), k, page)
    packed = packed_matrix(recent, chosen, DAY_KEY)
    return unpack(packed.join(labelled, "person_id"), [feature for _, _, feature in chosen])
