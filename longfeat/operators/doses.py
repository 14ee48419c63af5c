"""Repeated doses: extraction, same-day resolution, gap rule, ordinal pivot, dose facts and dose days.

Doses are collapsed to one row per (person, day) before any per-person window, so a window group holds at most one
row per calendar day. Everything after that collapse reuses one partitioning by person.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.functions.columns import as_date, flag
from longfeat.functions.joins import lookup_join
from longfeat.operators.indicators import DAY_KEY, relative_to_index, within_cohort
from longfeat.plans.defaults import (
    DOSE_EPOCH,
    DOSES_AFTER,
    FIRST_DOSE_PRODUCTS,
    FIRST_GAP_FROM,
    MAX_DOSES,
    MIN_GAP_DAYS,
)
from longfeat.sources.tables import inline


def dose_events(
    events: DataFrame,
    products: Mapping[int, str],
    after=DOSES_AFTER,
    exclude_types: Iterable[int] = (),
    members: DataFrame | None = None,
    codeset_id: int | None = None,
    max_date=None,
    listed_only: bool = False,
    small_fits: bool | None = None,
) -> DataFrame:
    """(person_id, day, product) of dated events strictly after ``after``; unlisted concepts have a null product.

    ``members`` keeps only concepts of any set, or of ``codeset_id``; ``listed_only`` only concepts in ``products``.
    A row with a null type is dropped when types are excluded. ``max_date`` is an exclusive upper bound.
    """
    rows = events.where(F.col("day") > as_date(after))
    if max_date is not None:
        rows = rows.where(F.col("day") < as_date(max_date))
    excluded = list(exclude_types)
    if excluded:
        rows = rows.where(~F.col("type_id").isin(excluded))
    rows = rows.select(*DAY_KEY, "concept_id")
    if members is not None:
        chosen = members if codeset_id is None else members.where(F.col("codeset_id") == codeset_id)
        concepts = chosen.select("concept_id").where(F.col("concept_id").isNotNull()).distinct()
        rows = lookup_join(rows, concepts, "concept_id", "left_semi", DAY_KEY, small_fits)
    table = inline(rows.sparkSession, products.items(), "concept_id bigint, product string")
    # One row per configured concept.
    joined = rows.join(F.broadcast(table), "concept_id", "inner" if listed_only else "left")
    return joined.select(*DAY_KEY, "product")


def union_doses(*doses: DataFrame) -> DataFrame:
    """Distinct doses of all inputs."""
    return reduce(DataFrame.unionByName, doses).distinct()


def resolve_same_day(doses: DataFrame) -> DataFrame:
    """One row per (person, day): the product when the day names exactly one, null when it names none or several."""
    same = F.min("product") == F.max("product")
    return doses.groupBy(*DAY_KEY).agg(F.when(same, F.max("product")).alias("product"))


def drop_close(doses: DataFrame, min_gap: int = MIN_GAP_DAYS, first_from=FIRST_GAP_FROM) -> DataFrame:
    """Keep a dose at least ``min_gap`` days after the previous *raw* dose (so 0, 4, 8 keeps only 0)."""
    previous = F.lag("day").over(Window.partitionBy("person_id").orderBy("day"))
    gap = F.date_diff(F.col("day"), F.coalesce(previous, as_date(first_from)))
    return doses.withColumn("gap", gap).where(F.col("gap") >= min_gap)


def dose_counts(doses: DataFrame) -> DataFrame:
    return doses.groupBy("person_id").agg(F.count("day").alias("doses"))


def dose_wide(doses: DataFrame, n: int = 4) -> DataFrame:
    """Per person the number of doses and the day and product of doses 1..n."""
    order = F.row_number().over(Window.partitionBy("person_id").orderBy("day", F.col("product").asc_nulls_last()))
    columns = []
    for i in range(1, n + 1):
        nth = F.col("nth") == i
        columns.append(F.max(F.when(nth, F.col("day"))).alias(f"dose{i}_date"))
        columns.append(F.max(F.when(nth, F.col("product"))).alias(f"dose{i}_product"))
    return (
        doses.withColumn("nth", order).groupBy("person_id").agg(F.count("day").alias("doses"), *columns)
    )


def dose_facts(wide: DataFrame, max_doses: int | None = MAX_DOSES, epoch=DOSE_EPOCH, n: int = 4) -> DataFrame:
    """Days from the epoch to dose 1, gaps and product-switch flags; persons above ``max_doses`` are left out."""
    kept = wide if max_doses is None else wide.where(F.col("doses") <= max_doses)
    day = [F.col(f"dose{i}_date") for i in range(1, n + 1)]
    product = [F.col(f"dose{i}_product") for i in range(1, n + 1)]
    steps = range(n - 1)
    return kept.select(
        "person_id",
        "doses",
        F.date_diff(day[0], as_date(epoch)).alias("days_to_dose1"),
        *[F.date_diff(day[i + 1], day[i]).alias(f"gap_{i + 1}_{i + 2}") for i in steps],
        *[
            flag((product[i] != product[i + 1]) & (day[i] != day[i + 1])).alias(f"switch_{i + 1}_{i + 2}")
            for i in steps
        ],
        *[c for pair in zip(day, product) for c in pair],
    )


def dose_days(
    facts: DataFrame,
    cohort: DataFrame,
    index: DataFrame | None = None,
    products: Sequence[str] = FIRST_DOSE_PRODUCTS,
    n: int = 4,
) -> DataFrame:
    """One row per (person, dose day): nth-dose flags (null when not that dose), first-dose product flags, first gap."""
    per_person = [flag(F.col("dose1_product") == p).alias(f"dose1_{p}") for p in products]
    doses = F.array(*[F.struct(F.col(f"dose{i}_date").alias("day"), F.lit(i).alias("nth")) for i in range(1, n + 1)])
    rows = (
        within_cohort(facts, cohort)
        .select("person_id", F.col("gap_1_2"), *per_person, F.explode(doses).alias("dose"))
        .where(F.col("dose.day").isNotNull())
    )
    nth = [F.max(F.when(F.col("dose.nth") == i, 1)).alias(f"dose{i}") for i in range(1, n + 1)]
    carried = [F.max(c).alias(c) for c in ["gap_1_2", *[f"dose1_{p}" for p in products]]]
    days = rows.groupBy("person_id", F.col("dose.day").alias("day")).agg(*nth, *carried)
    days = days.withColumn("had_dose", F.lit(1))
    if index is None:
        return days
    return relative_to_index(days, index, before="dose_before_index", since="dose_days_since_index")
