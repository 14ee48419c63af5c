"""Range-gated measurements per person-day, in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import any_of, flag, gated
from longfeat.functions.flags import is_set
from longfeat.functions.joins import fits, lookup_join
from longfeat.operators.indicators import DAY_KEY, concept_bits, within_cohort
from longfeat.plans.defaults import BODY_BOUNDS, OBESE_FROM


class Bound(NamedTuple):
    """A measure: its column, its concept ids and its accepted range (both ends included)."""

    name: str
    concept_ids: Sequence[int]
    lo: float
    hi: float


def measure_rows(
    measures: DataFrame,
    bounds: Sequence[Bound],
    roles: DataFrame | None = None,
    tests: Sequence[str] = (),
    results: Sequence[str] = (),
    body: Mapping[str, tuple[float, float]] = BODY_BOUNDS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Dated measurements as one row each: gated value columns, body columns, test x result flags.

    ``roles`` is (concept_id, role) over the body measures, tests and results; one size check covers both lookups.
    """
    rows = measures.where(F.col("day").isNotNull())
    value, concept = F.col("value"), F.col("concept_id")
    columns: list[Column] = [
        gated(value, any_of(concept, b.concept_ids), b.lo, b.hi).alias(b.name) for b in bounds
    ]
    if roles is not None:
        subjects = [*body, *tests]
        small = fits(roles) if small_fits is None else small_fits
        by_concept = concept_bits(roles, subjects, label="role", prefix="role_")
        rows = lookup_join(rows, by_concept, "concept_id", "left", DAY_KEY, small)
        columns += [
            gated(value, is_set(i, "role_"), *body[name]).alias(name) for i, name in enumerate(subjects[: len(body)])
        ]
        if tests and results:
            by_result = concept_bits(roles, results, label="role", prefix="result_").withColumnRenamed(
                "concept_id", "result_concept_id"
            )
            rows = lookup_join(rows, by_result, "result_concept_id", "left", DAY_KEY, small)
            columns += [
                flag(is_set(subjects.index(t), "role_") & is_set(r, "result_")).alias(f"{t}_{name}")
                for t in tests
                for r, name in enumerate(results)
            ]
    return rows.select(*DAY_KEY, *columns)


def body_index(days: DataFrame, body: Mapping[str, tuple[float, float]] = BODY_BOUNDS) -> DataFrame:
    """Replace the body columns by the rounded index (recorded, else weight / height**2) and its threshold flag.

    Both are null when no index inside the accepted range exists.
    """
    computed = F.try_divide(F.col("weight"), F.col("height") * F.col("height"))
    best = F.when(F.col("bmi") > 0, F.col("bmi")).otherwise(computed)
    lo, hi = body["bmi"]
    rounded = F.round(F.when(best.between(float(lo), float(hi)), best))
    return (
        days.withColumn("bmi_rounded", rounded)
        .withColumn("obese", F.when(F.col("bmi_rounded").isNotNull(), flag(F.col("bmi_rounded") >= OBESE_FROM)))
        .drop(*body)
    )


def measure_days(
    measures: DataFrame,
    cohort: DataFrame,
    bounds: Sequence[Bound],
    roles: DataFrame | None = None,
    tests: Sequence[str] = (),
    results: Sequence[str] = (),
    body: Mapping[str, tuple[float, float]] = BODY_BOUNDS,
    attributes: Mapping[str, Column] | None = None,
    small_fits: bool | None = None,
) -> DataFrame:
    """One row per cohort person and day with any measurement.

    A gated column is null on a day without any numeric value, 0 on a day whose values miss it, else the day's
    largest accepted value. ``attributes`` adds columns computed from person columns of the cohort (a sex flag, say).
    """
    rows = measure_rows(measures, bounds, roles, tests, results, body, small_fits)
    names = [c for c in rows.columns if c not in DAY_KEY]
    days = within_cohort(rows.groupBy(*DAY_KEY).agg(*[F.max(c).alias(c) for c in names]), cohort)
    if roles is not None:
        days = body_index(days, body)
    if attributes:
        people = cohort.groupBy("person_id").agg(*[F.max(c).alias(n) for n, c in attributes.items()])
        days = days.join(people, "person_id")
    return days
