"""The same products in their direct shape: one join per part or per measure. For comparison and equivalence tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import any_of, gated
from longfeat.operators.dayfacts import fill_zero
from longfeat.operators.measures import Bound
from workload import queries as qs
from workload import views as vw
from workload.views import Views

KEY = ["person_id", "day"]


def outer_chain(encounters: DataFrame, parts: Sequence[DataFrame], keep_null=("bmi_rounded",)) -> DataFrame:
    """Natural full outer joins on all shared columns, then the maximum per person-day."""
    joined = encounters.select(*KEY)
    for part in parts:
        shared = [c for c in joined.columns if c in part.columns]
        joined = joined.join(part, shared, "outer")
    values = [c for c in joined.columns if c not in KEY]
    return fill_zero(joined.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in values]), keep_null)


def joined_measures(measures: DataFrame, bounds: Sequence[Bound]) -> DataFrame:
    """One aggregate per measure over the numeric rows, left-joined to the measured days."""
    dated = measures.where(F.col("day").isNotNull())
    numeric = dated.where(F.col("value").isNotNull())
    tables = [
        numeric.groupBy(*KEY).agg(
            F.max(gated(F.col("value"), any_of(F.col("concept_id"), b.concept_ids), b.lo, b.hi)).alias(b.name)
        )
        for b in bounds
    ]
    return reduce(lambda a, b: a.join(b, KEY, "left"), tables, dated.select(*KEY).distinct())


def measure_days(spark, root: str) -> DataFrame:
    v = Views(spark, root)
    return joined_measures(v.meas(), vw.BOUNDS).join(v.cohort(), "person_id", "left_semi")


def day_facts(spark, root: str) -> DataFrame:
    v = Views(spark, root)
    parts = [qs.days_of(v, d) for d in ("click", "view", "error", "purchase")]
    parts += [qs.measure_frame(v), qs.dose_day_frame(v)]
    days = outer_chain(v.enc(), parts)
    spans = v.episodes().where("start_day is not null and end_day is not null").distinct()
    inside = days.select(*KEY).join(spans, "person_id").where("day between start_day and end_day").select(*KEY)
    inside = inside.distinct().withColumn("in_episode", F.lit(1))
    return days.join(inside, KEY, "left").fillna(0, subset=["in_episode"])


NAIVE = {"day_facts": day_facts, "measure_days": measure_days}
