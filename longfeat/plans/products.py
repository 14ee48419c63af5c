"""Feature products composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.functions.joins import BROADCAST_BYTES, fits
from longfeat.operators.dayfacts import day_facts, fill_zero
from longfeat.operators.doses import (
    dose_days,
    dose_events,
    dose_facts,
    dose_wide,
    drop_close,
    resolve_same_day,
    union_doses,
)
from longfeat.operators.indicators import DAY_KEY, index_dates, indicator_days, indicator_rows
from longfeat.operators.measures import Bound, body_index, measure_rows
from longfeat.operators.summary import person_summary
from longfeat.operators.topk import stack_domains, topk_matrix
from longfeat.operators.vocabulary import (
    append_registry,
    append_sets,
    concepts_in_roles,
    merge_registries,
    resolve_domains,
)
from longfeat.plans import defaults

INDICATOR_DOMAINS = ("condition", "observation", "procedure", "drug")
TOPK_DOMAINS = {"procedure": "pro", "condition": "con", "drug": "dru", "observation": "obs", "measurement": "mea"}
# Summary columns that are not plain maxima, and measures that get no indicator column.
KEEP_NULL = ("bmi_rounded",)
SUMMARY_MAXIMA = {"bmi_rounded": "bmi_max"}
SUMMARY_AVERAGES = {"respiratory_rate": "respiratory_rate"}
SUMMARY_SUMS = {"had_dose": "total_doses"}
SUMMARY_LEAVE_OUT = ("in_episode", "oxygen_saturation", "sodium", "hemoglobin", "creatinine", "urea_nitrogen")


def vocabulary(
    tables: Mapping[str, DataFrame], custom_sets: Sequence[tuple] = (), custom_registry: Sequence[tuple] = ()
) -> tuple[DataFrame, DataFrame]:
    """(members, registry) with the caller's custom rows."""
    members, registry = tables["members"], tables["registry"]
    if custom_sets:
        members = append_sets(members, custom_sets)
    if custom_registry:
        registry = append_registry(registry, custom_registry)
    return members, merge_registries(tables["required_registry"], registry)


def doses_of(
    tables: Mapping[str, DataFrame],
    members: DataFrame,
    codeset_id: int | None = defaults.DOSE_CODESET,
    small_fits: bool | None = None,
) -> DataFrame:
    """Resolved and gap-filtered doses from exposures and procedures; ``codeset_id=None`` admits every set."""
    exposures = dose_events(
        tables["drug"],
        defaults.EXPOSURE_PRODUCTS,
        exclude_types=defaults.EXCLUDED_EXPOSURE_TYPES,
        members=members,
        codeset_id=codeset_id,
        small_fits=small_fits,
    )
    procedures = dose_events(tables["procedure"], defaults.PROCEDURE_PRODUCTS, listed_only=True)
    return drop_close(resolve_same_day(union_doses(exposures, procedures)))


def person_days(
    encounters: DataFrame,
    domains: Mapping[str, DataFrame],
    resolved: DataFrame,
    indicators: Sequence[str],
    cohort: DataFrame | None = None,
    measures: DataFrame | None = None,
    bounds: Sequence[Bound] = (),
    roles: DataFrame | None = None,
    tests: Sequence[str] = (),
    results: Sequence[str] = (),
    doses: DataFrame | None = None,
    episodes: DataFrame | None = None,
    fill: bool = True,
    small_fits: bool | None = None,
) -> DataFrame:
    """Person-day facts from event-level rows: one vocabulary join, one aggregate over everything, one window.

    Indicators and measures are not collapsed before the merge, so the events are shuffled once.
    """
    stacked = stack_domains(domains, DAY_KEY)
    parts = [indicator_rows(stacked, resolved, indicators, ["domain", "concept_id"], small_fits)]
    if measures is not None:
        parts.append(measure_rows(measures, bounds, roles, tests, results, small_fits=small_fits))
    if doses is not None:
        parts.append(doses)
    days = day_facts(encounters, parts, indicators, fill=False, cohort=cohort, episodes=episodes)
    if roles is not None:
        days = body_index(days)
    if episodes is not None:
        days = days.select(*[c for c in days.columns if c != "in_episode"], "in_episode")
    return fill_zero(days, KEEP_NULL) if fill else days


def build_person_days(
    tables: Mapping[str, DataFrame],
    cohort: DataFrame,
    members: DataFrame,
    registry: DataFrame,
    indicators: Sequence[str],
    codeset_id: int | None = defaults.DOSE_CODESET,
    qualifier: str | None = None,
) -> DataFrame:
    """Person-day facts of a loaded table set (operator column names) with the default measures and dose rules."""
    # Every lookup below holds at most one row per (domain, member row), so one check covers them all.
    small = fits(members, BROADCAST_BYTES // len(INDICATOR_DOMAINS))
    exempt = {d: defaults.EXEMPT_SETS.get(d, ()) for d in INDICATOR_DOMAINS}
    resolved = resolve_domains(registry, members, exempt)
    for_conditions = resolved.where(F.col("domain") == "condition").drop("domain")
    conditions = indicator_days(tables["condition"], cohort, for_conditions, indicators, small_fits=small)
    index = index_dates(conditions, qualifier)
    facts = dose_facts(dose_wide(doses_of(tables, members, codeset_id, small)))
    return person_days(
        tables["encounter"],
        {d: tables[d] for d in INDICATOR_DOMAINS},
        resolved,
        indicators,
        cohort=cohort,
        measures=tables["measurement"],
        bounds=[Bound(*b) for b in defaults.MEASURE_BOUNDS],
        roles=concepts_in_roles(members, defaults.MEASURE_ROLES),
        tests=defaults.MEASURE_TESTS,
        results=defaults.MEASURE_RESULTS,
        doses=dose_days(facts, cohort, index),
        episodes=tables["encounter"],
        small_fits=small,
    )


def build_summary(days: DataFrame, cohort: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Static person summary with the default roles of the columns."""
    return person_summary(
        days, cohort, SUMMARY_MAXIMA, SUMMARY_AVERAGES, SUMMARY_SUMS, SUMMARY_LEAVE_OUT, zero_is_missing
    )


def topk_domains(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The five coded domains under their column prefixes."""
    return {prefix: tables[t] for t, prefix in TOPK_DOMAINS.items()}


def build_topk(tables: Mapping[str, DataFrame], cohort: DataFrame, k: int = defaults.TOPK_WIDTH, sparse: bool = False):
    """Person x concept matrix over the five coded domains."""
    return topk_matrix(cohort, topk_domains(tables), k, sparse)
