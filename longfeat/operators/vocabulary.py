"""Concept sets: custom rows, registry merge, domain routing, versions, resolution.

members:  codeset_id, concept_id, set_name, is_current, version, concept_name, archived
registry: set_name, indicator, domain (text naming one or more domains)
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longfeat.functions.columns import any_of, truthy
from longfeat.sources.tables import inline

REGISTRY_COLUMNS = ("set_name", "indicator", "domain")


def append_sets(members: DataFrame, custom: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Add custom (concept_id, concept_name, set_name) rows; new sets are numbered after the largest codeset_id.

    The largest id is a scalar subquery, so nothing is collected. Duplicate rows are kept.
    """
    number = {name: i for i, name in enumerate(dict.fromkeys(row[2] for row in custom), start=1)}
    rows = [(number[set_name], int(concept), set_name, name) for concept, name, set_name in custom]
    added = inline(
        members.sparkSession, rows, "number bigint, concept_id bigint, set_name string, concept_name string"
    )
    types = {f.name: f.dataType for f in members.schema.fields}
    largest = members.agg(F.coalesce(F.max("codeset_id"), F.lit(0)).alias("largest")).scalar()
    added = added.select(
        (largest + F.col("number")).cast(types["codeset_id"]).alias("codeset_id"),
        F.col("concept_id").cast(types["concept_id"]),
        "set_name",
        F.lit("true").cast(types["is_current"]).alias("is_current"),
        F.lit(1).cast(types["version"]).alias("version"),
        "concept_name",
        F.lit("false").cast(types["archived"]).alias("archived"),
    )
    return members.unionByName(added)


def append_registry(registry: DataFrame, custom: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add (set_name, indicator, domain) rows; several sets may share an indicator."""
    added = inline(registry.sparkSession, custom, "set_name string, indicator string, domain string")
    return registry.select(*REGISTRY_COLUMNS).unionByName(added)


def merge_registries(a: DataFrame, b: DataFrame, literal: bool = False) -> DataFrame:
    """All rows of both registries, each once.

    ``literal`` is a full outer join on every column instead: rows holding a null never match, duplicates stay.
    """
    a, b = a.select(*REGISTRY_COLUMNS), b.select(*REGISTRY_COLUMNS)
    if literal:
        return a.join(b, list(REGISTRY_COLUMNS), "outer")
    return a.unionByName(b).distinct()


def route(registry: DataFrame, domain: str) -> DataFrame:
    """Registry rows whose domain text names the domain."""
    return registry.where(F.col("domain").contains(domain))


def current(exempt: Iterable[str] = ()) -> Column:
    """Current-version rows, and all rows of the exempt sets."""
    return truthy(F.col("is_current")) | any_of(F.col("set_name"), exempt)


def resolve_concepts(
    registry: DataFrame, members: DataFrame, domain: str, exempt: Iterable[str] = ()
) -> DataFrame:
    """Distinct (concept_id, indicator) of one domain."""
    return resolve_domains(registry, members, {domain: exempt}).select("concept_id", "indicator")


def resolve_domains(
    registry: DataFrame, members: DataFrame, domains: Mapping[str, Iterable[str]] | Sequence[str]
) -> DataFrame:
    """Distinct (domain, concept_id, indicator) of several domains in one join; values are the exempt sets."""
    domains = domains if isinstance(domains, Mapping) else dict.fromkeys(domains, ())
    words = F.array(*[F.lit(d) for d in domains])
    named = F.explode(F.filter(words, lambda d: F.col("domain").contains(d)))
    routed = registry.select("set_name", "indicator", named.alias("route")).withColumnRenamed("route", "domain")
    active = members.select("set_name", "concept_id", truthy(F.col("is_current")).alias("active"))
    allowed = F.col("active")
    for d, exempt in domains.items():
        allowed = allowed | ((F.col("domain") == d) & any_of(F.col("set_name"), exempt))
    return (
        active.join(routed.distinct(), "set_name")
        .where(allowed)
        .select("domain", "concept_id", "indicator")
        .distinct()
    )


def concepts_in_roles(members: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Distinct (concept_id, role) of the current members of the named sets; ``roles`` maps role to set name."""
    named = inline(members.sparkSession, [(s, r) for r, s in roles.items()], "set_name string, role string")
    return (
        members.where(current())
        .select("set_name", "concept_id")
        .join(F.broadcast(named), "set_name")  # one row per configured role
        .select("concept_id", "role")
        .distinct()
    )


def expand_sets(members: DataFrame, broad: DataFrame) -> DataFrame:
    """Members of the broad sets; a broad set without members stays, with null concepts."""
    listed = members.select("codeset_id", "concept_id", "concept_name")
    return listed.join(broad.select("codeset_id", "set_name"), "codeset_id", "right")


def unmatched_sets(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Set names found on one side only: (set_name, missing_from)."""
    sides = registry.select("set_name", F.lit(1).alias("in_registry"), F.lit(0).alias("in_members")).unionByName(
        members.select("set_name", F.lit(0).alias("in_registry"), F.lit(1).alias("in_members"))
    )
    seen = sides.groupBy("set_name").agg(F.max("in_registry").alias("r"), F.max("in_members").alias("m"))
    return seen.where(F.col("r") != F.col("m")).select(
        "set_name", F.when(F.col("r") == 1, "members").otherwise("registry").alias("missing_from")
    )
