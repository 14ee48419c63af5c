"""The person-day fact table and interval containment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from longfeat.functions.flags import unpack, word_names
from longfeat.operators.indicators import DAY_KEY


#: What a merged day was met by at most: the start of an episode, a part, an encounter.
START, PART, ENCOUNTER = 0, 1, 2
MARKS = ("_met", "_end", "_member")


def day_facts(
    encounters: DataFrame,
    parts: Sequence[DataFrame],
    indicators: Sequence[str] = (),
    keep_null: Iterable[str] = ("bmi_rounded",),
    fill: bool = True,
    cohort: DataFrame | None = None,
    episodes: DataFrame | None = None,
) -> DataFrame:
    """One row per (person, day) met in the encounters or in any part; every column is its largest value that day.

    Parts are person-day or still event-level rows; a column may come from several parts. Parts made by
    ``indicator_rows`` carry packed bits, which become the named ``indicators``. The parts are stacked and
    aggregated once, which gives the rows of a natural full outer join of all parts followed by a maximum.

    With a cohort, part rows of other persons are left out while encounters stay. The cohort is met after the
    aggregate, when a person has at most one row per calendar day. With ``episodes``, whose starts pass through the same
    aggregate, ``in_episode`` is added as the function of that name does. Both steps start from one exchange by person.
    """
    marked = cohort is not None or episodes is not None
    sources = [encounters.select(*DAY_KEY), *parts]
    if marked:
        sources = [s.withColumn("_met", F.lit(PART if i else ENCOUNTER)) for i, s in enumerate(sources)]
    if episodes is not None:
        sources.append(episode_starts(episodes).withColumn("_met", F.lit(START)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    packed = set(word_names(len(indicators)))
    plain = [c for c in rows.columns if c not in {*DAY_KEY, *MARKS, *packed}]
    merged = [(F.bit_or(c) if c in packed else F.max(c)).alias(c) for c in rows.columns if c not in DAY_KEY]
    days = rows.groupBy(*DAY_KEY).agg(*merged) if merged else rows.distinct()
    if marked:
        days = known_days(days, cohort)
    if indicators:
        clash = [c for c in plain if c in indicators]
        days = days.withColumnsRenamed({c: f"_part_{c}" for c in clash})
        days = unpack(days, indicators)
        days = days.withColumns({c: F.greatest(F.col(c), F.col(f"_part_{c}")) for c in clash})
        days = days.drop(*[f"_part_{c}" for c in clash])
    return fill_zero(days, keep_null) if fill else days


def known_days(days: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Days that more than an episode's start met; with a cohort those of its persons, plus the bare encounter days
    (every value null) of other persons. Ends of episodes (``_end``) become ``in_episode``.

    Other persons' days are not read a second time: the merged rows are marked, kept or emptied.
    """
    known = F.col("_met") > START
    if cohort is not None:
        people = cohort.select("person_id").distinct().withColumn("_member", F.lit(True))
        member = F.col("_member").isNotNull()
        values = [c for c in days.columns if c not in {*DAY_KEY, *MARKS}]
        days = days.join(people, "person_id", "left").withColumns({c: F.when(member, F.col(c)) for c in values})
        known = (member & known) | (F.col("_met") == ENCOUNTER)
    if "_end" in days.columns:
        days = covered_days(days.where(known | F.col("_end").isNotNull()))
    return days.where(known).drop(*MARKS)


def fill_zero(df: DataFrame, keep_null: Iterable[str] = ()) -> DataFrame:
    """Null becomes 0 in every numeric column but the keys and the named ones."""
    kept = {*DAY_KEY, *keep_null}
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in kept]
    return df.fillna(0, subset=numeric) if numeric else df


def episodes_of(encounters: DataFrame) -> DataFrame:
    """Episodes with both ends known."""
    both = F.col("start_day").isNotNull() & F.col("end_day").isNotNull()
    return encounters.where(both).select("person_id", "start_day", "end_day").distinct()


def episode_starts(episodes: DataFrame) -> DataFrame:
    """(person_id, day, _end) of the episodes, as rows that a maximum per person and day reduces."""
    return episodes_of(episodes).select("person_id", F.col("start_day").alias("day"), F.col("end_day").alias("_end"))


def covered_days(rows: DataFrame, out: str = "in_episode") -> DataFrame:
    """Adds 1 where the latest ``_end`` so far of the person reaches the day, else 0."""
    so_far = Window.partitionBy("person_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max("_end").over(so_far) >= F.col("day"), F.lit(False))
    return rows.withColumn(out, covered.cast("int"))


def in_episode(days: DataFrame, episodes: DataFrame, out: str = "in_episode") -> DataFrame:
    """Adds 1 where the day lies inside any episode of the person (ends included), else 0.

    A day is covered exactly when the latest end among the episodes starting on or before it is not earlier than the
    day: a running maximum over days and starts in date order. No day is paired with every episode. Episodes are
    first reduced to one end per (person, start), so a person brings at most two rows per calendar day.
    """
    starts = episode_starts(episodes).groupBy(*DAY_KEY).agg(F.max("_end").alias("_end")).withColumn("_is_start", F.lit(True))
    rows = days.withColumn("_is_start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    return covered_days(rows, out).where(~F.col("_is_start")).drop("_end", "_is_start")
