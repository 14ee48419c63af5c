"""Rewritten shapes give the rows of the direct shapes, on random data with a hot key; salted equals broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from longfeat.functions.joins import salted_join, spread_left_join
from longfeat.operators import dayfacts, doses, indicators, measures, mentions, vocabulary
from longfeat.operators.measures import Bound
from workload import naive

DAYS = [f"2020-01-{d:02d}" for d in range(1, 20)] + [None]


def person(r):
    """A third of all rows belong to person 1."""
    return 1 if r.random() < 0.34 else r.randint(2, 12)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = a.select(*columns), b.select(*columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stacked_merge_equals_outer_join_chain(rows, seed):
    r = random.Random(seed)
    enc = rows([(person(r), r.choice(DAYS)) for _ in range(60)], "person_id bigint, day date")
    part = lambda ddl: rows(
        [(person(r), r.choice(DAYS), r.randint(0, 1), r.choice([None, 1.5, 7.0])) for _ in range(50)], ddl
    )
    parts = [
        part("person_id bigint, day date, shared int, a double"),
        part("person_id bigint, day date, shared int, b double"),
        part("person_id bigint, day date, c int, b double"),
    ]
    same(dayfacts.day_facts(enc, parts, keep_null=["a"]), naive.outer_chain(enc, parts, keep_null=["a"]))


def test_packed_part_may_share_a_name_with_a_plain_part(rows):
    enc = rows([(1, "2020-01-01")], "person_id bigint, day date")
    events = rows([(1, "2020-01-01", 5), (2, "2020-01-01", 6)], "person_id bigint, day date, concept_id bigint")
    resolved = rows([(5, "A"), (6, "B")], "concept_id bigint, indicator string")
    plain = rows([(1, "2020-01-01", 1), (2, "2020-01-02", 1)], "person_id bigint, day date, B int")
    got = dayfacts.day_facts(enc, [indicators.indicator_rows(events, resolved, ["A", "B"]), plain], ["A", "B"])
    days = indicators.indicator_days(events, events, resolved, ["A", "B"])
    same(got, naive.outer_chain(enc, [days, plain]))


def test_one_aggregate_equals_joined_measures(rows):
    r = random.Random(3)
    data = [
        (person(r), r.choice(DAYS), r.randint(1, 6), r.choice([None, 0.0, 2.0, 5.0, 9.0]), None) for _ in range(400)
    ]
    ms = rows(data, "person_id bigint, day date, concept_id bigint, value double, result_concept_id bigint")
    bounds = [Bound("x", (1, 2), 1, 5), Bound("y", (3,), 0, 9), Bound("z", (6,), 5, 5)]
    same(measures.measure_days(ms, ms, bounds), naive.joined_measures(ms, bounds))


def test_running_maximum_equals_pairing_days_with_episodes(rows):
    r = random.Random(4)
    days = rows([(person(r), r.choice(DAYS)) for _ in range(150)], "person_id bigint, day date").distinct()
    spans = rows(
        [(person(r), r.choice(DAYS), r.choice(DAYS)) for _ in range(60)], "person_id bigint, start_day date, end_day date"
    )
    known = spans.where("start_day is not null and end_day is not null")
    pairs = days.join(known, "person_id").where("day between start_day and end_day").select("person_id", "day").distinct()
    want = days.join(pairs.withColumn("in_episode", F.lit(1)), ["person_id", "day"], "left").fillna(0, ["in_episode"])
    same(dayfacts.in_episode(days, spans), want)


def test_contradictions_equal_the_self_join(rows):
    r = random.Random(5)
    data = [
        (i, 1 if r.random() < 0.34 else r.randint(2, 30), r.choice(["Positive", "Negated", "Unknown"]),
         r.choice([None, 1, 2, 3, 4]), 1, None, None)
        for i in range(300)
    ]
    noted = rows(data, "mention_id bigint, note_id bigint, certainty string, concept_id bigint, person_id bigint, "
                       "day date, visit_id bigint")
    signed = noted.where("certainty in ('Positive', 'Negated')")
    a, b = noted.where("certainty = 'Positive'"), noted.where("certainty = 'Negated'")
    both = a.join(b, ["note_id", "concept_id"]).select("note_id", "concept_id").distinct()
    same(mentions.consistent_mentions(noted), signed.join(both, ["note_id", "concept_id"], "left_anti").distinct())


def test_salted_lookups_equal_broadcast_lookups(rows):
    r = random.Random(6)
    events = rows([(person(r), r.choice(DAYS), r.randint(1, 9)) for _ in range(300)],
                  "person_id bigint, day date, concept_id bigint")
    resolved = rows([(c, i) for c in range(1, 7) for i in ("A", "B", "C") if (c + len(i)) % 2],
                    "concept_id bigint, indicator string")
    run = lambda small: indicators.indicator_days(events, events, resolved, ["A", "B", "C"], small_fits=small)
    same(run(True), run(False))

    data = [(person(r), r.choice(DAYS), r.randint(1, 6), r.choice([None, 50.0, 2.0]), r.randint(5, 8)) for _ in range(300)]
    ms = rows(data, "person_id bigint, day date, concept_id bigint, value double, result_concept_id bigint")
    roles = rows([(1, "bmi"), (2, "weight"), (3, "height"), (4, "t"), (5, "pos"), (6, "neg")],
                 "concept_id bigint, role string")
    run = lambda small: measures.measure_days(ms, ms, [], roles, ["t"], ["pos", "neg"], small_fits=small)
    same(run(True), run(False))

    members = rows([(1, 1), (1, 2), (2, 2)], "codeset_id bigint, concept_id bigint")
    run = lambda small: doses.dose_events(events, {1: "a"}, "2020-01-03", members=members, small_fits=small)
    same(run(True), run(False))


def test_literal_registry_merge_differs_only_in_nulls_and_duplicates(rows):
    ddl = "set_name string, indicator string, domain string"
    a, b = rows([("x", "X", "drug"), ("y", "Y", "drug")], ddl), rows([("y", "Y", "drug")], ddl)
    same(vocabulary.merge_registries(a, b), vocabulary.merge_registries(a, b, literal=True))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [5, 30, 10_000])
def test_salted_join_equals_join(rows, how, rows_per_task):
    r = random.Random(7)
    big = rows([(person(r), i) for i in range(200)] + [(None, 1)], "k bigint, i bigint")
    small = rows([(k, k * 10) for k in range(1, 9)], "k bigint, v bigint")
    same(salted_join(big, small, ["k"], how, ["i"], rows_per_task), big.join(small, "k", how))


@pytest.mark.parametrize("rows_per_task", [5, 30, 10_000])
def test_spread_left_join_equals_left_join(rows, rows_per_task):
    r = random.Random(8)
    left = rows([(k,) for k in range(0, 15)] + [(1,), (None,)], "k bigint")
    big = rows([(person(r), i) for i in range(200)] + [(None, 1)], "k bigint, i bigint")
    same(spread_left_join(left, big, ["k"], ["i"], rows_per_task), left.join(big, "k", "left"))


def test_only_heavy_keys_are_copied(spark):
    """A third of the rows on one key: it is split by its own size, and the other rows are not repeated."""
    from longfeat.functions import joins

    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5_000)
    big = spark.range(30_000).withColumn("k", key)
    heavy = joins.heavy_keys(big, ["k"], 1_000)
    assert [(r.k, r._copies) for r in heavy.collect()] == [(-1, 10)]
    sizes = joins._spread(big, heavy, ["k"], ["id"]).where("k = -1").groupBy("_salt").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 1.3 * 1_000
    left = big.select("k").distinct()
    assert joins._repeat(left, heavy, ["k"]).count() <= 1.1 * left.count()
    assert joins.heavy_keys(big, ["k"], 100_000) is None
    assert joins.heavy_keys(big, ["k"], 3, most=5).count() == 1


def test_lookups_are_measured_in_bytes(spark):
    from longfeat.functions.joins import fits, size_bytes

    names = spark.range(100).select("id", F.repeat(F.lit("x"), 1_000).alias("name"))
    assert 100_000 < size_bytes(names) < 110_000 and fits(names, 110_000) and not fits(names, 100_000)
    assert size_bytes(names.limit(0)) == 0
