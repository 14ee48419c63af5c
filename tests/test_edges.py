"""Hand-written rows at the edges of every rule."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from longfeat.functions.columns import birth_date, column_name, id_text, plausible, truthy, whole_years
from longfeat.operators import cohort as co
from longfeat.operators import dayfacts, doses, indicators, labels, learn, lookback, measures, mentions, metrics
from longfeat.operators import sequences as seq
from longfeat.operators import summary, topk, vocabulary
from longfeat.operators.measures import Bound
from longfeat.sources import storage, tables


def test_flag_text_is_normalised(spark, rows, table):
    df = rows([("true",), (" T ",), ("1",), ("false",), ("maybe",), (None,)], "f string")
    assert [r[0] for r in df.select(truthy(F.col("f"))).collect()] == [True, True, True, False, False, False]


def test_birth_dates(spark, rows):
    data = [
        (None, 5, 5, None), (1980, None, 3, "1980-07-03"), (1980, 0, 3, "1980-07-03"), (1980, 13, 3, None),
        (1980, 2, 30, None), (1980, 4, None, "1980-04-01"), (1980, 4, 0, "1980-04-01"), (1901, 1, 1, None),
        (2999, 1, 1, None), (1902, 1, 1, "1902-01-01"),
    ]
    df = rows(data, "y int, m int, d int, want string")
    born = plausible(birth_date(F.col("y"), F.col("m"), F.col("d")), "1902-01-01", "2024-06-30")
    for r in df.select("want", born.cast("string").alias("got")).collect():
        assert r.got == r.want


def test_age_counts_completed_years(spark, rows):
    df = rows([("2000-06-30",), ("2000-07-01",), ("2024-06-30",), (None,)], "b date")
    ages = [r[0] for r in df.select(whole_years(F.col("b"), "2024-06-30")).collect()]
    assert ages == [24, 23, 0, None]


def test_encounters_dated_and_undated(rows, table):
    enc = rows(
        [(1, "2020-01-01"), (1, "2020-01-01"), (1, "2020-01-11"), (1, None), (1, None), (2, None)],
        "person_id bigint, day date",
    )
    person = rows([(1, 1980, 1, 1), (2, 1980, 1, 1), (3, None, None, None)],
                  "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int")
    got = table(co.build_cohort(person, enc, "2024-06-30"))
    assert got == [("1", "3", "10", "44"), ("2", "1", None, "44"), ("3", None, None, None)]


def test_scaling_constant_and_null(rows):
    df = rows([(1, 5), (2, 5), (3, None)], "person_id bigint, x int")
    assert [r.s for r in co.min_max_scale(df, "x", "s").collect()] == [0.0, 0.0, 0.0]


def test_custom_sets_are_numbered_after_the_largest(rows, table):
    members = rows([(7, 1, "a", "true", 1, "one", "false")],
                   "codeset_id bigint, concept_id bigint, set_name string, is_current string, version int, "
                   "concept_name string, archived string")
    got = vocabulary.append_sets(members, [(5, "five", "x"), (6, "six", "y"), (5, "five", "x")])
    assert table(got, "codeset_id", "set_name") == [("7", "a"), ("8", "x"), ("8", "x"), ("9", "y")]


def test_registry_merge_and_literal_nulls(rows, table):
    ddl = "set_name string, indicator string, domain string"
    a = rows([("s", "I", "condition"), ("n", "N", None)], ddl)
    b = rows([("s", "I", "condition"), ("n", "N", None), ("t", "I", "drug")], ddl)
    assert len(table(vocabulary.merge_registries(a, b))) == 3
    assert len(table(vocabulary.merge_registries(a, b, literal=True))) == 4


def test_resolution_versions_domains_and_fan_in(rows, table):
    members = rows(
        [(1, "s1", "true"), (2, "s1", "true"), (2, "s2", "true"), (3, "old", "false"), (4, "exempt", "false")],
        "concept_id bigint, set_name string, is_current string",
    )
    registry = rows(
        [("s1", "A", "condition,observation"), ("s2", "A", "procedure, observation"), ("old", "B", "condition"),
         ("exempt", "C", "condition"), ("nobody", "D", "drug")],
        "set_name string, indicator string, domain string",
    )
    assert table(vocabulary.resolve_concepts(registry, members, "observation")) == [("1", "A"), ("2", "A")]
    got = vocabulary.resolve_concepts(registry, members, "condition", ["exempt"])
    assert table(got) == [("1", "A"), ("2", "A"), ("4", "C")]
    assert table(vocabulary.resolve_concepts(registry, members, "drug")) == []
    assert table(vocabulary.unmatched_sets(registry, members)) == [("nobody", "members")]


def test_indicator_days(rows, table):
    events = rows(
        [(1, "2020-01-01", 10), (1, "2020-01-01", 11), (1, "2020-01-02", 99), (1, None, 10), (9, "2020-01-01", 10)],
        "person_id bigint, day date, concept_id bigint",
    )
    resolved = rows([(10, "A"), (11, "A"), (11, "B"), (10, "unlisted")], "concept_id bigint, indicator string")
    cohort = rows([(1,), (1,)], "person_id bigint")
    got = indicators.indicator_days(events, cohort, resolved, ["A", "B", "C"])
    assert table(got) == [("1", "2020-01-01", "1", "1", "0")]


def test_more_indicators_than_bits_in_a_word(rows):
    names = [f"i{n}" for n in range(130)]
    events = rows([(1, "2020-01-01", n) for n in (0, 61, 62, 123, 124, 129)], "person_id bigint, day date, concept_id bigint")
    resolved = rows([(n, f"i{n}") for n in range(130)], "concept_id bigint, indicator string")
    row = indicators.indicator_days(events, events, resolved, names).first().asDict()
    assert [n for n in range(130) if row[f"i{n}"]] == [0, 61, 62, 123, 124, 129]


def test_index_dates_and_relation(rows, table):
    days = rows([(1, "2020-01-05", 0), (1, "2020-01-07", 1), (2, "2020-01-01", 0)], "person_id bigint, day date, q int")
    assert table(indicators.index_dates(days)) == [("1", "2020-01-05"), ("2", "2020-01-01")]
    index = indicators.index_dates(days, "q")
    got = indicators.relative_to_index(days.drop("q"), index)
    assert table(got) == [
        ("1", "2020-01-05", "1", "-2"), ("1", "2020-01-07", "0", "0"), ("2", "2020-01-01", "0", None)
    ]


MEASURE_DDL = "person_id bigint, day date, concept_id bigint, value double, result_concept_id bigint"


def measured(rows, data, bounds=()):
    roles = rows(
        [(1, "bmi"), (2, "weight"), (3, "height"), (4, "t"), (5, "pos"), (6, "neg")], "concept_id bigint, role string"
    )
    days = rows(data, MEASURE_DDL)
    return measures.measure_days(days, days, bounds, roles, ["t"], ["pos", "neg"])


def test_measure_bounds_and_missing(rows, table):
    d = "2020-01-01"
    data = [
        (1, d, 7, 5.0, None), (1, d, 7, 5.5, None), (2, d, 7, 4.99, None), (3, d, 7, 10.0, None),
        (4, d, 7, 10.01, None), (5, d, 7, None, None), (6, d, 8, 6.0, None), (7, None, 7, 6.0, None),
    ]
    got = measures.measure_days(rows(data, MEASURE_DDL), rows(data, MEASURE_DDL), [Bound("x", (7,), 5, 10)])
    assert table(got, "person_id", "x") == [
        ("1", "5.5"), ("2", "0.0"), ("3", "10.0"), ("4", "0.0"), ("5", None), ("6", "0.0")
    ]


def test_body_index(rows, table):
    d = "2020-01-01"
    data = [
        (1, d, 1, 29.5, None),  # recorded, rounds half up
        (2, d, 2, 80.0, None), (2, d, 3, 2.0, None),  # computed
        (3, d, 2, 80.0, None),  # weight only
        (4, d, 1, 9.99, None), (5, d, 1, 10.0, None), (6, d, 1, 100.0, None),
        (7, d, 2, 80.0, None), (7, d, 3, 0.0, None),  # height outside its range
    ]
    got = measured(rows, data)
    assert table(got, "person_id", "bmi_rounded", "obese") == [
        ("1", "30.0", "1"), ("2", "20.0", "0"), ("3", None, None), ("4", None, None), ("5", "10.0", "0"),
        ("6", "100.0", "1"), ("7", None, None),
    ]


def test_result_flags(rows, table):
    d = "2020-01-01"
    data = [(1, d, 4, None, 5), (1, d, 4, None, 6), (2, d, 4, None, 9), (3, d, 9, None, 5), (4, d, 4, None, None)]
    got = measured(rows, data)
    assert table(got, "person_id", "t_pos", "t_neg") == [
        ("1", "1", "1"), ("2", "0", "0"), ("3", "0", "0"), ("4", "0", "0")
    ]


def test_dose_extraction(rows, table):
    ddl = "person_id bigint, day date, concept_id bigint, type_id bigint"
    events = rows(
        [(1, "2018-12-20", 10, 1), (1, "2018-12-21", 10, 1), (1, "2019-01-01", 10, 7), (1, "2019-01-02", 10, None),
         (1, None, 10, 1), (1, "2019-01-03", 11, 1), (1, "2019-01-04", 12, 1)], ddl)
    members = rows([(100, 10), (100, 10), (200, 11)], "codeset_id bigint, concept_id bigint")
    got = doses.dose_events(events, {10: "p"}, exclude_types=[7], members=members)
    assert table(got) == [("1", "2018-12-21", "p"), ("1", "2019-01-03", None)]
    got = doses.dose_events(events, {10: "p"}, exclude_types=[7], members=members, codeset_id=200)
    assert table(got) == [("1", "2019-01-03", None)]
    assert len(table(doses.dose_events(events, {10: "p"}, listed_only=True, max_date="2019-01-02"))) == 2


DOSE_DDL = "person_id bigint, day date, product string"


def test_same_day_and_gap_rules(rows, table):
    data = [
        (1, "2021-01-01", "a"), (1, "2021-01-01", "b"), (2, "2021-01-01", "a"), (2, "2021-01-01", None),
        (3, "2021-01-01", "a"), (3, "2021-01-05", "a"), (3, "2021-01-09", "a"), (4, "2021-01-01", "a"),
        (4, "2021-01-06", "a"),
    ]
    resolved = doses.resolve_same_day(rows(data, DOSE_DDL))
    assert ("1", "2021-01-01", None) in table(resolved) and ("2", "2021-01-01", "a") in table(resolved)
    kept = doses.drop_close(resolved)
    assert table(doses.dose_counts(kept)) == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "2")]


def test_dose_facts_and_days(rows, table):
    steps = [f"2021-0{m}-01" for m in range(1, 7)]
    data = [(n, day, "pfizer" if i % 2 else "moderna") for n in (3, 4, 5, 6) for i, day in enumerate(steps[:n])]
    wide = doses.dose_wide(rows(data, DOSE_DDL))
    facts = doses.dose_facts(wide)
    assert [r[0] for r in table(facts, "person_id")] == ["3", "4"]
    assert table(facts.where("person_id = 3"), "doses", "days_to_dose1", "gap_1_2", "gap_3_4", "switch_1_2", "switch_3_4") == [
        ("3", "366", "31", None, "1", "0")
    ]
    people = rows([(4,)], "person_id bigint")
    index = rows([(4, "2021-02-01")], "person_id bigint, index_date date")
    got = doses.dose_days(facts, people, index)
    assert table(got, "day", "dose1", "dose2", "dose1_moderna", "gap_1_2", "had_dose", "dose_before_index", "dose_days_since_index") == [
        ("2021-01-01", "1", None, "1", "31", "1", "1", "-31"),
        ("2021-02-01", None, "1", "1", "31", "1", "0", "0"),
        ("2021-03-01", None, None, "1", "31", "1", "0", "28"),
        ("2021-04-01", None, None, "1", "31", "1", "0", "59"),
    ]


def test_episode_ends_and_overlap(rows, table):
    days = rows([(1, f"2020-01-{d:02d}") for d in (1, 2, 5, 6, 9)] + [(1, None), (2, "2020-01-02")],
                "person_id bigint, day date")
    spans = rows(
        [(1, "2020-01-02", "2020-01-05"), (1, "2020-01-03", "2020-01-03"), (1, "2020-01-08", None), (1, None, "2020-01-09")],
        "person_id bigint, start_day date, end_day date")
    got = dayfacts.in_episode(days, spans)
    assert table(got) == [
        ("1", "2020-01-01", "0"), ("1", "2020-01-02", "1"), ("1", "2020-01-05", "1"), ("1", "2020-01-06", "0"),
        ("1", "2020-01-09", "0"), ("1", None, "0"), ("2", "2020-01-02", "0")
    ]


def test_day_facts_outsiders_and_fill(rows, table):
    enc = rows([(1, "2020-01-01"), (9, "2020-01-01"), (9, None)], "person_id bigint, day date")
    part = rows([(1, "2020-01-01", 3.0, None), (9, "2020-01-01", 4.0, 5.0), (9, "2020-02-01", 4.0, 5.0)],
                "person_id bigint, day date, x double, bmi_rounded double")
    got = dayfacts.day_facts(enc, [part], cohort=rows([(1,)], "person_id bigint"))
    assert table(got) == [("1", "2020-01-01", "3.0", None), ("9", "2020-01-01", "0.0", None), ("9", None, "0.0", None)]


def test_summary_zero_handling_and_last(rows, table):
    days = rows([(1, "2020-01-01", 0.0, 5.0, 1), (1, "2020-01-02", 20.0, 0.0, 1), (1, "2020-01-03", 10.0, 0.0, 0)],
                "person_id bigint, day date, r double, s double, had int")
    cohort = rows([(1,), (1,), (2,)], "person_id bigint")
    got = summary.person_summary(days, cohort, {}, {"r": "r"}, {"had": "total"})
    assert table(got) == [("1", "10.0", "5.0", "2"), ("2", None, None, None)]
    got = summary.person_summary(days, cohort, {}, {"r": "r"}, {"had": "total"}, zero_is_missing=True)
    assert table(got.where("person_id = 1"), "r") == [("15.0",)]
    assert table(summary.positive_stats(days, ["r"], ["s", "r"])) == [("1", "10.0", "5.0", "10.0")]


def test_topk_ties_nulls_and_absent_persons(rows, table):
    a = rows([(1, 5), (2, 5), (1, 7), (2, 9), (1, None), (2, None), (3, None)], "person_id bigint, concept_id bigint")
    cohort = rows([(1,), (2,), (3,)], "person_id bigint")
    got = topk.topk_matrix(cohort, {"con": a}, k=2)
    assert got.columns == ["person_id", "con5", "con7"]  # 7 before 9 on the tie
    assert table(got) == [("1", "1", "1"), ("2", "1", "0"), ("3", "0", "0")]
    sparse = topk.topk_matrix(cohort, {"con": a}, k=2, sparse=True).orderBy("person_id").collect()
    assert [list(r.features.toArray()) for r in sparse] == [[1, 1], [1, 0], [0, 0]]
    assert table(topk.topk_cells({"con": a}, 1, page=1)) == [("1", "con7")]


def test_day_matrix_pages_lookback_and_first_domain(rows, table):
    ddl = "person_id bigint, day date, concept_id bigint"
    a = rows([(1, "2020-01-10", 5), (1, "2020-01-01", 5), (1, None, 5), (3, "2020-01-10", 5)], ddl)
    b = rows([(1, "2020-01-11", 8), (2, "2020-01-03", 8), (2, "2020-01-03", 9)], ddl)
    outcome = rows([(1, 1), (2, 0), (4, 1)], "person_id bigint, outcome int")
    got = topk.topk_day_matrix({"pro": a, "con": b}, outcome, k=1, lookback=10)
    assert got.columns == ["person_id", "day", "outcome", "pro5", "con8"]
    assert table(got) == [
        ("1", "2020-01-10", "1", "1", "0"), ("1", "2020-01-11", "1", "0", "1"), ("2", "2020-01-03", "0", "0", "1")
    ]
    second = topk.topk_day_matrix({"pro": a, "con": b}, outcome, k=1, page=1, lookback=10, sparse=True)
    assert table(second, "person_id", "feature") == [("2", "con9")]
    need = topk.topk_day_matrix({"pro": a, "con": b}, outcome, k=1, lookback=10, need_first=True)
    assert table(need.select("person_id").distinct()) == [("1",)]


def test_attribute_flags(rows, table):
    data = [(1, "2020-01-01", 1, 1.0, None), (2, "2020-01-01", 1, 1.0, None), (3, "2020-01-01", 1, 1.0, None)]
    people = rows([(1, "F"), (1, "F"), (2, "M")], "person_id bigint, sex string")
    ms = rows(data, MEASURE_DDL)
    female = F.when(F.col("sex") == "F", 1).otherwise(0)
    got = measures.measure_days(ms, people, [Bound("x", (1,), 0, 2)], attributes={"female": female})
    assert table(got, "person_id", "x", "female") == [("1", "1.0", "1"), ("2", "1.0", "0")]


def test_id_text_drops_the_decimal_tail(rows):
    df = rows([(123.0, 5)], "a double, b bigint")
    assert tuple(df.select(id_text(F.col("a")), id_text(F.col("b"))).first()) == ("123", "5")


def test_dated_persons(rows, table):
    days = rows([(1, "2020-01-01"), (2, "2020-01-01"), (2, None)], "person_id bigint, day date")
    people = rows([(1,), (2,), (3,)], "person_id bigint")
    assert table(topk.dated_persons(people, days)) == [("1",)]


def test_lookback_cutoff(rows, table):
    days = rows([(1, "2020-01-01", 1), (1, "2020-01-02", 2), (1, "2020-06-29", 3), (1, None, 4)],
                "person_id bigint, day date, x int")  # 2020-06-29 minus 180 days is 2020-01-01
    got = lookback.recent_rows(days)
    assert table(got, "day", "cutoff_day", "day_offset", "x") == [
        ("2020-01-02", "2020-01-01", "0", "2"), ("2020-06-29", "2020-01-01", "179", "3")
    ]
    assert table(lookback.recent_counts(got)) == [("1", "2")]
    notes = rows([(5, 1, "2020-01-02", 9, 1)], "note_id bigint, person_id bigint, day date, visit_id bigint, s int")
    assert table(lookback.join_notes(got, notes), "day", "s", "has_note") == [
        ("2020-01-02", "1", "1.0"), ("2020-06-29", None, None)
    ]


def test_mentions(rows, table):
    notes = rows([(1, 1, "2020-01-01", 1), (2, 1, "2020-01-02", 1)], "note_id bigint, person_id bigint, day date, visit_id bigint")
    data = [
        (1, 1, "Positive", 10), (2, 1, "Negated", 10), (3, 1, "Positive", 11), (4, 1, "Negated", 12),
        (5, 1, "Unknown", 11), (6, 1, "Positive", None), (7, 1, "Negated", None),
    ]
    ms = rows(data, "mention_id bigint, note_id bigint, certainty string, concept_id bigint")
    noted = mentions.note_mentions(notes, ms)
    assert noted.count() == 8 and noted.where("note_id = 2").first().mention_id is None
    kept = mentions.consistent_mentions(noted)
    assert [r[0] for r in table(kept, "mention_id")] == ["3", "4", "6", "7"]
    related = rows([(11, "c-1", 1, "set-a"), (12, "c 2", 1, "set-a"), (12, "c 2", 2, "set-b")],
                   "concept_id bigint, concept_name string, codeset_id bigint, set_name string")
    matched = mentions.match_concepts(kept, related)
    got = mentions.mention_matrix(matched, "set_name", ["set-a", "set-b"], "sympt_")
    assert table(got, "note_id", "sympt_set_a", "sympt_set_b") == [("1", None, "-1")]
    fan = mentions.mention_matrix(matched, "set_name", ["set-a", "set-b"], "sympt_", fanout=True)
    assert table(fan, "sympt_set_a", "sympt_set_b") == [("-1", "-1"), ("1", "-1")]


def test_names():
    assert column_name("Pain, (acute) low-back") == "Pain_acute_low_back"


def test_labels(rows, table):
    lab = rows([(1, 1, None), (2, 0, 0), (3, None, None)], "person_id bigint, after int, prior int")
    people = rows([(1,), (2,), (3,), (4,)], "person_id bigint")
    got = labels.attach_outcome(people, labels.outcome(lab))
    assert table(got) == [("1", "1"), ("2", "0"), ("3", "0"), ("4", "0")]
    assert table(labels.outcome(lab, "prior"))[0] == ("1", None)


@pytest.mark.parametrize("n", [1, 9, 10, 137])
def test_split_is_exact(spark, n):
    split = labels.split_exact(spark.range(n).withColumnRenamed("id", "person_id"), 0.9)
    assert split.count() == n and split.where("split = 'train'").count() == int(0.9 * n)


def test_sequence_scaling_and_padding(rows):
    recent = rows([(1, 0, 4.0, None), (1, 10, 2.0, None), (2, 0, 0.0, None)],
                  "person_id bigint, day_offset int, x double, never double")
    assert seq.observed_features(recent, ["x", "never"]) == ["x"]
    stats = seq.feature_stats(recent, ["x", "never"])
    assert [(r.feature, r.lo, r.hi) for r in stats.orderBy("feature").collect()] == [("never", None, None), ("x", 0.0, 4.0)]
    scaled = seq.scale_masked(recent, stats, ["x", "never"])
    assert sorted(r.x for r in scaled.collect()) == [0.0, 0.5, 1.0]
    padded = {r.person_id: r for r in seq.pad_sequences(seq.sequences(recent, ["x"]), ["x"]).collect()}
    assert padded[1].t == [0.0, 1.0] and padded[2].v == [[0.0], [0.0]] and padded[2].m == [[1], [0]]
    assert len(seq.pad_sequences(seq.sequences(recent, ["x"]), ["x"], 5).first().v) == 5
    with pytest.raises(Exception, match="longer than the length 1"):
        seq.pad_sequences(seq.sequences(recent, ["x"]), ["x"], 1).collect()


def test_resampling_of_a_constant_series_is_constant(rows):
    recent = rows([(1, t, 3.0, None) for t in (0, 5, 9)], "person_id bigint, day_offset int, x double, y double")
    got = seq.resample_kernel(seq.sequences(recent, ["x", "y"]), ["x", "y"], points=16).collect()
    assert len(got) == 16 and all(abs(r.x - 3.0) < 1e-9 and r.y == 0.0 for r in got)


def test_ensemble_defaults_and_mean(rows, table):
    base = rows([(1,), (2,), (3,)], "person_id bigint")
    a = rows([(1, 0.9), (2, 0.2), (8, 1.0)], "person_id bigint, a double")
    b = rows([(1, 0.7)], "person_id bigint, b double")
    got = learn.ensemble(base, [a, b], {"b": 0.5}).orderBy("person_id").collect()
    assert [(round(r.probability, 6), r.outcome) for r in got] == [(0.8, 1), (0.35, 0), (0.5, 0)]


def test_alignment_is_idempotent(rows):
    df = rows([(1, 2, 3)], "person_id bigint, extra int, b int")
    once = learn.align_columns(df, ["b", "a"])
    assert once.columns == ["person_id", "a", "b"] and tuple(once.first()) == (1, 0.0, 3.0)
    assert learn.align_columns(once, ["b", "a"]).collect() == once.collect()


def test_metrics_by_hand(rows):
    df = rows([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.4)], "y int, p double")
    r = metrics.binary_metrics(df, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 2)
    assert r.auc == pytest.approx((1 * 3 + 0.5 + 1) / 6)
    report = {x["class"]: x for x in metrics.class_report(df, "y", "p").collect()}
    assert report[1].precision == 0.5 and report[0].support == 3


def test_conform_and_stats_files(spark, rows, tmp_path):
    got = tables.conform(rows([("5", "x", "2020-02-30")], "a string, b string, c string"), "a int, b double, c date")
    assert tuple(got.first()) == (5, None, None)
    path = str(tmp_path / "cols")
    storage.save_columns(spark, ["z", "a"], path)
    assert storage.load_columns(spark, path) == ["z", "a"]


def test_variance_has_one_row_per_column(rows):
    df = rows([(1, 1.0), (3, 1.0)], "a int, b double")
    assert {r.column_name: r.variance for r in summary.column_variance(df, ["a", "b"]).collect()} == {"a": 2.0, "b": 0.0}


def test_seeded_sample_keeps_the_fraction(spark):
    people = spark.range(2000).withColumnRenamed("id", "person_id")
    kept = co.hash_sample(people, 0.25).count()
    assert 400 < kept < 600 and kept == co.hash_sample(people.repartition(7), 0.25).count()
    assert co.sample_persons(people, 1.0).count() == 2000


def test_type_of_day_is_kept(rows):
    got = lookback.recent_rows(rows([(1, "2020-01-01")], "person_id bigint, day date"))
    assert got.first().day == date(2020, 1, 1)
