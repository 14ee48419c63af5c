"""Stored products, batches, resampling, areas, gradients, grids and refused values: plans and edge rows."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from longfeat.operators import learn, lookback, metrics, summary
from longfeat.operators import sequences as seq
from longfeat.sources import layout, storage, tables


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, rows):
    """Days of 300 persons, one of them with a third of all rows, stored with 8 buckets; and their cohort."""
    data = [(p, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", float(p % 7 + d)) for p in range(300) for d in range(3 if p else 300)]
    days = rows(data, "person_id bigint, day date, m double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = [layout.store_by_person(days, "days", 8), layout.store_by_person(days.select("person_id").distinct(), "cohort", 8)]
    yield (days, *map(spark.table, names))
    for name in names:
        layout.drop_stored(spark, name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_stored_products_are_read_without_an_exchange_by_person(stored, table):
    days, kept, cohort = stored
    plain_cohort = days.select("person_id").distinct()
    args = ({"m": "m_max"}, {}, {})
    for ours, theirs in (
        (summary.person_summary(kept, cohort, *args), summary.person_summary(days, plain_cohort, *args)),
        (lookback.recent_rows(kept), lookback.recent_rows(days)),
        (seq.sequences(lookback.recent_rows(kept), ["m"]), seq.sequences(lookback.recent_rows(days), ["m"])),
    ):
        assert "Exchange hashpartitioning(person_id" in final_plan(theirs)
        assert "Exchange hashpartitioning(person_id" not in final_plan(ours)
        assert table(ours.select([c for c in ours.columns])) == table(theirs.select(ours.columns))


def test_a_bucket_is_one_sorted_file(spark, stored):
    _, kept, _ = stored
    files = kept.inputFiles()
    assert len(files) == len({re.search(r"_(\d+)\.c", f.rsplit("/", 1)[-1]).group(1) for f in files}) == 8
    for f in files:
        seen = [(r.person_id, r.day) for r in spark.read.parquet(f).collect()]
        assert seen == sorted(seen)


def test_dropped_tables_leave_no_files(spark, rows):
    name = layout.store_by_person(rows([(1, "2024-01-01")], "person_id bigint, day date"), "gone", 2)
    where = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    layout.drop_stored(spark, name)
    assert not spark.catalog.tableExists(name) and not storage.remove(spark, where)
    assert layout.bucket_count(spark, 10 * layout.BUCKET_BYTES, 4) == 12 and layout.bucket_count(spark, 0, 4) == 4


def made(spark, lengths):
    """Sequences of these lengths: person i has steps 0, 2, 4, ..."""
    data = [(i, [(2 * t, t / 10, [float(i + t)], [int((i + t) % 3 > 0)]) for t in range(n)]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(data, "person_id bigint, steps array<struct<t: int, time: double, v: array<double>, m: array<int>>>")


def test_batches_of_a_skewed_table(spark):
    lengths = [1] * 500 + [2] * 300 + [90] * 5 + [3] * 200 + [0] * 3
    batched = seq.batch_sequences(made(spark, lengths), 32).collect()
    assert len(batched) == len(lengths)
    by = {}
    for r in batched:
        by.setdefault(r.batch, []).append((len(r.steps), r.batch_length))
    assert sorted(by) == list(range(-(-len(lengths) // 32)))
    assert all(len(by[b]) == 32 for b in sorted(by)[:-1])
    assert all({length for _, length in b} == {max(n for n, _ in b)} for b in by.values())
    order = [n for b in sorted(by) for n in sorted(n for n, _ in by[b])]
    assert order == sorted(lengths)
    cells = sum(length for b in by.values() for _, length in b)
    assert cells < len(lengths) * max(lengths) / 10


def test_padding_of_a_batch(spark):
    padded = {r.person_id: r for r in seq.pad_batches(seq.batch_sequences(made(spark, [3, 0, 1, 2]), 2), ["x"]).collect()}
    assert {i: r.batch_length for i, r in padded.items()} == {1: 1, 2: 1, 3: 3, 0: 3}
    assert padded[1].v == [[0.0]] and padded[1].m == [[0]] and padded[1].t == [0.0]
    assert padded[3].v == [[3.0], [4.0], [0.0]] and padded[3].t == [0.0, 0.5, 0.0] and padded[0].t == [0.0, 0.5, 1.0]
    assert seq.pad_batches(seq.batch_sequences(made(spark, []), 2), ["x"]).collect() == []


def test_resampling_of_long_and_empty_sequences(spark, monkeypatch):
    """Slices that end inside a person give what one product over the whole sequence gives."""
    monkeypatch.setattr(seq, "STEPS", 7)
    monkeypatch.setattr(seq, "PERSONS", 2)
    lengths = [1000, 0, 3, 1, 20]
    got = seq.resample_kernel(made(spark, lengths).coalesce(1), ["x"], points=16, dim=8).collect()
    assert len(got) == 16 * 4
    freq = 48.0 * np.exp(-2 * np.arange(4) * np.log(10.0) / 8)
    for r in got:
        n, i = lengths[r.person_id], r.person_id
        t, v, m = np.arange(n) / 10, i + np.arange(n), ((i + np.arange(n)) % 3 > 0).astype(float)
        w = np.exp(np.cos(np.subtract.outer(r.point / 15, t)[:, None] * freq).sum(1) / np.sqrt(8)) * m
        assert r.x == pytest.approx((w * v).sum() / w.sum() if w.sum() else 0.0, rel=1e-9)


def test_area_of_odd_groups(spark):
    inf, nan = float("inf"), float("nan")
    data = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), (None, 1, inf), (None, 0, -inf), (None, 1, nan)]
    data += [(None, 0, 1e300), (None, None, 0.1), (None, 1, None), ("c", 0, 0.2)]
    df = spark.createDataFrame(data, "g string, y int, s double")
    assert {r.g: r.auc for r in metrics.area_under_roc(df, "y", "s", ["g"]).collect()} == {"a": 0.875, "b": None, "c": None, None: 1.0}
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 3000), np.round(rng.normal(size=3000), 2)
    got = metrics.area_under_roc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double"), "y", "s").first().auc
    p, n = s[y == 1], s[y == 0]
    assert got == pytest.approx((np.greater.outer(p, n) + 0.5 * np.equal.outer(p, n)).mean())
    assert metrics.area_under_roc(df.limit(0), "y", "s").first().auc is None


def test_metrics_build_without_a_job(spark):
    spark.sparkContext.setJobGroup("building", "")
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 100).alias("s"))
    metrics.binary_metrics(df, "y", "s")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def points(spark, n=200):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1, 1, 0]
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0).astype(float)
    data = [(i, Vectors.dense(a), b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    return spark.createDataFrame(data, ["person_id", "features", "outcome"])


def test_gradient_sees_a_wrong_weight(spark):
    table = points(spark)
    right = [LogisticRegression(labelCol="outcome", regParam=0.01, standardization=False, tol=1e-12, maxIter=500)]
    early = [LogisticRegression(labelCol="outcome", regParam=0.01, standardization=False, maxIter=1)]
    models = learn.fit_vectors(table, {"right": right, "early": early})
    slope = {k: {r.place: r.gradient for r in learn.logistic_gradient(m, table, 0.01).collect()} for k, m in models.items()}
    assert set(slope["right"]) == {-1, 0, 1, 2} and max(map(abs, slope["right"].values())) < 1e-6
    assert max(map(abs, slope["early"].values())) > 1e-3
    assert abs(learn.logistic_gradient(models["right"], table, 0.5).where("place = 0").first().gradient) > 1e-2


def test_grid_scores_every_row_unseen(spark):
    table = points(spark)
    specs = {n: [LogisticRegression(labelCol="outcome", regParam=r, maxIter=20)] for n, r in (("b", 0.01), ("a", 0.01), ("z", 50.0))}
    best, model, losses = learn.grid_search(table, specs, folds=4)
    rows = losses.collect()
    assert best == "a" and model.stages[-1].coefficients.size == 3
    assert len(rows) == 12 and sum(r.rows for r in rows if r.candidate == "z") == 200
    ranks = {r.candidate: r["rank"] for r in learn.grid_ranks(losses).collect()}
    assert ranks == {"a": 1, "b": 2, "z": 3}


def test_refused_values_are_counted_in_the_same_pass(spark):
    df = spark.createDataFrame([("1", "x"), ("a", None), (None, "2024-01-01"), ("7", "2024-13-01")], "n string, d string")
    kept, seen = tables.conform_counted(df, "n int, d date", "loaded")
    assert sorted(str(r.n) for r in kept.collect()) == ["1", "7", "None", "None"]
    assert seen.get == {"rows": 4, "n": 1, "d": 2}
    assert {r.column_name: (r.rows, r.refused) for r in tables.refused(df.limit(0), "n int, d date", "t").collect()} == {"n": (0, 0), "d": (0, 0)}


def test_strict_loading_keeps_refused_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,d\n1,2024-01-01\nx,2024-01-02\n2\n3,2024-01-03,more\n4,\n")
    fine, lines = storage.load_strict(spark, str(tmp_path / "t.csv"), "n int, d date")
    assert sorted((r.n, str(r.d)) for r in fine.collect()) == [(1, "2024-01-01"), (4, "None")]
    assert sorted(r.line for r in lines.collect()) == ["2", "3,2024-01-03,more", "x,2024-01-02"]
