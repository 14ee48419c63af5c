"""Steps whose cost must not outgrow the input: size verdicts, exchanges of day facts, buckets, partitions of vectors."""

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from longfeat.operators import dayfacts, learn
from longfeat.sources import layout
from workload import queries, views
from workload.views import Views


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_large_part_table_leaves_its_small_vocabulary_broadcast(spark, tmp_path, monkeypatch):
    spark.range(20000).selectExpr("id as p_partkey", "repeat('name ', 10) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(views, "BROADCAST_BYTES", 200_000)
    assert Views(spark, str(tmp_path)).small
    monkeypatch.setattr(views, "BROADCAST_BYTES", 2_000)
    assert not Views(spark, str(tmp_path)).small


def test_day_facts_meet_cohort_and_episodes_in_one_exchange(spark, rows, table):
    """Persons in and out of the cohort, a null person, undated days, starts without a day, open and repeated episodes."""
    enc = rows([(1, "2024-01-01"), (1, None), (2, "2024-01-02"), (2, "2024-01-02"), (None, "2024-01-03"), (3, "2024-01-09")], "person_id bigint, day date")
    part = rows([(1, "2024-01-05", 7), (1, "2024-01-01", 2), (2, "2024-01-06", 5), (None, "2024-01-03", 4), (4, "2024-01-01", 1)], "person_id bigint, day date, a int")
    cohort = rows([(1,), (1,), (3,), (None,)], "person_id bigint")
    spans = [(1, "2024-01-04", "2024-01-05"), (1, "2024-01-04", "2024-01-04"), (2, "2024-01-01", "2024-01-02"), (3, "2024-01-08", None), (5, "2024-01-01", "2024-01-09"), (None, "2024-01-03", "2024-01-03")]
    episodes = rows(spans, "person_id bigint, start_day date, end_day date")
    for known in (cohort, None):
        got = dayfacts.day_facts(enc, [part], fill=False, cohort=known, episodes=episodes)
        want = dayfacts.in_episode(dayfacts.day_facts(enc, [part], fill=False, cohort=known), episodes)
        assert table(got, "person_id", "day", "a", "in_episode") == table(want, "person_id", "day", "a", "in_episode")
    got = dayfacts.day_facts(enc, [part], fill=False, cohort=cohort, episodes=episodes)
    found = {(r.person_id, str(r.day)): (r.a, r.in_episode) for r in got.collect()}
    assert found == {
        (1, "2024-01-01"): (2, 0), (1, "None"): (None, 0), (1, "2024-01-05"): (7, 1),
        (2, "2024-01-02"): (None, 1), (None, "2024-01-03"): (None, 1), (3, "2024-01-09"): (None, 0),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = final_plan(got).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "LeftAnti" not in text and text.count("Union") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(person_id#\d+L, day", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(person_id#\d+L, \d+\)", text)) == 2  # the days, the cohort


def test_buckets_grow_with_the_sources(spark, small_root, monkeypatch):
    assert len(queries.QUERIES["product_person_days"](spark, small_root).inputFiles()) == queries.BUCKETS
    monkeypatch.setattr(layout, "BUCKET_BYTES", 100_000)
    days = queries.QUERIES["product_person_days"](spark, small_root)
    files = days.inputFiles()
    assert len(files) >= 2 * queries.BUCKETS and len(files) % queries.BUCKETS == 0
    most = max(spark.read.parquet(f).count() for f in files)
    assert most * layout.row_bytes(days) <= 2 * layout.BUCKET_BYTES
    assert layout.row_bytes(spark.range(1).selectExpr("id", "cast(id as string) as t")) == 56


def test_partitions_of_vectors_grow_with_rows_and_width(spark, tmp_path, monkeypatch):
    """A file of one row group is dealt out before the fits; keys may be null or repeat."""
    data = [(None if i % 50 == 0 else i // 2, Vectors.sparse(200, [i % 200], [1.0]), float(i % 2)) for i in range(1000)]
    spark.createDataFrame(data, ["person_id", "features", "outcome"]).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert learn.spread_vectors(table).rdd.getNumPartitions() == 1
    assert learn.spread_vectors(table.limit(0)).count() == 0
    monkeypatch.setattr(learn, "VECTOR_BYTES", 100_000)
    for some in (table, table.drop("person_id")):
        sizes = learn.spread_vectors(some).rdd.glom().map(len).collect()
        assert len(sizes) == 16 and sum(sizes) == 1000 and max(sizes) < 200
    held = {}

    class Seen(LogisticRegression):
        def _fit(self, dataset):
            held["parts"] = dataset.rdd.getNumPartitions()
            return super()._fit(dataset)

    learn.fit_vectors(table, {"lr": [Seen(labelCol="outcome", maxIter=1)]})
    assert held["parts"] == 16
