"""Shapes of the physical plans: no cross product, pushed filters, pruned columns, bounded broadcasts."""

import re

import pytest

from workload.queries import QUERIES

EAGER = ("product_", "source_strict", "seq_scaled_fitted", "model_", "feature_ranks", "sink_", "stats_", "topk_matrix_sparse", "matrix_", "layout_")
LAZY = [n for n in QUERIES if not n.startswith(EAGER)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_product_and_no_python(spark, small_root, name):
    text = plan(QUERIES[name](spark, small_root))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_event_domain_filter_and_columns_reach_the_scan(spark, small_root):
    df = QUERIES["indicator_days_condition"](spark, small_root)
    text = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line and "event_type" in line)
    assert "EqualTo(event_type,click)" in scan
    assert "value" not in re.search(r"ReadSchema: (.*)", scan).group(1)


def test_measures_shuffle_once_for_the_aggregate(spark, small_root):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    text = plan(QUERIES["measure_days"](spark, small_root))
    assert len(re.findall(r"Exchange hashpartitioning\(person_id", text)) == 1
    assert "SortMergeJoin" not in text


def test_without_the_size_verdict_nothing_is_broadcast(spark, small_root):
    from longfeat.operators import indicators
    from workload import views as vw
    from workload.queries import resolved_one
    from workload.views import Views

    v = Views(spark, small_root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = indicators.indicator_rows(v.domain("click"), resolved_one(v, "click"), vw.INDICATORS, small_fits=False)
        text = plan(rows)
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_split_ranks_inside_buckets(spark, small_root):
    text = plan(QUERIES["split_exact"](spark, small_root))
    assert re.search(r"Window .*row_number.*\[bucket", text)


def test_wide_sparse_matrix_plans_fast(spark, tmp_path):
    """5 x 1000 columns: aligning and scoring four models is built and planned in seconds."""
    import time

    from pyspark.sql import functions as F

    from longfeat.operators import learn

    people = spark.range(300).withColumnRenamed("id", "person_id")
    seen = people.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    cells = seen.select("person_id", F.format_string("con%d", F.pmod(F.xxhash64("person_id", "i"), F.lit(5000))).alias("feature"))
    names = [f"con{i}" for i in range(5000)]
    vectors = learn.cell_vectors(people, cells, names)
    table = vectors.withColumn("outcome", (F.col("person_id") % 2).cast("double"))
    spec = learn.matrix_specs(300, len(names))
    spec["lr"][-1].setMaxIter(5)
    lr = learn.fit_vectors(table, {"lr": spec["lr"]})["lr"]
    start = time.time()
    scored = learn.score_vectors({n: lr for n in ("a", "b", "c", "d")}, learn.cell_vectors(people, cells, names))
    plan(scored)
    assert time.time() - start < 5
    got = scored.collect()
    assert len(got) == 300 and all(r.a == r.d for r in got)
    held = {(r.person_id, r.feature) for r in cells.collect()}
    back = {(r.person_id, names[i]) for r in vectors.collect() for i in r.features.indices}
    assert back == held
