"""Tables on disk to predictions, with the default configuration."""

import random
from types import SimpleNamespace

import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from longfeat.operators.boosting import ExponentialBoost
from longfeat.operators.cohort import build_cohort
from longfeat.operators.learn import feature_ranks, model_weights, select_best
from longfeat.operators.lookback import recent_counts, recent_rows
from longfeat.operators.labels import attach_outcome, outcome, restrict, split_exact
from longfeat.operators.topk import topk_cells
from longfeat.plans import modelling, products
from longfeat.sources.schemas import PERSON_TABLES, VOCABULARY_TABLES
from longfeat.sources.storage import load_columns, materialize, shared_dir, write_table
from longfeat.sources.tables import conform, load_tables, operator_tables, subset, subset_rows

LINES = {
    "members": [
        (600531961, 702677, "vaccine", "true", 1, "p", "false"), (600531961, 724906, "vaccine", "true", 1, "m", "false"),
        (1, 11, "cough", "true", 1, "cough", "false"), (2, 12, "fever", "false", 1, "fever", "false"),
        (3, 13, "Long-COVID (PASC)", "false", 1, "pasc", "false"),
        (4, 21, "body mass index", "true", 1, "bmi", "false"), (5, 31, "ATLAS SARS-CoV-2 rt-PCR and AG", "true", 1, "pcr", "false"),
        (6, 41, "ResultPos", "true", 1, "pos", "false"), (7, 51, "steroid", "true", 1, "steroid", "false"),
    ],
    "registry": [("cough", "COUGH", "condition,observation"), ("fever", "FEVER", "condition"), ("steroid", "STEROID", "drug")],
    "required_registry": [("Long-COVID (PASC)", "PASC", "condition"), ("cough", "COUGH", "condition,observation")],
}
INDICATORS = ["COUGH", "FEVER", "PASC", "STEROID", "EXTRA"]


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    """A generated table set as CSV folders (training and vocabulary roots)."""
    r = random.Random(11)
    day = lambda: f"2021-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    pid = lambda: r.randint(1, 40)
    lines = dict(LINES)
    lines["person"] = [(p, 1940 + p, p % 13, p % 28) for p in range(1, 41)]
    lines["encounter"] = [(pid(), day(), "2021-03-01", "2021-03-20") for _ in range(200)]
    lines["condition"] = [(pid(), day(), r.choice([11, 12, 13, 99])) for _ in range(200)]
    lines["observation"] = [(pid(), day(), r.choice([11, 77])) for _ in range(100)]
    lines["procedure"] = [(pid(), day(), r.choice([766238, 5])) for _ in range(60)]
    lines["drug"] = [(pid(), day(), r.choice([702677, 724906, 51]), r.choice([1, 32833])) for _ in range(200)]
    lines["device"] = [(pid(), day(), 1) for _ in range(10)]
    lines["measurement"] = [(pid(), day(), r.choice([21, 31, 3024171]), r.choice([None, 18.0, 33.0]), r.choice([41, 42]))
                            for _ in range(300)]
    lines["label"] = [(p, p % 2, 0) for p in range(1, 39)]
    lines["note"] = [(1, 1, "2021-01-01", 1)]
    lines["mention"] = [(1, 1, "Positive", 11, "cough")]
    lines["broad_sets"] = [(1, "broad-cough")]
    root = str(tmp_path_factory.mktemp("tables"))
    for name, ddl in {**PERSON_TABLES, **VOCABULARY_TABLES}.items():
        names = [c.strip().split(" ")[0] for c in ddl.split(",")]
        text = spark.createDataFrame([tuple(None if x is None else str(x) for x in row) for row in lines[name]],
                                     ", ".join(f"{n} string" for n in names))
        write_table(conform(text, ddl), f"{root}/{name}.csv", "csv")
    return root


@pytest.fixture(scope="module")
def product(spark, roots):
    tables = operator_tables(load_tables(spark, roots, {**PERSON_TABLES, **VOCABULARY_TABLES}))
    members, registry = products.vocabulary(tables, [(14, "extra", "extra_set")], [("extra_set", "EXTRA", "condition")])
    cohort = build_cohort(tables["person"], tables["encounter"], "2022-01-01")
    days = products.build_person_days(tables, cohort, members, registry, INDICATORS)
    return tables, cohort, materialize(days, "days")


def test_day_facts_columns_and_rules(product):
    _, _, days = product
    assert {"COUGH", "EXTRA", "respiratory_rate", "bmi_rounded", "pcr_ag_pos", "dose1", "had_dose", "in_episode"} <= set(days.columns)
    assert days.count() == days.select("person_id", "day").distinct().count()
    top = days.agg(*[F.max(c).alias(c) for c in ("COUGH", "FEVER", "PASC", "EXTRA", "in_episode")]).first()
    assert (top.COUGH, top.FEVER, top.PASC, top.EXTRA, top.in_episode) == (1, 0, 1, 0, 1)


def test_training_and_scoring(spark, product, tmp_path):
    tables, cohort, days = product
    summary = products.build_summary(days, cohort)
    matrix = products.build_topk(tables, cohort, k=5)
    models = {
        "lr": [LogisticRegression(labelCol="outcome", regParam=0.1, maxIter=20)],
        "rf": [RandomForestClassifier(labelCol="outcome", numTrees=5, maxDepth=3, seed=1)],
    }
    fitted = modelling.train(summary, matrix, tables["label"], str(tmp_path), models, models)
    sequence = cohort.where("person_id < 10").select("person_id", F.lit(0.9).alias("sequence"))
    drifted = matrix.drop(matrix.columns[-1]).withColumn("unseen", F.lit(1))
    out = modelling.predict(summary, drifted, cohort, str(tmp_path), ["lr", "rf"], [sequence], {"sequence": 0.5})
    assert out.count() == cohort.count()
    for r in out.collect():
        each = [r.lr_matrix, r.rf_matrix, r.lr_summary, r.rf_summary, r.sequence]
        assert all(0 <= s <= 1 for s in each) and r.sequence == (0.9 if r.person_id < 10 else 0.5)
        assert r.probability == pytest.approx(sum(each) / 5) and r.outcome == int(r.probability > 0.5)
    features = [c for c in matrix.columns if c != "person_id"]
    ranks = feature_ranks(spark, fitted["matrix"]["lr"], features, 3).collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3] and ranks[0].weight >= ranks[1].weight
    labelled = attach_outcome(matrix, outcome(tables["label"]))
    best, losses = select_best(fitted["matrix"], labelled)
    assert best == losses.first().candidate and losses.count() == 2


def test_sparse_cells_train_and_score_like_columns(spark, product, tmp_path):
    tables, cohort, days = product
    summary = products.build_summary(days, cohort)
    models = {"lr": [LogisticRegression(labelCol="outcome", regParam=0.1, maxIter=50)]}
    cells = topk_cells(products.topk_domains(tables), k=5)
    wide = products.build_topk(tables, cohort, k=5)
    scores = []
    for name, matrix in (("cells", cells), ("wide", wide)):
        modelling.train(summary, matrix, tables["label"], str(tmp_path / name), models, models)
        out = modelling.predict(summary, matrix, cohort, str(tmp_path / name), ["lr"])
        scores.append({r.person_id: r.lr_matrix for r in out.collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[0][p] == pytest.approx(scores[1][p], abs=1e-4) for p in scores[0])
    unseen = cells.union(cells.select("person_id", F.lit("con-unseen").alias("feature")))
    again = modelling.predict(summary, unseen, cohort, str(tmp_path / "cells"), ["lr"])
    assert {r.person_id: r.lr_matrix for r in again.collect()} == pytest.approx(scores[0])


def test_exponential_boosting_as_a_spec(spark, product, tmp_path):
    tables, cohort, days = product
    summary, cells = products.build_summary(days, cohort), topk_cells(products.topk_domains(tables), k=5)
    models = {"gbt": [ExponentialBoost(rounds=3, depth=3, step=0.3, cut=2)]}
    fitted = modelling.train(summary, cells, tables["label"], str(tmp_path), models, models)
    out = modelling.predict(summary, cells, cohort, str(tmp_path), ["gbt"]).collect()
    assert len(out) == cohort.count() and all(0 < r.gbt_matrix < 1 and 0 < r.gbt_summary < 1 for r in out)
    assert len({round(r.gbt_summary, 9) for r in out}) > 1
    columns = load_columns(spark, f"{tmp_path}/summary_columns")
    weights = model_weights(fitted["summary"]["gbt"])
    assert len(weights) == len(columns) and sum(weights) == pytest.approx(1) and min(weights) >= 0
    assert [r["rank"] for r in feature_ranks(spark, fitted["summary"]["gbt"], columns, 3).collect()] == [1, 2, 3]


def test_windows_split_and_subsets(product):
    tables, cohort, days = product
    counts = recent_counts(recent_rows(days))
    split = split_exact(counts, 0.9)
    valid = restrict(days, split, "valid").select("person_id").distinct().count()
    assert valid == counts.count() - int(0.9 * counts.count())
    some = subset({k: tables[k] for k in ("person", "encounter")}, 5)
    assert some["encounter"].select("person_id").distinct().count() <= 5
    assert subset_rows({"person": tables["person"]}, 7)["person"].count() == 7


def test_shared_folder_comes_from_the_session(spark):
    own = shared_dir(spark)
    assert own == shared_dir(spark)
    context = SimpleNamespace(master="yarn", applicationId="x", getConf=lambda: {})
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///shared/"}, sparkContext=context)
    assert shared_dir(named) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
