"""Boosting by exponential loss: every round against NumPy, saving, subsamples, refused tables."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from longfeat.operators import boosting, learn
from longfeat.sources import storage


def planted(n=300, seed=3):
    """Two features that matter only together, two that do not, and noise."""
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 2, (n, 4))
    y = ((x[:, 0] ^ x[:, 1]) | (x[:, 2] & x[:, 0])) ^ (draw.random(n) < 0.15)
    return x, y.astype(int)


def frame(spark, x, y, parts=3):
    rows = [(i, Vectors.dense(a.tolist()), None if b is None else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["person_id", "features", "outcome"]).repartition(parts)


def leaf_means(x, y, w, depth):
    """A weighted regression tree over 0/1 features, grown greedily by weighted variance; the leaf mean of every row."""
    out = np.full(len(y), (w * y).sum() / w.sum())
    if depth:
        def error(rows):
            return (w[rows] * (y[rows] - (w[rows] * y[rows]).sum() / w[rows].sum()) ** 2).sum()

        splits = [(error(x[:, j] == 0) + error(x[:, j] == 1), j) for j in range(x.shape[1]) if 0 < x[:, j].sum() < len(y)]
        if splits and min(splits)[0] < error(np.ones(len(y), bool)):
            for side in (0, 1):
                rows = x[:, min(splits)[1]] == side
                out[rows] = leaf_means(x[rows], y[rows], w[rows], depth - 1)
    return out


def test_weights_of_every_round(spark):
    x, y = planted()
    model = boosting.fit_exponential(frame(spark, x, y), rounds=6, depth=2, step=0.4, share=1.0, subset="all", cut=4)
    got = {r.person_id: r for r in model.transform(frame(spark, x, y)).select("person_id", "margins", "margin", "probability").collect()}
    signed = 2.0 * y - 1
    margin = np.full(len(y), 0.5 * np.log(y.mean() / (1 - y.mean())))
    losses = []
    for turn in range(7):
        weight = np.exp(-signed * margin)
        losses.append(weight.mean())
        ours = np.exp(-signed * np.array([got[i].margins[turn] for i in range(len(y))]))
        assert np.allclose(ours, weight, rtol=1e-9, atol=0)
        if turn < 6:
            margin = margin + 0.4 * leaf_means(x, signed, weight, 2)
    assert all(np.isclose(got[i].margin, margin[i]) and np.isclose(got[i].probability[1], 1 / (1 + np.exp(-2 * margin[i]))) for i in range(len(y)))
    assert losses == sorted(losses, reverse=True)
    found = {r["round"]: (r["rows"], r.loss) for r in boosting.round_losses(model, frame(spark, x, y)).collect()}
    assert sorted(found) == list(range(7)) and all(n == 300 for n, _ in found.values())
    assert np.allclose([found[i][1] for i in range(7)], losses)


def test_subsample_depends_on_ids_alone_and_model_is_saved(spark, tmp_path):
    x, y = planted()
    first, second = (boosting.fit_exponential(frame(spark, x, y, p), rounds=5, depth=3, share=0.618, cut=2) for p in (1, 7))
    storage.save_models({"boost": first}, str(tmp_path))
    loaded = PipelineModel.load(f"{tmp_path}/boost")
    scores = [dict(map(tuple, learn.score_vectors({"s": m}, frame(spark, x, y)).collect())) for m in (first, second, loaded)]
    assert scores[0] == scores[2] and all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in range(300))
    ids = spark.range(20000)
    chosen = [{r.id for r in ids.where(boosting.in_share("id", 0.618, 1, t)).collect()} for t in (0, 1)]
    assert all(abs(len(c) / 20000 - 0.618) < 0.02 for c in chosen) and abs(len(chosen[0] & chosen[1]) / 20000 - 0.618**2) < 0.02


def test_rows_without_outcome_and_one_class(spark):
    x, y = planted(60)
    whole = frame(spark, x, y)
    holes = frame(spark, np.vstack([x, x]), [*y, *[None] * 60])
    kinds = dict(rounds=2, depth=2, share=1.0, subset="all")
    ours, theirs = (boosting.fit_exponential(t, **kinds).transform(whole).select("person_id", "margin").collect() for t in (whole, holes))
    assert {r.person_id: round(r.margin, 9) for r in ours} == {r.person_id: round(r.margin, 9) for r in theirs}
    for bad in (whole.where("outcome = 1"), whole.where("outcome > 5"), whole.withColumn("outcome", F.lit(0.0))):
        with pytest.raises(ValueError):
            boosting.fit_exponential(bad, **kinds)


def test_a_round_reads_kept_margins(spark, monkeypatch):
    """Every fit finds the margins of the round before it kept, and nothing stays kept afterwards."""
    x, y = planted(80)
    plans, learner = [], boosting.RandomForestRegressor
    fit = learner.fit

    def seen(self, rows):
        plans.append(rows._jdf.queryExecution().withCachedData().toString())
        return fit(self, rows)

    monkeypatch.setattr(learner, "fit", seen)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    boosting.fit_exponential(frame(spark, x, y), rounds=5, depth=2, cut=3)
    assert len(plans) == 5 and all("InMemoryRelation" in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
