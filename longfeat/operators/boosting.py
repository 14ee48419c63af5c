"""Gradient boosting by exponential loss, which Spark's own boosting lacks, as a sequence of weighted regression trees.

With labels y of -1 and 1 and a margin f a row loses exp(-y f). That loss is also the row's curvature, so a leaf's Newton
step is sum(w y) / sum(w) with w = exp(-y f): the weighted mean of the labels, which is what a regression tree on y with the
weights w predicts there. A round is thus one Spark tree; the weights are a column.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longfeat.sources.storage import materialize

SLOTS = 1 << 30


def in_share(key: str, share: float, seed: int, turn: int) -> Column:
    """Is the key among the rows of a round? The same in every run, whatever the partitions."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(turn)), F.lit(SLOTS)) < int(share * SLOTS)


def fit_exponential(
    table: DataFrame,
    rounds: int = 500,
    depth: int = 12,
    step: float = 0.075,
    share: float = 0.618,
    subset: str = "log2",
    least_rows: int = 1,
    seed: int = 1,
    cut: int = 25,
    key: str = "person_id",
) -> PipelineModel:
    """Boosted trees over ``features`` for ``outcome`` (0 or 1); rows without an outcome are left out.

    Each round fits a tree of ``depth`` on a hash-chosen ``share`` of the rows, every node on a ``subset`` of the
    features, and moves all margins by ``step`` times its leaves. The margins of the last round are kept, since a fit reads
    its rows several times, so a round applies one tree and not all before it. They are written to the shared folder every
    ``cut`` rounds, so neither lineage nor plan grows with the rounds. The model is a plain pipeline that can be saved;
    it adds ``margin``, ``margins`` (before and after each round, computed only where read) and ``probability``.
    """
    known = table.where(F.col("outcome").isNotNull())
    rows, ones = known.agg(F.count(F.lit(1)), F.count_if(F.col("outcome") == 1)).first()
    if not 0 < ones < rows:
        raise ValueError("boosting needs rows of both outcomes")
    start = 0.5 * math.log(ones / (rows - ones))
    state = known.select(key, "features", F.when(F.col("outcome") == 1, 1.0).otherwise(-1.0).alias("signed"))
    state = state.withColumn("margin", F.lit(start))
    trees, kept = [], None
    try:
        for turn in range(rounds):
            if turn % cut == 0:
                state = materialize(state, "boost")
            before, kept = kept, state.persist(StorageLevel.MEMORY_AND_DISK)
            weighted = state.withColumn("weight", F.exp(-F.col("signed") * F.col("margin")))
            learner = RandomForestRegressor(
                labelCol="signed", weightCol="weight", numTrees=1, bootstrap=False, featureSubsetStrategy=subset,
                maxDepth=depth, minInstancesPerNode=least_rows, seed=seed + turn,
            )
            try:
                tree = learner.fit(weighted.where(in_share(key, share, seed, turn))).trees[0]
            finally:
                if before is not None:
                    before.unpersist()
            trees.append(tree.setPredictionCol(f"tree_{turn}"))
            moved = F.col("margin") + step * F.col(f"tree_{turn}")
            state = trees[-1].transform(state).select(key, "features", "signed", moved.alias("margin"))
    finally:
        if kept is not None:
            kept.unpersist()
    return PipelineModel([*trees, *margin_stages(rounds, start, step)])


class ExponentialBoost(Estimator):
    """``fit_exponential`` as a stage, for the specs of a family; the options are its own.

    The rows need the key that subsamples are drawn by.
    """

    def __init__(self, **options):
        super().__init__()
        self.options = options

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return fit_exponential(dataset, **self.options)


def importances(model: PipelineModel) -> list[float]:
    """The share of each feature in the gains of the trees, every tree that splits counting alike."""
    each = [s.featureImportances.toArray() for s in model.stages if isinstance(s, DecisionTreeRegressionModel)]
    total = sum(each)
    return (total / (total.sum() or 1.0)).tolist()


def margin_stages(rounds: int, start: float, step: float) -> list:
    """From the trees' columns: the margins and the probabilities of both classes."""
    leaves = f"array({', '.join(f'tree_{i}' for i in range(rounds))})"
    first, by = f"CAST('{start!r}' AS DOUBLE)", f"CAST('{step!r}' AS DOUBLE)"
    last = f"aggregate({leaves}, {first}, (m, leaf) -> m + {by} * leaf)"
    each = f"aggregate({leaves}, array({first}), (m, leaf) -> concat(m, array(element_at(m, -1) + {by} * leaf)))"
    shares = "1 / (1 + exp(2 * margin)) AS share_0, 1 / (1 + exp(-2 * margin)) AS share_1"
    statement = f"SELECT *, {shares} FROM (SELECT *, {last} AS margin, {each} AS margins FROM __THIS__)"
    return [SQLTransformer(statement=statement), VectorAssembler(inputCols=["share_0", "share_1"], outputCol="probability")]


def round_losses(model: PipelineModel, table: DataFrame) -> DataFrame:
    """(round, rows, loss): the mean exponential loss, which is the mean row weight, before the first and after each round.

    One pass over the rows; a row's margins are combined before the shuffle.
    """
    signed = F.when(F.col("outcome") == 1, 1.0).otherwise(-1.0)
    scored = model.transform(table.where(F.col("outcome").isNotNull())).select(signed.alias("signed"), F.posexplode("margins").alias("round", "margin"))
    return scored.groupBy("round").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.exp(-F.col("signed") * F.col("margin"))).alias("loss"))
