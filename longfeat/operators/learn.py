"""Classifier ensembles on Spark ML: fitting, alignment, scoring, averaging, ranked features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.operators.boosting import importances
from longfeat.operators.cohort import hash_position
from longfeat.operators.metrics import candidate_losses, log_loss
from longfeat.sources.storage import materialize
from longfeat.sources.tables import inline

WEIGHT = "class_weight"
#: What a partition of training rows may hold, as 8 bytes for each column of each row.
VECTOR_BYTES = 64 << 20


def matrix_specs(rows: int, width: int) -> dict[str, list[Estimator]]:
    """Models of the concept matrix. ``rows`` turns the unit inverse penalty into Spark's per-row penalty."""
    penalty = 1.0 / rows
    linear = dict(labelCol="outcome", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=500)
    return {
        "lr": [LogisticRegression(**linear)],
        "lr_balanced": [LogisticRegression(**linear, weightCol=WEIGHT)],
        "rf": [RandomForestClassifier(labelCol="outcome", numTrees=100, featureSubsetStrategy="sqrt", maxDepth=12, seed=1)],
        "gbt": [GBTClassifier(labelCol="outcome", maxIter=100, maxDepth=3, stepSize=0.1, seed=1)],
        "mlp": [
            # Without the mean, so that a vector of thousands of mostly empty columns stays sparse.
            StandardScaler(inputCol="features", outputCol="scaled", withMean=False),
            MultilayerPerceptronClassifier(
                labelCol="outcome", featuresCol="scaled", layers=[width, 20, 10, 2], maxIter=200, seed=1
            ),
        ],
    }


def summary_specs(rows: int) -> dict[str, list[Estimator]]:
    """Models of the person summary.

    The forest has 100 trees of depth 12 and boosting 60 rounds of depth 5: Spark grows every level of a tree in a pass
    over the data and keeps 2 ** depth nodes, so the hundreds of trees of depth 30 and rounds of depth 12 of
    single-machine defaults would cost thousands of jobs; pass other specs where that is wanted.
    """
    penalty = 1.0 / rows
    linear = dict(labelCol="outcome", regParam=penalty, elasticNetParam=0.0, standardization=False)
    return {
        "lr": [LogisticRegression(**linear, maxIter=100)],
        "lr_balanced": [LogisticRegression(**linear, maxIter=500, weightCol=WEIGHT)],
        "rf": [
            RandomForestClassifier(
                labelCol="outcome", numTrees=100, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=12, seed=1
            )
        ],
        "gbt": [
            GBTClassifier(
                labelCol="outcome",
                maxIter=60,
                maxDepth=5,
                stepSize=0.075,
                minWeightFractionPerNode=0.001,
                subsamplingRate=0.618,
                featureSubsetStrategy="log2",
                seed=1,
            )
        ],
    }


def indicator_features(columns: Sequence[str], named: Sequence[str] = ("encounters", "age")) -> list[str]:
    """Features of the summary models: the named columns and every indicator column."""
    return [c for c in named if c in columns] + [c for c in columns if "indicator" in c]


def align_columns(df: DataFrame, columns: Sequence[str], key: str = "person_id") -> DataFrame:
    """Exactly the training columns in name order: missing ones are 0, extra ones go, nulls become 0."""
    have = set(df.columns)
    wanted = sorted(c for c in columns if c != key)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in wanted]
    return df.select(key, *filled)


def balance_weights(df: DataFrame, label: str = "outcome") -> DataFrame:
    """Adds n / (2 n_class); the class counts are a scalar subquery."""
    sizes = df.agg(
        F.struct(F.count_if(F.col(label) == 1).alias("ones"), F.count(F.lit(1)).alias("all")).alias("sizes")
    ).scalar()
    size = F.when(F.col(label) == 1, sizes["ones"]).otherwise(sizes["all"] - sizes["ones"])
    return df.withColumn(WEIGHT, F.try_divide(sizes["all"].cast("double"), 2 * size))


def place_vectors(people: DataFrame, placed: DataFrame, width: int, key: str = "person_id") -> DataFrame:
    """(key, features): a binary sparse vector per person from (key, place) rows; persons without one get zeros.

    Rows are made distinct before they meet per person, so a person brings ``width`` places at most.
    """
    held = placed.distinct().groupBy(key).agg(F.collect_list(F.col("place").cast("string")).alias("held"))
    none = F.array().cast("array<string>")
    held = people.select(key).distinct().join(held, key, "left").withColumn("held", F.coalesce("held", none))
    if width == 0:
        raise ValueError("a matrix needs a column")
    to_vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="held", outputCol="features")
    return to_vector.setBinary(True).transform(held).select(key, "features")


def cell_vectors(people: DataFrame, cells: DataFrame, names: Sequence[str], key: str = "person_id") -> DataFrame:
    """Vectors over the columns ``names`` from sparse (key, feature) cells: the alignment of a sparse matrix.

    Cells of other features go, absent ones stay 0. The name table (one row per column) is broadcast.
    """
    table = inline(people.sparkSession, [(n, i) for i, n in enumerate(names)], "feature string, place int")
    return place_vectors(people, cells.join(F.broadcast(table), "feature").select(key, "place"), len(names), key)


def spread_vectors(table: DataFrame, key: str = "person_id") -> DataFrame:
    """The rows dealt to partitions of ``VECTOR_BYTES`` of values each, every column counted, since trees keep an entry for each.

    A written table of sparse vectors is small, so its files give few partitions, and one with a single row group gives
    one whatever its size. A table that fits in one partition stays as it lies.
    """
    first = table.select("features").first()
    parts = -(-table.count() * first.features.size * 8 // VECTOR_BYTES) if first else 0
    if parts <= 1:
        return table
    by = [key] if key in table.columns else []
    return table.repartition(max(parts, table.sparkSession.sparkContext.defaultParallelism), *by)


def fit_vectors(
    table: DataFrame, specs: Mapping[str, Sequence[Estimator]], key: str = "person_id"
) -> dict[str, PipelineModel]:
    """Fit every spec on the same (features, outcome) rows, which are kept while the fits read them repeatedly.

    The key stays where the table has one: some models draw their subsamples by it.
    """
    kept = [key] if key in table.columns else []
    weighted = balance_weights(spread_vectors(table, key))
    vectors = weighted.select(*kept, "features", "outcome", WEIGHT).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: Pipeline(stages=list(stages)).fit(vectors) for name, stages in specs.items()}
    finally:
        vectors.unpersist()


def score_vectors(models: Mapping[str, PipelineModel], vectors: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, one probability of class 1 per model); only the key and the vector travel between the models."""
    kept = [key, "features"]
    for name, model in models.items():
        vectors = model.transform(vectors).withColumn(f"score_{name}", vector_to_array("probability")[1])
        kept.append(f"score_{name}")
        vectors = vectors.select(*kept)
    return vectors.select(key, *[F.col(f"score_{n}").alias(n) for n in models])


def fit_models(
    df: DataFrame, features: Sequence[str], label: str, specs: Mapping[str, Sequence[Estimator]], key: str = "person_id"
) -> dict[str, PipelineModel]:
    """Fit every spec on the same assembled columns; each model holds the assembler."""
    features = sorted(features)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    kept = [key] if key in df.columns and key not in features else []
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    aligned = df.select(*kept, *filled, F.col(label).cast("double").alias("outcome"))
    fitted = fit_vectors(assembler.transform(aligned).select(*kept, "features", "outcome"), specs, key)
    return {name: PipelineModel([assembler, *model.stages]) for name, model in fitted.items()}


def score(models: Mapping[str, PipelineModel], df: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, one probability of class 1 per model) from columns: they are aligned and assembled once for all models."""
    assembler = next(iter(models.values())).stages[0]
    if any(m.stages[0].getInputCols() != assembler.getInputCols() for m in models.values()):
        raise ValueError("the models were fitted on different columns")
    vectors = assembler.transform(align_columns(df, assembler.getInputCols(), key)).select(key, "features")
    return score_vectors({n: PipelineModel(m.stages[1:]) for n, m in models.items()}, vectors, key)


def ensemble(
    base: DataFrame,
    scores: Sequence[DataFrame],
    defaults: Mapping[str, float] | None = None,
    threshold: float = 0.5,
    key: str = "person_id",
) -> DataFrame:
    """Base persons with every score column, their mean ``probability`` and the 0/1 ``outcome``.

    Score tables are stacked and aggregated by person once, not joined one by one. A person absent from a table gets
    the column's default (``defaults``); without one the mean runs over the scores that exist.
    """
    defaults = defaults or {}
    names = [c for s in scores for c in s.columns if c != key]
    rows = base.select(key).distinct().withColumn("_base", F.lit(True))
    for s in scores:
        rows = rows.unionByName(s, allowMissingColumns=True)
    people = rows.groupBy(key).agg(F.max("_base").alias("_base"), *[F.max(n).alias(n) for n in names])
    filled = {n: F.coalesce(F.col(n), F.lit(float(d))) for n, d in defaults.items()}
    people = people.where(F.col("_base")).drop("_base").withColumns(filled) if filled else people.where("_base").drop("_base")
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    present = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    mean = F.try_divide(total, present)
    return people.withColumn("probability", mean).withColumn(
        "outcome", F.when(F.col("probability") > threshold, 1).otherwise(0)
    )


def logistic_gradient(model: PipelineModel, table: DataFrame, penalty: float, weight: str | None = None) -> DataFrame:
    """(place, gradient): what the penalised mean cross-entropy of a linear model rises by, per unit of each weight.

    At the optimum every entry is 0. ``table`` has the features the model was fitted on, ``outcome`` and the ``weight``
    column; place -1 is the intercept, which no penalty holds. One pass over all rows; a row brings its values that
    are not 0, combined before the shuffle.
    """
    last = model.stages[-1]
    w = F.col(weight) if weight else F.lit(1.0)
    scored = model.transform(table).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"), F.col("outcome").alias("y"), w.alias("w"))
    residual = F.col("w") * (F.col("p") - F.col("y"))
    held = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("place"), v.alias("v"))), lambda c: c["v"] != 0)
    total = scored.agg(F.sum("w")).scalar()
    each = F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.lit(1.0).alias("v"))), held)
    sums = scored.select(residual.alias("r"), F.inline(each)).groupBy("place").agg(F.sum(F.col("r") * F.col("v")).alias("s"))
    weights = [(-1, 0.0), *enumerate(float(c) for c in last.coefficients.toArray())]
    known = inline(table.sparkSession, weights, "place int, coefficient double")
    slope = F.coalesce(F.col("s"), F.lit(0.0)) / total + F.col("coefficient") * penalty
    return known.join(sums, "place", "left").select("place", slope.alias("gradient"))


def fold_of(key: str, folds: int, seed: int = 0) -> Column:
    """A key's fold, the same in every run."""
    return F.pmod(hash_position(key, seed), F.lit(folds)).cast("int")


def grid_losses(scored: DataFrame, label: str, scores: Mapping[str, str], fold: str = "fold") -> DataFrame:
    """(candidate, fold, rows, loss): mean cross-entropy of every score column on every fold, in one aggregate."""
    losses = [log_loss(F.col(label), F.col(c)).alias(f"__{i}") for i, c in enumerate(scores.values())]
    each = scored.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), *losses)
    lines = [F.struct(F.lit(n).alias("candidate"), F.col(f"__{i}").alias("loss")) for i, n in enumerate(scores)]
    return each.select(F.col(fold).alias("fold"), "rows", F.inline(F.array(*lines))).select("candidate", "fold", "rows", "loss")


def grid_ranks(losses: DataFrame) -> DataFrame:
    """(candidate, loss, spread, rank): candidates by their mean loss over all rows; equal losses go by name."""
    mean = F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")
    means = losses.groupBy("candidate").agg(mean.alias("loss"), (F.max("loss") - F.min("loss")).alias("spread"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("loss", "candidate")))  # a row per candidate


def grid_search(
    table: DataFrame, specs: Mapping[str, Sequence[Estimator]], folds: int = 3, seed: int = 0, key: str = "person_id"
) -> tuple[str, PipelineModel, DataFrame]:
    """The best of ``specs`` by cross-validation, fitted again on all rows, and the losses of ``grid_losses``.

    ``table`` has the key, ``features`` and ``outcome``. Every row is scored once, by the models that were fitted
    without its fold; the scores of all candidates and folds are judged in one aggregate.
    """
    placed = table.withColumn("fold", fold_of(key, folds, seed))
    parts = []
    for fold in range(folds):
        models = fit_vectors(placed.where(F.col("fold") != fold), specs, key)
        held = placed.where(F.col("fold") == fold)
        parts.append(score_vectors(models, held, key).join(held.select(key, "fold", "outcome"), key))
    scored = reduce(DataFrame.unionByName, parts)
    losses = materialize(grid_losses(scored, "outcome", {n: n for n in specs}), "grid")
    best = grid_ranks(losses).where("rank = 1").first().candidate
    return best, fit_vectors(table, {best: specs[best]}, key)[best], losses


def model_weights(model: PipelineModel) -> list[float]:
    """Feature importances of a tree ensemble or coefficients of a linear model."""
    last = model.stages[-1]
    if isinstance(last, PipelineModel):  # boosted trees
        return importances(last)
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [float(v) for v in values.toArray()]


def feature_ranks(spark, model: PipelineModel, features: Sequence[str], n: int = 20, least: bool = False) -> DataFrame:
    """(feature, weight, rank) of the n largest (or smallest) weights; features in the order of fitting."""
    table = inline(spark, zip(sorted(features), model_weights(model)), "feature string, weight double")
    order = ["weight", "feature"] if least else [F.desc("weight"), "feature"]
    top = table.orderBy(*order).limit(n)
    ranked = [(r.feature, r.weight, i) for i, r in enumerate(top.collect(), start=1)]  # n rows
    return inline(spark, ranked, "feature string, weight double, rank int")


def common_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features ranked in both tables."""
    return a.select("feature").intersect(b.select("feature"))


def select_best(
    candidates: Mapping[str, PipelineModel], valid: DataFrame, label: str = "outcome", key: str = "person_id"
) -> tuple[str, DataFrame]:
    """Name of the candidate with the lowest validation cross-entropy, and all losses.

    ``valid`` must hold rows that no candidate was fitted on.
    """
    scored = score(candidates, valid, key).join(valid.select(key, label), key)
    losses = candidate_losses(scored, label, {n: n for n in candidates})
    return losses.first().candidate, losses
