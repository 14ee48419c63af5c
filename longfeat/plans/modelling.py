"""Training and scoring of the two model families (concept matrix, person summary)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.operators.labels import attach_outcome, outcome
from longfeat.operators.learn import (
    align_columns,
    cell_vectors,
    ensemble,
    fit_models,
    fit_vectors,
    indicator_features,
    matrix_specs,
    score,
    score_vectors,
    summary_specs,
)
from longfeat.sources.storage import load_columns, load_models, materialize, save_columns, save_models

# Models that enter the average; the perceptron of the matrix family is trained but not averaged.
AVERAGED = ("gbt", "lr_balanced", "lr", "rf")
MATRIX, SUMMARY = "matrix", "summary"


def fit_family(
    frame: DataFrame, features: Sequence[str], labels: DataFrame, specs=None, family: str = SUMMARY
) -> dict[str, PipelineModel]:
    """Fit one family. The training table is written once, because every fit reads it many times."""
    table = materialize(attach_outcome(frame.select("person_id", *features), outcome(labels)), f"train-{family}")
    if specs is None:
        rows = table.count()
        specs = matrix_specs(rows, len(features)) if family == MATRIX else summary_specs(rows)
    return fit_models(table, features, "outcome", specs)


def is_sparse(matrix: DataFrame) -> bool:
    """Sparse matrices are (person_id, feature) cells; others have a column per feature."""
    return set(matrix.columns) == {"person_id", "feature"}


def fit_cells(
    people: DataFrame, cells: DataFrame, names: Sequence[str], labels: DataFrame, specs=None
) -> dict[str, PipelineModel]:
    """Fit the matrix family on sparse vectors over ``names``, written once."""
    table = attach_outcome(cell_vectors(people, cells, names), outcome(labels))
    table = materialize(table.withColumn("outcome", F.col("outcome").cast("double")), "train-cells")
    return fit_vectors(table, specs or matrix_specs(table.count(), len(names)))


def train(
    summary: DataFrame,
    matrix: DataFrame,
    labels: DataFrame,
    root: str,
    summary_models: Mapping | None = None,
    matrix_models: Mapping | None = None,
) -> dict[str, dict[str, PipelineModel]]:
    """Fit and save both families under ``root``, with the training columns next to the models.

    ``matrix`` is best sparse: (person_id, feature) cells of the persons of the summary, as ``topk_cells`` gives them.
    Its columns are then the distinct features (k per domain at most) in name order.
    """
    sparse = is_sparse(matrix)
    if sparse:
        columns = [r.feature for r in matrix.select("feature").distinct().orderBy("feature").collect()]
    else:
        columns = [c for c in matrix.columns if c != "person_id"]
    frames = {
        SUMMARY: (summary, indicator_features(summary.columns), summary_models),
        MATRIX: (matrix, columns, matrix_models),
    }
    fitted = {}
    for family, (frame, features, specs) in frames.items():
        if family == MATRIX and sparse:
            fitted[family] = fit_cells(summary, frame, features, labels, specs)
        else:
            fitted[family] = fit_family(frame, features, labels, specs, family)
        save_models(fitted[family], f"{root}/{family}")
        save_columns(summary.sparkSession, features, f"{root}/{family}_columns")
    return fitted


def predict(
    summary: DataFrame,
    matrix: DataFrame,
    cohort: DataFrame,
    root: str,
    names: Sequence[str] = AVERAGED,
    extra_scores: Sequence[DataFrame] = (),
    defaults: Mapping[str, float] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per cohort person: a probability per model, their mean and the 0/1 outcome.

    ``extra_scores`` are score tables made elsewhere (a sequence model, say); ``defaults`` gives the score of persons
    absent from such a table.
    """
    scores = []
    for family, frame in ((MATRIX, matrix), (SUMMARY, summary)):
        columns = load_columns(cohort.sparkSession, f"{root}/{family}_columns")
        models = load_models(f"{root}/{family}", names)
        if family == MATRIX and is_sparse(frame):
            scored = score_vectors(models, cell_vectors(summary, frame, columns))
        else:
            scored = score(models, align_columns(frame, columns))
        scores.append(scored.withColumnsRenamed({n: f"{n}_{family}" for n in names}))
    return ensemble(cohort, [*scores, *extra_scores], defaults, threshold)
