"""Evaluation of scored rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


AREA_BUCKETS = 1024


def area_under_roc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): the exact area under the ROC curve of each group, ties by half, as a lazy aggregate.

    Rows are combined to distinct scores first. The area needs the negatives below each score: scores fall into buckets
    by a rising function, running counts over the buckets (``AREA_BUCKETS`` a group at most) and inside each bucket
    add up, so no group is sorted in one task. NaN is the highest score; rows without label or score are left out; a
    group with one class has no area (null).
    """
    by = list(by)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    hit = F.count_if(F.col(label) == 1)
    counts = rows.groupBy(*by, F.col(score).cast("double").alias("__score")).agg(hit.alias("__pos"), (F.count(F.lit(1)) - hit).alias("__neg"))
    place = F.floor((F.atan("__score") / math.pi + 0.5) * AREA_BUCKETS)
    counts = counts.withColumn("__bucket", F.when(F.isnan("__score"), AREA_BUCKETS + 1).otherwise(place))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*by, "__bucket").agg(F.sum("__neg").alias("__in"))
    buckets = buckets.select(*by, "__bucket", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__below"))
    lower = Window.partitionBy(*by, "__bucket").orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("__inside", F.coalesce(F.sum("__neg").over(lower), F.lit(0)))
    if by:
        same = reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "__bucket"]))
        placed = inside.alias("x").join(buckets.alias("y"), same).select("x.*", "y.__below")
    else:
        placed = inside.join(F.broadcast(buckets), "__bucket")
    pairs = F.sum(F.col("__pos") * (F.col("__below") + F.col("__inside") + F.col("__neg") / 2))
    area = F.try_divide(pairs, F.sum("__pos").cast("double") * F.sum("__neg"))
    return placed.groupBy(*by).agg(area.alias("auc"))


def log_loss(label: Column, score: Column, eps: float = 1e-15) -> Column:
    """Mean cross-entropy of probabilities against 0/1 labels (an aggregate)."""
    p = F.greatest(F.least(score, F.lit(1 - eps)), F.lit(eps))
    y = label.cast("double")
    return -F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def confusion(label: Column, score: Column, threshold: float = 0.5) -> dict[str, Column]:
    hit, said = label == 1, score > threshold
    return {
        "tp": F.count_if(hit & said),
        "fp": F.count_if(~hit & said),
        "fn": F.count_if(hit & ~said),
        "tn": F.count_if(~hit & ~said),
    }


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, auc: bool = True) -> DataFrame:
    """One row: counts, accuracy, recall and precision (0 when undefined), cross-entropy and, if asked, ROC area."""
    y, p = F.col(label), F.col(score)
    cells = [c.alias(n) for n, c in confusion(y, p, threshold).items()]
    row = df.agg(*cells, log_loss(y, p).alias("log_loss"))
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    row = row.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "recall": ratio(tp, tp + fn),
            "precision": ratio(tp, tp + fp),
        }
    )
    return row.withColumn("auc", area_under_roc(df, label, score).scalar()) if auc else row


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(class, precision, recall, f1, support) for classes 0 and 1."""
    row = df.agg(*[c.alias(n) for n, c in confusion(F.col(label), F.col(score), threshold).items()])
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def line(cls: int, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(cls).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).cast("bigint").alias("support"),
        )

    return row.select(F.inline(F.array(line(0, tn, fn, fp), line(1, tp, fp, fn))))


def masked_mse(df: DataFrame, x: str, y: str, mask: str) -> DataFrame:
    """One row: sum(m (x - y)^2) / sum(m)."""
    m = F.col(mask).cast("double")
    error = F.col(x).cast("double") - F.col(y).cast("double")
    return df.agg(F.try_divide(F.sum(m * error * error), F.sum(m)).alias("mse"))


def candidate_losses(df: DataFrame, label: str, scores: Mapping[str, str]) -> DataFrame:
    """(candidate, loss), lowest loss first, for several score columns in one aggregate."""
    lines = F.array(
        *[F.struct(F.lit(n).alias("candidate"), F.col(f"_{i}").alias("loss")) for i, n in enumerate(scores)]
    )
    losses = df.agg(*[log_loss(F.col(label), F.col(c)).alias(f"_{i}") for i, c in enumerate(scores.values())])
    return losses.select(F.inline(lines)).orderBy("loss", "candidate")
