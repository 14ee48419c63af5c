"""Irregular time series per person, as arrays.

A sequence comes from recent rows: one row per day inside the lookback, so an array never holds more steps than the
lookback has days.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from longfeat.operators.cohort import hash_position
from longfeat.plans.defaults import REFERENCE_POINTS, TIME_DIMENSION

BATCH_SLICES = 64
#: What a worker holds at once when it resamples: weights of so many steps, sums of so many persons.
STEPS, PERSONS = 4096, 512


def observed_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value (one row of counts comes back)."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def keep(df: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Drop the features not in ``columns`` (the list kept at fit time)."""
    gone = set(features) - set(columns)
    return df.select(*[c for c in df.columns if c not in gone])


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, lo, hi, observed) per column over all rows; limits are null for a column never observed."""
    structs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.min(F.col(c).cast("double")).alias("lo"),
            F.max(F.col(c).cast("double")).alias("hi"),
            F.count(c).alias("observed"),
        )
        for c in columns
    ]
    return df.agg(F.array(*structs).alias("stats")).select(F.inline("stats"))


def scale_masked(df: DataFrame, stats: DataFrame, columns: Sequence[str], mode: str = "max") -> DataFrame:
    """(x - lo) / hi per column (a hi of 0 counts as 1); unobserved values become 0. ``range`` divides by hi - lo.

    The statistics table has one row per feature; its limits enter as one scalar subquery.
    """
    entry = F.struct("feature", F.struct("lo", "hi"))
    limits = stats.agg(F.map_from_entries(F.collect_list(entry)).alias("limits")).scalar()
    out = {}
    for c in columns:
        lo, hi = limits[c]["lo"], limits[c]["hi"]
        width = hi if mode == "max" else hi - lo
        width = F.when(width == 0, 1.0).otherwise(width)
        out[c] = F.coalesce((F.col(c).cast("double") - lo) / width, F.lit(0.0))
    return df.withColumns(out)


def sequences(
    recent: DataFrame,
    features: Sequence[str],
    info: DataFrame | None = None,
    outcome: DataFrame | None = None,
    by: str = "day_offset",
) -> DataFrame:
    """Per person: steps, an array of (t, time, v values, m mask) in time order; plus person columns and outcome.

    ``time`` is t over the largest t of the whole table, so it does not depend on what a person is batched with.
    """
    cells = [F.col(c).cast("double") for c in features]
    values = F.array(*[F.coalesce(c, F.lit(0.0)) for c in cells])
    mask = F.array(*[F.when(c.isNull() | F.isnan(c), 0).otherwise(1) for c in cells])
    latest = recent.agg(F.max(by).alias("latest")).scalar()
    time = F.coalesce(F.try_divide(F.col(by).cast("double"), latest), F.lit(0.0))
    step = F.struct(F.col(by).alias("t"), time.alias("time"), values.alias("v"), mask.alias("m"))
    seqs = recent.groupBy("person_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    for extra in (info, outcome):
        if extra is not None:
            seqs = seqs.join(extra, "person_id", "left")
    return seqs


def flatten_steps(seqs: DataFrame, features: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Back to rows: person_id, step number, t, one value column and one mask column per feature."""
    rows = seqs.select("person_id", *carry, F.posexplode("steps").alias("step", "s"))
    columns = [F.col("s.v")[i].alias(f) for i, f in enumerate(features)]
    masks = [F.col("s.m")[i].alias(f"{f}_seen") for i, f in enumerate(features)]
    return rows.select("person_id", *carry, "step", F.col("s.t").alias("t"), *columns, *masks)


def longest(seqs: DataFrame) -> Column:
    return seqs.agg(F.max(F.size("steps")).alias("n")).scalar()


def pad_sequences(seqs: DataFrame, features: Sequence[str], length: int | None = None) -> DataFrame:
    """Arrays of equal length: values, mask (arrays per step) and time, zero-padded on the right.

    The default length is the longest of the whole table. A sequence longer than a given ``length`` is an error when
    the plan runs: no step is ever cut off.
    """
    size = longest(seqs)
    if length is not None:
        short = F.concat(F.lit(f"a sequence is longer than the length {length}: "), F.size("steps").cast("string"))
        size = F.when(F.size("steps") > length, F.raise_error(short).cast("int")).otherwise(F.lit(length))
    fill = F.greatest(size - F.size("steps"), F.lit(0)).cast("int")
    zeros = F.array(*[F.lit(0.0) for _ in features])
    unseen = F.array(*[F.lit(0) for _ in features])

    def padded(values: Column, filler: Column) -> Column:
        return F.concat(values, F.array_repeat(filler, fill))

    return seqs.select(
        "person_id",
        padded(F.transform("steps", lambda s: s["v"]), zeros).alias("v"),
        padded(F.transform("steps", lambda s: s["m"]), unseen).alias("m"),
        padded(F.transform("steps", lambda s: s["time"]), F.lit(0.0)).alias("t"),
    )


def batch_sequences(seqs: DataFrame, size: int, key: str = "person_id", seed: int = 0) -> DataFrame:
    """The sequences with ``batch`` and ``batch_length``: ``size`` sequences to a batch, in order of length.

    Sequences of like length share a batch, so padding to the longest of a batch adds few cells; those of equal length
    are shuffled by a seeded hash of the person. The number in that order is exact without sorting everything in one
    task: sequences are counted by (length, slice of the hash range), at most longest x ``BATCH_SLICES`` rows whose
    running counts are offsets, and ranked inside their own slice. A null sequence counts as empty. The last batch
    may be smaller.
    """
    place = hash_position(key, seed)
    sized = seqs.withColumns({"__length": F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0)), "__place": place})
    sized = sized.withColumn("__slice", F.floor(F.col("__place") / (2**32 // BATCH_SLICES)).cast("int"))
    counts = sized.groupBy("__length", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    # A length's slices are summed in its own group; only one row for each length meets in one task.
    lengths = counts.groupBy("__length").agg(F.sum("__n").alias("__all"))
    shorter = Window.orderBy("__length").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("__length", F.coalesce(F.sum("__all").over(shorter), F.lit(0)).alias("__shorter"))
    earlier = Window.partitionBy("__length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(lengths, "__length")
    inside = F.row_number().over(Window.partitionBy("__length", "__slice").orderBy("__place", key))
    ranked = sized.withColumn("__inside", inside).join(slices.drop("__n"), ["__length", "__slice"])
    number = F.col("__shorter") + F.col("__before") + F.col("__inside") - 1
    placed = ranked.withColumn("batch", F.floor(number / F.lit(size)))
    longest_of = placed.groupBy("batch").agg(F.max("__length").alias("batch_length"))
    return placed.join(longest_of, "batch").select(*seqs.columns, "batch", "batch_length")


def pad_batches(batched: DataFrame, features: Sequence[str], key: str = "person_id") -> DataFrame:
    """Sequences of ``batch_sequences`` as arrays of their batch's length: v, m and t, zero-padded on the right.

    ``t`` is the step's time over the largest time of the batch (0 where that is 0): what a sequence is batched with
    sets its time scale, as batches of a trainer do. Steps carry absolute ``t``.
    """
    last = F.coalesce(F.array_max(F.transform("steps", lambda s: s["t"])), F.lit(0)).cast("double")
    latest = batched.groupBy("batch").agg(F.max(last).alias("__latest"))
    joined = batched.join(latest, "batch")
    fill = (F.col("batch_length") - F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0))).cast("int")
    steps = F.coalesce("steps", F.array().cast(batched.schema["steps"].dataType))
    zeros, unseen = F.array(*[F.lit(0.0) for _ in features]), F.array(*[F.lit(0) for _ in features])
    time = lambda s: F.coalesce(F.try_divide(s["t"].cast("double"), F.col("__latest")), F.lit(0.0))
    return joined.select(
        key,
        "batch",
        "batch_length",
        F.concat(F.transform(steps, lambda s: s["v"]), F.array_repeat(zeros, fill)).alias("v"),
        F.concat(F.transform(steps, lambda s: s["m"]), F.array_repeat(unseen, fill)).alias("m"),
        F.concat(F.transform(steps, time), F.array_repeat(F.lit(0.0), fill)).alias("t"),
    )


def resample_kernel(
    seqs: DataFrame, features: Sequence[str], points: int = REFERENCE_POINTS, dim: int = TIME_DIMENSION
) -> DataFrame:
    """Resample every sequence onto ``points`` evenly spaced times in [0, 1] by a softmax over observed steps.

    The score of two times is the scaled dot product of their sin/cos embeddings. The steps of an Arrow batch lie in
    flat arrays: one matrix product of the reference times' and the steps' embeddings gives all weights of ``STEPS``
    steps at a time, and sums over each person's own columns end it, so no row of (step, point) is ever made and no
    shuffle follows the one that built the sequences. A person's sums run on over slices, so memory does not grow with
    a sequence. A point without an observed step is 0; a person without steps has no rows.
    """
    # The embedding stretches time by 48 and spaces its frequencies over a factor of 10.
    frequencies = np.array([48.0 * math.exp(-2 * j * math.log(10.0) / dim) for j in range(dim // 2)])
    grid = np.arange(points) / float(max(points - 1, 1))
    width = len(features)

    def embed(times: np.ndarray) -> np.ndarray:
        angles = np.outer(times, frequencies)
        return np.concatenate([np.cos(angles), np.sin(angles)], axis=1)

    reference = embed(grid) / math.sqrt(dim)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PERSONS):
                batch = whole.slice(lo, PERSONS)
                size = batch.column("size").to_numpy()
                ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                time = batch.column("time").flatten().to_numpy(zero_copy_only=False)
                v, m = (batch.column(c).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("v", "m"))
                top, below = np.zeros((2, len(size), points, width))
                for begin in range(0, len(time), STEPS):
                    stop = min(begin + STEPS, len(time))
                    weight = np.exp(reference @ embed(time[begin:stop]).T)
                    first, last = np.searchsorted(ends, begin, "right") - 1, np.searchsorted(ends, stop, "left")
                    own = np.arange(first, last)
                    own = own[size[own] > 0]
                    cuts = np.maximum(ends[own], begin) - begin
                    for f in range(width):
                        seen = weight * m[begin:stop, f]
                        below[own, :, f] += np.add.reduceat(seen, cuts, axis=1).T
                        top[own, :, f] += np.add.reduceat(seen * v[begin:stop, f], cuts, axis=1).T
                has = np.flatnonzero(size > 0)
                got = np.divide(top, below, out=np.zeros_like(top), where=below > 0)[has].reshape(-1, width)
                ids = batch.column("person_id").take(pa.array(np.repeat(has, points)))
                columns = [ids, pa.array(np.tile(np.arange(points, dtype=np.int32), len(has))), pa.array(np.tile(grid, len(has)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(got[:, f])) for f in range(width))], schema.names)

    part = lambda name: F.transform("steps", lambda s: s[name])
    flat = seqs.where(F.size("steps") > 0).select("person_id", F.size("steps").alias("size"), part("time").alias("time"), part("v").alias("v"), part("m").alias("m"))
    schema = T.StructType(
        [
            flat.schema["person_id"],
            T.StructField("point", T.IntegerType()),
            T.StructField("time", T.DoubleType()),
            *(T.StructField(f, T.DoubleType()) for f in features),
        ]
    )
    return flat.mapInArrow(resample, schema)
