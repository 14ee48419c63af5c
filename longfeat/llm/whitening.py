"""Whitening of embedding vectors, with the covariance by polarisation of exact integer squares.

Every entry ``c`` becomes the integer ``floor(64 c) + 1000000``. A first job sums each dimension. The second takes every
value from its dimension's mean (from the mean's integer part ``m``, the rest ``R / n`` is exact arithmetic later) and
adds up the squares of each dimension and of the sum of each pair of dimensions, as whole numbers without rounding:
``Q(i)`` and ``Q(i + j)``. As ``(a + b)^2 - a^2 - b^2 = 2ab``, the covariance is ``(Q(i + j) - Q(i) - Q(j)) / 2n``,
rounded to double once. The driver gets the d (d + 1) / 2 sums, nothing that grows with the rows, and calls ``eigh``. A
third job measures the covariance of the whitened values.

Defined results: a vector is left out if it is null, has a null or non-finite entry or one of 2^56 or more in size (no
64-bit integer holds 64 times it), or another length than most vectors (the longest at ties; empty ones never count).
Repeated rows and null ids count and come back each. A component without variance (fewer vectors than dimensions, or
all equal) has a null ``whitened`` and no part in the identity error; without any variance ``explained`` is null, and
without components with variance the error is null. A deviation beyond a long is null. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, BASE = 64, 1_000_000
MOST = 2.0**56
ROWS = 2048
LIMB = 30  # bits of a partial sum in a column
LIMBS = 6
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit columns
    trace: float

    @property
    def rank(self) -> int:
        """Components with variance, beyond rounding."""
        return int(np.count_nonzero(self.values > max(self.values, default=0) * len(self.sums) * 1e-14))

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """n times what the mean is above its integer part."""
        return [s % self.n for s in self.sums]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors as integers."""
    usable = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST)  # noqa: E731  NaN counts as larger
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", usable)
    # The optimiser may evaluate an entry before the filter, so none may overflow.
    entry = lambda c: F.when(usable(c), F.floor(c.cast("double") * SCALE) + BASE)
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine)
    sizes = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    d = sizes.first()
    return whole.where(F.size("embedding") == (d.d if d else 0)).select("vec_id", F.transform("embedding", entry).alias("x"))


def squares(z: np.ndarray) -> list[int]:
    """The sum of squares of every dimension and of every pair's sum, by (i, j) with i <= j; a pair (i, i) is i itself."""
    most = int(np.abs(z).max(initial=0))
    if 4 * most * most * max(1, len(z)) >= 2**63:
        z = z.astype(object)  # Python's integers have no bound
    out: list[int] = []
    for i in range(z.shape[1]):
        both = z[:, i : i + 1] + z[:, i + 1 :]
        out.append(int((z[:, i] * z[:, i]).sum()))
        out += [int(v) for v in (both * both).sum(axis=0)]
    return out


def pair_sums(x: DataFrame, centre: np.ndarray) -> list[int]:
    """``squares`` of all vectors, less the centre. Sums travel in parts of 30 bits, which add up without overflow."""
    d = len(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for z in rows_of(batches, d):
            got = squares(z[1] - centre)
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            parts = [pa.array([v >> LIMB * i & (1 << LIMB) - 1 for v in total], pa.int64()) for i in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *parts], ["k", *(f"p{i}" for i in range(LIMBS))])

    parts = x.mapInArrow(add, "k int, " + ", ".join(f"p{i} long" for i in range(LIMBS)))
    sums = parts.groupBy("k").agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in range(LIMBS)))
    out = [0] * (d * (d + 1) // 2)
    for row in sums.collect():
        out[row.k] = sum(row[f"p{i}"] << LIMB * i for i in range(LIMBS))
    return out


def rows_of(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of up to ``ROWS`` vectors of length d."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column("vec_id"), part.column("x").flatten().to_numpy().reshape(-1, d)


def fit(x: DataFrame) -> Fit | None:
    """Sums, covariance and components of the integer vectors; None without any."""
    each = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = sorted(each.collect())
    if not rows:
        return None
    n, sums = rows[0].n, [int(r.s) for r in rows]
    d = len(sums)
    bare = Fit(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    got = iter(pair_sums(x, bare.centre))
    rest = bare.rest
    exact = {}  # n times the sum of squared deviations: n * sum z^2 - R^2
    for i in range(d):
        for j in range(i, d):
            moved = rest[i] if i == j else rest[i] + rest[j]
            exact[i, j] = n * next(got) - moved * moved
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            value = exact[i, i] / n**2 if i == j else (exact[i, j] - exact[i, i] - exact[j, j]) / (2 * n**2)
            covariance[i, j] = covariance[j, i] = value
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1]
    return Fit(n, sums, values[order], vectors[:, order], sum(exact[i, i] for i in range(d)) / n**2)


def deviations(z: np.ndarray, fitted: Fit) -> list[int | None]:
    """The sum over dimensions of (n z - R)^2 = (n x - S)^2, exact; None beyond a long."""
    n, rest = fitted.n, np.array(fitted.rest, object)
    most = n * (int(np.abs(z).max(initial=0)) + 1)
    if z.shape[1] * most * most < 2**63:
        away = z * n - rest.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    away = z.astype(object) * n - rest
    return [int(v) if v < 2**63 else None for v in (away * away).sum(axis=1)]


def project(z: np.ndarray, fitted: Fit, most: int) -> np.ndarray:
    """The whitened values of vectors less the centre, for the first components with variance."""
    k = min(most, fitted.rank)
    away = z - np.array([r / fitted.n for r in fitted.rest])
    return away @ fitted.vectors[:, :k] / np.sqrt(fitted.values[:k])


def identity_error(x: DataFrame, fitted: Fit, most: int) -> float | None:
    """The largest absolute entry of the whitened values' measured covariance, less the identity."""
    d, k = len(fitted.sums), min(most, fitted.rank)
    if not k:
        return None
    centre = fitted.centre

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, z in rows_of(batches, d):
            white = project(z - centre, fitted, most)
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    total = np.zeros((k + 1) * k)
    for row in x.mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[row.k] = row.v
    total = total.reshape(k + 1, k) / fitted.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and
    component up to ``most``."""
    x = integers(vectors)
    fitted = fit(x)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], f"{WHITENED}, identity_error double")
    error = identity_error(x, fitted, most)
    d, k, rank = len(fitted.sums), min(most, len(fitted.sums)), min(most, fitted.rank)
    centre = fitted.centre
    shares = [float(v) / fitted.trace if fitted.trace else None for v in fitted.values[:k]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in rows_of(batches, d):
            z = x - centre
            rows = len(z)
            white = np.zeros((rows, k))
            white[:, :rank] = project(z, fitted, most)
            empty = np.zeros((rows, k), bool)
            empty[:, rank:] = True
            columns = [
                ids.take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, fitted.n), pa.int64()),
                pa.array(deviations(z, fitted), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(white.ravel(), mask=empty.ravel()),
                pa.array(shares * rows, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WHITENED.split(", ")])

    return x.mapInArrow(make, WHITENED).withColumn("identity_error", F.lit(error).cast("double"))
