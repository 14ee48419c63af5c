"""Joins that hold when one key carries a large share of the rows.

A lookup side is broadcast only after its size in bytes was checked against a bound. Beyond the bound, and wherever
the side with the hot key cannot be split by Spark itself, heavy keys are treated apart: a key with more than
``ROWS_PER_TASK`` rows is spread over as many salts as it has times that many rows, and only its partners are repeated.
All other rows join once. Every way gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
ROWS_PER_TASK = 1_000_000
#: Heavy keys that travel to the driver and back; with more of them the limit of rows per task is raised.
HEAVY_KEYS = 10_000
SALT_SAFE = {"inner", "left", "left_semi", "left_anti"}


def size_bytes(df: DataFrame) -> int:
    """Rows times their widths (texts by their bytes, other fields as 8, 16 for the row), one distributed aggregate."""
    width = F.lit(16)
    for field in df.schema:
        text = isinstance(field.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 8 if text else F.lit(8))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the frame is at most ``max_bytes`` large."""
    return size_bytes(df) <= max_bytes


def heavy_keys(
    df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK, most: int = HEAVY_KEYS
) -> DataFrame | None:
    """(keys, _copies) of the keys with more than ``rows_per_task`` rows, or None if there is none.

    At most ``most`` of them: with more, the limit is raised until they are few, so the table is always small.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    for c in on:
        counts = counts.where(F.col(c).isNotNull())
    found = counts.where(F.col("_n") > rows_per_task).limit(most + 1).collect()
    if len(found) > most:
        return heavy_keys(df, on, rows_per_task * 10, most)
    if not found:
        return None
    rows = [(*(r[c] for c in on), -(-r["_n"] // rows_per_task)) for r in found]
    schema = T.StructType([*(df.schema[c] for c in on), T.StructField("_copies", T.IntegerType())])
    return df.sparkSession.createDataFrame(rows, schema)


def _spread(df: DataFrame, heavy: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds the salt of each row: 0, or for a heavy key a hash of ``by`` within its copies; repeatable."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.coalesce("_copies", F.lit(1))).cast("int")
    return df.join(F.broadcast(heavy), list(on), "left").withColumn("_salt", salt).drop("_copies")


def _repeat(df: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each row once for every salt of its key."""
    salts = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    return df.join(F.broadcast(heavy), list(on), "left").withColumn("_salt", F.explode(salts))


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Equi-join whose large left side may hold heavy keys; a plain join if it has none."""
    if how not in SALT_SAFE:
        raise ValueError(f"salted_join cannot keep {how!r} exact")
    heavy = heavy_keys(big, on, rows_per_task)
    if heavy is None:
        return big.join(small, list(on), how)
    right = _repeat(small, heavy, on).drop("_copies")
    return _spread(big, heavy, on, spread_by).join(right, [*on, "_salt"], how).drop("_salt")


def spread_left_join(
    left: DataFrame, big: DataFrame, on: Sequence[str], spread_by: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Left join whose *right* side may hold heavy keys, which Spark cannot split there.

    Left rows of heavy keys are repeated once per salt; a repeat that finds nothing is dropped, because its key is
    known to match elsewhere. Without heavy keys it is a plain left join.
    """
    heavy = heavy_keys(big, on, rows_per_task)
    if heavy is None:
        return left.join(big, list(on), "left")
    spread = _spread(big, heavy, on, spread_by).withColumn("_hit", F.lit(True))
    joined = _repeat(left, heavy, on).join(spread, [*on, "_salt"], "left")
    return joined.where(F.col("_hit") | F.col("_copies").isNull()).drop("_salt", "_copies", "_hit")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    small_fits: bool | None = None,
) -> DataFrame:
    """Join to a lookup table: broadcast within the checked bound, heavy-key join beyond it.

    ``small_fits`` is the verdict of an earlier check of a table that bounds this one; None checks ``small`` itself.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits(small) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), keys, how)
    spread = list(spread_by) or [c for c in big.columns if c not in keys]
    return salted_join(big, small, keys, how, spread)
