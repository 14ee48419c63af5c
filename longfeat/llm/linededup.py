r"""Lines that several documents share, dropped from all documents but the one with the smallest id.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. Lines are exploded to 128-bit
hashes of their keys, counted over distinct documents (first and last id per hash, combined before the shuffle), and
each text loses the lines whose key belongs to an earlier document. A null text is one empty line. Documents without
an id neither hold nor lose lines. Rows that share an id count as one document. Input columns pass through; one named
like an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.sources.storage import materialize

WHITE = b" \t\n\x0b\x0c\r"
OUT = ["n_lines", "n_dropped"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The hash of a line's key; None where the key is shorter than ``least`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def shared_lines(docs: DataFrame, least: int = 10, most_docs: int = 1) -> DataFrame:
    """(doc_id, text_hash, keys): the hashes that a text loses, as they are in over ``most_docs`` documents.

    ``docs`` has doc_id, text_hash and text. With the default the first holder keeps its lines; a larger limit keeps
    that rule but spares lines up to the limit.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                keys = {line_key(x, least) for x in (text or b"").split(b"\n")} - {None}
                rows += [i] * len(keys)
                found += keys
            ids = batch.select(["doc_id", "text_hash"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(found, pa.binary())], ["doc_id", "text_hash", "key"])

    keyed = docs.where("doc_id is not null").mapInArrow(explode, "doc_id long, text_hash long, key binary")
    first = F.min("doc_id").alias("first")
    if most_docs == 1:
        shared = keyed.groupBy("key").agg(first, F.max("doc_id").alias("last")).where("first < last")
    else:
        apart = keyed.select("key", "doc_id").distinct()
        shared = apart.groupBy("key").agg(first, F.count("*").alias("n")).where(F.col("n") > most_docs)
    # Written, so that both sides of the join come straight from a shuffle and Spark may split a very common line there.
    lost = keyed.join(materialize(shared.select("key", "first"), "lines"), "key").where("doc_id > first")
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))


def drop_shared_lines(docs: DataFrame, least: int = 10, most_docs: int = 1) -> DataFrame:
    """The documents with their remaining lines as ``text``, and ``n_lines`` before and ``n_dropped``."""
    kept = [c for c in docs.columns if c not in (*OUT, "text")]
    base = docs.select(*kept, "text", F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__hash"))
    lost = shared_lines(base.select(F.col("__doc").alias("doc_id"), F.col("__hash").alias("text_hash"), "text"), least, most_docs)
    lost = lost.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("keys").alias("__keys"))
    joined = base.join(lost, ["__doc", "__hash"], "left").select(*kept, "text", "__keys")
    added = [T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in OUT)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column("text").cast(pa.binary()), batch.column("__keys"), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                gone = set(lost.as_py() or ())
                left = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                texts.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], [*kept, "text", *OUT])

    return joined.mapInArrow(assemble, schema)
