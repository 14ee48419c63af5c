"""Token-ID output: documents' ids one after the other in binary shards with Elias-Fano boundaries.

File format, a shard in the ``payload`` column of each row of a Parquet folder (so that Spark's committer writes it,
whichever store the folder is in): magic ``TKEF1``, a byte with the bytes per id (2 where every id fits, else 4), a
byte that is 1 if the shard's first documents have no id, the Elias-Fano code of the n + 1 boundaries, that of the
document ids, then the ids, little-endian. Shards are ordered by (``part``, ``shard``) and documents by id inside them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longfeat.llm import arrays, eliasfano
from longfeat.llm.words import WordEncoder

MAGIC = b"TKEF1"
SHARD_IDS = 1 << 20
SHARDS = "part int, shard int, base long, n_docs long, n_ids long, payload binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def pack_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard; documents without an id come first."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
    nameless = sum(d is None for d in doc_ids)
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    body = [eliasfano.encode(ends), eliasfano.encode(named), flat.astype(f"<u{width}").tobytes()]
    return MAGIC + struct.pack("<BQ", width, nameless) + b"".join(body)


def read_shard(payload: bytes) -> tuple[list[int | None], eliasfano.EliasFano, np.ndarray]:
    """(document ids, boundaries, ids as uint32)."""
    if payload[:5] != MAGIC:
        raise ValueError("not a token shard")
    width, nameless = struct.unpack_from("<BQ", payload, 5)
    ends = eliasfano.EliasFano(payload, 14)
    named = eliasfano.EliasFano(payload, ends.end)
    ids = np.frombuffer(payload, f"<u{width}", offset=named.end).astype("<u4")
    return [None] * nameless + named.all().tolist(), ends, ids


def token_shards(docs: DataFrame, path: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Encode every text and cut the run of ids into shards, in ascending order of document ids.

    Documents are range-partitioned by (id, hash of the text), so one id with many rows is spread too. A null text is
    empty (its end id remains); null ids come first; rows with one id stand side by side, ordered by their texts.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    end = struct.pack("<I", end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(path), TaskContext.get().partitionId()
        held_docs: list[int | None] = []
        held_ids: list[bytes] = []
        size = base = shard = 0

        def flush() -> pa.RecordBatch:
            row = [part, shard, base, len(held_docs), size, pack_shard(held_docs, held_ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "base", "n_docs", "n_ids", "payload"])

        for batch in batches:
            text, doc = batch.column("text"), batch.column("doc_id")
            for lo, hi in arrays.slices(text):
                for d, ids in zip(doc[lo:hi].to_pylist(), encoder.ids(text[lo:hi].to_pylist()), strict=True):
                    held_docs.append(d)
                    held_ids.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SHARD_IDS:
                        yield flush()
                        held_docs, held_ids, base, size, shard = [], [], base + size, 0, shard + 1
        if held_docs:
            yield flush()

    return ordered.select("doc_id", "text").mapInArrow(shards, SHARDS)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, parts: int | None = None) -> None:
    token_shards(docs, path, end_id, parts).write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its id, the number of ids before it, its number of ids and their CRC-32, all from the files.

    Only the totals of the parts (a row for each task that wrote) meet in one place, to be summed in order.
    """
    files = spark.read.schema(SHARDS).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, code, ids = read_shard(batch.column("payload")[row].as_py())
                ends, base = code.all(), batch.column("base")[row].as_py()
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                part = pa.array(np.full(len(crc), batch.column("part")[row].as_py(), np.int32))
                columns = [pa.array(doc_ids, pa.int64()), ends[:-1] + base, np.diff(ends), pa.array(crc, pa.int64()), part]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    found = files.select("part", "base", "payload").mapInArrow(documents, DOCUMENTS)
    return found.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
