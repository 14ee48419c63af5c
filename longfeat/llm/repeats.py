"""Windows of symbols (bytes or words) that also start in a document with a smaller id: search, routing and removal.

1. Each text is cut into *pieces*: runs of windows that share a minimiser, the *anchor*. Equal windows have equal
   anchors, so only pieces of one anchor need be compared.
2. Documents are hashed into blocks. A block sends, for each distinct (anchor, piece) in it, short hashes and its
   smallest document to the anchor's bucket; buckets answer with one status byte each. That settles every piece that
   stands unchanged in an earlier document (by the anchor's hash, which grows with the input, and 64 bits of the
   piece's own) and every anchor that only one document has.
3. Pieces that differ from others of their anchor are *contested*: their texts go to their anchor, where the operator's
   own method compares them. An anchor with very many different pieces is *hot*: its windows are exploded, combined
   before the shuffle and joined, so no group of unbounded size meets in a task.
4. Spans return to their documents, which lose the symbols under them.

Defined results: a null or short text has no window; a document without an id is kept whole and is no reference; rows
that share an id count as one document (equal rows are never each other's reference); other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.llm import arrays
from longfeat.sources.storage import fresh_path

BLOCK_BYTES = 4 << 20
BATCH_BYTES = 1 << 20

UNIQUE, EARLIER, CONTESTED, HOT = range(4)
STATES = "kind byte, doc long, h long, anchor long, w2 long, start int, body binary, spans binary, n long, n_removed long, n_spans long, sha256 string"
RESULT = "doc_id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string, kept binary"

Spans = list[tuple[int, int]]
#: (anchors, documents, bodies) of whole anchor groups, sorted by (anchor, document) -> (piece, first window, end) arrays.
Mark = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how long a window, how long the grams that anchor it.

    More than ``many`` different pieces of an anchor, or than ``many_in_block`` in one block, make it hot.
    """

    words: bool
    window: int = 50
    gram: int = 24
    many: int = 4096
    many_in_block: int = 4096

    def plain(self, text: bytes) -> bytes:
        """The text in the form that spans refer to."""
        return b" ".join(text.split()) if self.words else text

    def size(self, text: bytes) -> int:
        return (text.count(b" ") + 1 if text else 0) if self.words else len(text)

    def without(self, text: bytes, spans: Spans) -> bytes:
        symbols = text.split(b" ") if self.words and text else text
        kept, at = [], 0
        for a, b in spans:
            kept.append(symbols[at:a])
            at = b
        kept.append(symbols[at:])
        return b" ".join(w for part in kept for w in part) if self.words else b"".join(kept)


@dataclass
class Pieces:
    """The pieces of some plain texts; ``begin`` and ``stop`` are byte places of symbols."""

    data: np.ndarray
    begin: np.ndarray | None
    stop: np.ndarray | None
    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    first: np.ndarray
    anchor: np.ndarray
    phrase: np.ndarray

    def bytes_of(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of n symbols from symbol ``first``."""
        if self.begin is None:
            return first, first + n
        return self.begin[first], self.stop[first + n - 1]


def cut(plain: list[bytes], unit: Unit) -> Pieces:
    data = np.frombuffer(b"".join(plain), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in plain], dtype=np.int64)])
    begin = stop = None
    if unit.words:
        begin, stop, ends = arrays.words(data, ends)
        grams = arrays.gram_hashes(arrays.fingerprints(data, begin, stop), unit.gram)
    else:
        grams = arrays.byte_grams(data, unit.gram)
    first, count, at = arrays.anchored_runs(grams, unit.gram, unit.window, ends)
    text = np.searchsorted(ends, first, "right") - 1
    made = Pieces(data, begin, stop, text, first - ends[text], count, first, grams[at], np.zeros(0, np.uint64))
    made.phrase = arrays.fingerprints(data, *made.bytes_of(first, count + unit.window - 1))
    return made


def some(texts: list[bytes], limit: int = arrays.SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


@dataclass(frozen=True)
class Shape:
    """2**bits buckets; bytes of an anchor's hash that are sent besides its bucket. A piece's hash is sent whole."""

    bits: int
    key: int

    @classmethod
    def of(cls, total: int, block_bytes: int) -> Shape:
        """Anchors take 10 bits more than the text has bytes, so chance meetings stay below one in a thousand."""
        bits = (total // block_bytes).bit_length()
        return cls(bits, max(4, -(-(total.bit_length() + 10 - bits) // 8)))


def entries(anchor: np.ndarray, phrase: np.ndarray, doc: np.ndarray, shape: Shape, most: int) -> dict[str, np.ndarray]:
    """The distinct (anchor, phrase) of a block in a fixed order, with their smallest document.

    ``which`` maps pieces to entries, ``sent`` marks the ones that go to buckets (of a hot anchor only the first few).
    """
    key = anchor >> np.uint64(shape.bits) & np.uint64((1 << 8 * shape.key) - 1)
    bucket = (anchor & np.uint64((1 << shape.bits) - 1)).astype(np.int64)
    order = np.lexsort((doc, phrase, key, bucket))
    b, k, v, d = bucket[order], key[order], phrase[order], doc[order]
    new_anchor = np.ones(len(k), bool)
    new_anchor[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    new = new_anchor.copy()
    new[1:] |= v[1:] != v[:-1]
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    group = np.cumsum(new_anchor)[at] - 1
    rank = np.arange(len(at)) - np.flatnonzero(new_anchor[at])[group] if len(at) else group
    many = (np.bincount(group) > most)[group] if len(at) else np.zeros(0, bool)
    return {"bucket": b[at], "key": k[at], "value": v[at], "doc": d[at], "which": which, "many": many, "sent": ~many | (rank < most)}


def pack_entries(e: dict[str, np.ndarray], at: np.ndarray, least: int, shape: Shape) -> bytes:
    """A bit for each hot anchor's entry, then anchor, piece, document less the block's smallest in the bytes they take."""
    delta = (e["doc"][at] - least).astype(np.uint64)
    width = max(1, -(-int(delta.max()).bit_length() // 8)) if len(delta) else 1
    parts = [(e["key"][at], shape.key), (e["value"][at], 8), (delta, width)]
    columns = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n] for x, n in parts]
    return np.int64(least).tobytes() + np.packbits(e["many"][at]).tobytes() + np.concatenate(columns, axis=1).tobytes()


def read_entries(payload: bytes, n: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flags = -(-n // 8)
    many = np.unpackbits(np.frombuffer(payload, np.uint8, flags, 8), count=n).astype(bool)
    rows = np.frombuffer(payload, np.uint8, offset=8 + flags).reshape(n, -1)

    def number(a: int, b: int) -> np.ndarray:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : b - a] = rows[:, a:b]
        return wide.view("<u8").ravel()

    split = shape.key + 8
    doc = number(split, rows.shape[1]).astype(np.int64) + np.frombuffer(payload, "<i8", 1)[0]
    return number(0, shape.key), number(shape.key, split), doc, many


class Block:
    """The texts of one block with their pieces' entries; made alike by both passes over it."""

    def __init__(self, table: pa.Table, unit: Unit, shape: Shape) -> None:
        self.unit = unit
        self.doc = table.column("doc").to_pylist()
        self.h = table.column("h").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.plain = [unit.plain(x or b"") for x in texts]
        # A text without an id takes no part.
        self.used = [x if d is not None else b"" for x, d in zip(self.plain, self.doc, strict=True)]
        self.ranges = list(some(self.used))
        parts = []
        doc = np.array([d or 0 for d in self.doc], np.int64)
        for lo, hi in self.ranges:
            made = cut(self.used[lo:hi], unit)
            parts.append((made.text + lo, made.start, made.count, made.anchor, made.phrase))
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.text, self.start, self.count, self.anchor, self.phrase = map(np.concatenate, zip(*parts, empty, strict=True))
        self.docs = doc[self.text]
        self.entries = entries(self.anchor, self.phrase, self.docs, shape, unit.many_in_block)


def index(unit: Unit, shape: Shape) -> Callable[[pa.Table], pa.Table]:
    """A block's entries, a row for each bucket."""

    def send(table: pa.Table) -> pa.Table:
        e = Block(table, unit, shape).entries
        at = np.flatnonzero(e["sent"])
        bucket = e["bucket"][at]
        begin = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(at) else at
        stop = np.append(begin[1:], len(at)) if len(at) else at
        least = int(e["doc"].min()) if len(at) else 0
        payload = [pack_entries(e, at[a:b], least, shape) for a, b in zip(begin, stop, strict=True)]
        block = pa.array([table.column("block")[0].as_py()] * len(begin), pa.int64())
        return pa.table([pa.array(bucket[begin], pa.int64()), block, pa.array(stop - begin, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "block", "n", "payload"])

    return send


def answer(unit: Unit, shape: Shape) -> Callable[[pa.Table], pa.Table]:
    """A bucket's statuses, a row of them for each block that asked."""
    return lambda table: statuses(table, shape, unit.many)


def statuses(table: pa.Table, shape: Shape, most: int) -> pa.Table:
    n = table.column("n").to_pylist()
    got = [read_entries(p, m, shape) for p, m in zip(table.column("payload").to_pylist(), n, strict=True)]
    key, value, doc, many = map(np.concatenate, zip(*got, strict=True))
    order = np.lexsort((doc, value, key))
    k, v, d = key[order], value[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= v[1:] != v[:-1]
    heads, piece = np.flatnonzero(new_key), np.cumsum(new) - 1
    group = np.cumsum(new_key) - 1
    pieces = np.add.reduceat(new.astype(np.int64), heads)
    is_many = np.maximum.reduceat(many[order].astype(np.int8), heads) > 0
    # Entries hold a block's smallest document only, so one document here can still stand for several of a hot anchor.
    shared = (np.maximum.reduceat(d, heads) > np.minimum.reduceat(d, heads)) | is_many
    hot = is_many | (pieces > most)
    first_doc = d[np.flatnonzero(new)][piece]
    status = np.where(hot, HOT, np.where(pieces > 1, CONTESTED, UNIQUE))[group]
    status = np.where(shared[group], np.where(d > first_doc, EARLIER, status), UNIQUE).astype(np.uint8)
    back = np.empty(len(k), np.uint8)
    back[order] = status
    ends = np.cumsum(n).tolist()
    payload = [zlib.compress(back[a:b].tobytes(), 1) if back[a:b].any() else b"" for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    reply = pa.table([table.column("bucket"), table.column("block"), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])
    return reply.filter(pa.array([bool(p) for p in payload]))


def merged(spans: np.ndarray) -> Spans:
    """Overlapping or touching spans joined, in order."""
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return list(zip(spans[at, 0].tolist(), reach[np.append(at[1:], len(spans)) - 1].tolist(), strict=True))


def copies(at: np.ndarray, made: Pieces, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(first place, starts of all) of the pieces ``at`` that are the same in one text, so that each goes out once."""
    at = at[np.lexsort((made.start[at], which[at], made.text[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (which[at[1:]] != which[at[:-1]]) | (made.text[at[1:]] != made.text[at[:-1]])
    edges = np.append(np.flatnonzero(new), len(at)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(at[a]), made.start[at[a:b]].astype("<i4").tobytes()


def settle(unit: Unit, shape: Shape, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block and its answers: finished documents, open ones, contested pieces and windows of hot anchors."""

    def states(docs: pa.Table, replies: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in STATES.split(", ")]
        block = Block(docs, unit, shape)
        e = block.entries
        status = np.where(e["sent"], UNIQUE, HOT).astype(np.uint8)
        asked = np.flatnonzero(e["sent"])
        bucket = e["bucket"][asked]
        for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            status[asked[lo:hi]] = np.frombuffer(zlib.decompress(payload), np.uint8)
        state = status[e["which"]]
        # The same piece in an earlier document of this block settles it too.
        state[block.docs > e["doc"][e["which"]]] = EARLIER
        order = np.argsort(block.text, kind="stable")
        edges = np.searchsorted(block.text[order], np.arange(len(block.doc) + 1))
        is_open = np.zeros(len(block.doc), bool)
        is_open[block.text[(state == CONTESTED) | (state == HOT)]] = True
        rows: list[tuple] = []
        for i, plain in enumerate(block.plain):
            mine = order[edges[i] : edges[i + 1]]
            mine = mine[state[mine] == EARLIER]
            spans = np.stack([block.start[mine], block.start[mine] + block.count[mine] + unit.window - 1], axis=1)
            done = merged(spans)
            if is_open[i]:
                packed = np.array(done, "<i8").tobytes()
                rows.append((1, block.doc[i], block.h[i], None, None, None, plain, packed, None, None, None, None))
            else:
                rows.append((0, block.doc[i], block.h[i], None, None, None, *finish(unit, plain, done, with_text)))
        for lo, hi in block.ranges:
            made = cut(block.used[lo:hi], unit)
            here = (block.text >= lo) & (block.text < hi)
            for at, places in copies(np.flatnonzero(state[here] == CONTESTED), made, e["which"][here]):
                i = int(made.text[at]) + lo
                a, b = made.bytes_of(made.first[at], made.count[at] + unit.window - 1)
                body = made.data[a:b].tobytes()
                rows.append((2, block.doc[i], block.h[i], int(made.anchor[at].view(np.int64)), None, int(made.start[at]), body, places, *[None] * 4))
            hot = np.flatnonzero(state[here] == HOT)
            each = np.repeat(hot, made.count[hot])
            step = np.arange(len(each)) - np.repeat(np.cumsum(made.count[hot]) - made.count[hot], made.count[hot])
            a, b = made.bytes_of(made.first[each] + step, np.full(len(each), unit.window))
            w1 = arrays.fingerprints(made.data, a, b).view(np.int64).tolist()
            w2 = arrays.fingerprints(made.data, a, b, arrays._OTHER).view(np.int64).tolist()
            text, start = (made.text[each] + lo).tolist(), (made.start[each] + step).tolist()
            rows += [(3, block.doc[i], block.h[i], x, y, s, *[None] * 6) for i, x, y, s in zip(text, w1, w2, start, strict=True)]
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 3, pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return states


def finish(unit: Unit, plain: bytes, spans: Spans, with_text: bool) -> tuple:
    """(body, spans, n, n_removed, n_spans, sha256) of a document whose spans are final."""
    kept = unit.without(plain, spans) if spans else plain
    body = kept if with_text else None
    return body, None, unit.size(plain), sum(b - a for a, b in spans), len(spans), sha256(kept).hexdigest()


def compare(pieces: DataFrame, unit: Unit, mark: Mark) -> DataFrame:
    """Spans of contested pieces: whole anchor groups meet, in batches of about ``BATCH_BYTES``.

    A group has ``unit.many`` different pieces at most, each once for a text with all its ``spans`` (starts) there, and
    equal ones of later documents are settled before, so a batch is bounded.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            bodies = table.column("body").to_pylist()
            piece, a, b = mark(table.column("anchor").to_numpy(), table.column("doc").to_numpy(), bodies)
            starts = [np.frombuffer(x, "<i4") for x in table.column("spans").to_pylist()]
            n = np.array([len(x) for x in starts], np.int64)[piece]
            start = np.concatenate([*(starts[p] for p in piece.tolist()), np.zeros(0, np.int32)]).astype(np.int64)
            piece, a, b = np.repeat(piece, n), np.repeat(a, n), np.repeat(b, n)
            found = table.select(["doc", "h"]).take(pa.array(piece)).combine_chunks()
            columns = [found.column("doc"), found.column("h"), start + a, start + b + unit.window - 1]
            arrow = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(arrow, ["doc", "h", "a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH_BYTES:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1]))
                if whole:
                    yield run(table.slice(0, whole))
                    rest = table.slice(whole).combine_chunks()
                    held = rest.to_batches()
                    size = rest.nbytes if rest.num_rows < unit.many else 0
        if held:
            yield run(pa.Table.from_batches(held))

    sorted_pieces = pieces.select("anchor", "doc", "h", "start", "spans", "body").repartition("anchor").sortWithinPartitions("anchor", "doc", "h", "start")
    return sorted_pieces.mapInArrow(spans, "doc long, h long, a long, b long")


def earlier_windows(windows: DataFrame, window: int) -> DataFrame:
    """Spans of single windows: equal ones are combined to their smallest document before the shuffle, then joined."""
    first = windows.groupBy("anchor", "w2").agg(F.min("doc").alias("first"))
    late = windows.join(first, ["anchor", "w2"]).where("doc > first")
    return late.select("doc", "h", F.col("start").cast("long").alias("a"), (F.col("start") + window).cast("long").alias("b"))


def remove_repeats(
    docs: DataFrame, unit: Unit, mark: Mark, with_text: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_symbols, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: a row for each input row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, total // block_bytes)
    shape = Shape.of(total, block_bytes)
    doc = F.col("doc_id").cast("long").alias("doc")
    keyed = docs.select(doc, F.xxhash64("text").alias("h"), "text")
    keyed = keyed.select(F.pmod(F.xxhash64("doc", "h"), F.lit(n_blocks)).alias("block"), "doc", "h", "text")
    sent = keyed.groupBy("block").applyInArrow(index(unit, shape), "bucket long, block long, n int, payload binary")
    replies = sent.groupBy("bucket").applyInArrow(answer(unit, shape), "bucket long, block long, payload binary")
    states = keyed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settle(unit, shape, with_text), STATES)
    folder = fresh_path(docs.sparkSession, "repeats")
    states.write.option("compression", "zstd").parquet(folder)
    states = docs.sparkSession.read.schema(STATES).parquet(folder)
    contested = compare(states.where("kind = 2"), unit, mark)
    found = contested.union(earlier_windows(states.where("kind = 3"), unit.window))
    spans = found.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    waiting = states.where("kind = 1").select("doc", "h", "body", "spans").join(spans, ["doc", "h"], "left")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                known = np.frombuffer(row["spans"], "<i8").reshape(-1, 2)
                new = np.array([(x["a"], x["b"]) for x in row["found"] or ()], np.int64).reshape(-1, 2)
                body, _, *rest = finish(unit, row["body"], merged(np.concatenate([known, new])), with_text)
                rows.append((row["doc"], *rest, body))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    closed = waiting.mapInArrow(close, RESULT)
    done = states.where("kind = 0").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_symbols"), "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"), F.col("body").alias("kept"))
    return done.unionByName(closed)
