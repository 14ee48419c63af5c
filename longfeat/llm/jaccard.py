"""Near-duplicate documents by n-gram Jaccard similarity: a parity-sketch join with exact verification.

Sketch. A document's distinct word shingles are hashed to the chunks of a sketch, 64 bits a chunk, and each chunk holds
the XOR of its shingles' hashes. Two sketches differ in no more chunks than the sets differ in shingles, so a pair at the
threshold, whose sets differ in ``d`` shingles at most, agrees on all but ``d`` chunks (pigeonhole); there are half as
many more. ``d`` depends on the sizes: documents are joined in size bands, each with its own number of chunks, and a
document also enters the band of the largest partner it can have. Where ``d`` is 0 only equal sets link. A second sketch
of 1024 parity bits, one flipped by each shingle, bounds the difference of a candidate pair by its Hamming distance.

Flow. Equal sets form a class with its smallest document as representative. Blocks of documents send their chunk keys
to buckets, which answer which keys another block has. A document with fewer shared keys than a partner must share has
none; of the others all shared keys but the last few in a common order become rows (prefix filtering). Each key pairs
its documents with its smallest one (no pairs within a group), 1024-bit sketches and then exact sets are compared, and links are
joined to components. Where a key's documents still fall into several components, the pairs across components are
compared too, after two bounds: their sizes and the Hamming distance of their 1024-bit sketches. So no link is lost.

Defined results: a text without words has an empty set and is linked with nothing; with fewer words than a shingle the
whole sequence is its one shingle; a row without an id is linked with nothing (its component is null); rows that share
an id are one document; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longfeat.llm import arrays
from longfeat.llm.graph import components
from longfeat.sources.storage import materialize

U64 = np.uint64
BLOCK_BYTES = 4 << 20
BROADCAST_IDS = 300_000
WIDE = 16  # 64-bit words of the sketch that pairs are compared by
SKETCH = ["n", *(f"w{i}" for i in range(WIDE))]
SIGNS = "doc long, h long, n long, s1 long, s2 long"
FOUND = "kind byte, doc long, n long, key long, " + ", ".join(f"w{i} long" for i in range(WIDE))


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def most_apart(self, both: int) -> int:
        """The most shingles that two linked sets with ``both`` shingles in all can differ in."""
        return both * (100 - self.percent) // (100 + self.percent)

    def linked(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, chunks, most chunks that differ) for a set of n shingles: its own band and those of larger partners."""
        ratio = 1 + 3.5 * (100 - self.percent) / 100
        out, low, band = [], 1, 0
        while low <= n * 100 // self.percent:
            high = max(low + 1, int(low * ratio))
            if n < high:
                d = self.most_apart(2 * (high - 1))
                out.append((band, d + 1 + d // 2, d))
            low, band = high, band + 1
        return out


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    size = lo = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size and size + len(texts[i]) > arrays.SLICE_BYTES:
            yield from _sets([t.lower() for t in texts[lo:i]], words)
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    begin, stop, at = arrays.words(data, ends)
    prints = arrays.fingerprints(data, begin, stop)
    grams = arrays.gram_hashes(prints, words)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            got = np.sort(grams[a : b - words + 1])
            yield got[np.concatenate([[True], got[1:] != got[:-1]])]
        else:
            yield arrays.mix(arrays.gram_hashes(prints[a:b], b - a) + U64(b - a)) if b > a else np.zeros(0, U64)


def chunk_keys(shingles: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, int]]:
    """For each band of a set: its keys, one per chunk, and how many of them a linked partner has at least.

    Of ``chunks`` chunks at most ``d`` differ. Chunks without a shingle say little: they give no key, and count as
    agreeing, as long as others must agree too.
    """
    keys: list[tuple[np.ndarray, int]] = []
    if not len(shingles):
        return keys
    spread = shingles >> U64(8)
    for band, chunks, d in rule.bands(len(shingles)):
        if not d:
            continue  # linked sets are equal, and equal sets are one class
        chunk = (spread % U64(chunks)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        ordered = chunk[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        parity = np.zeros(chunks, U64)
        parity[ordered[head]] = np.bitwise_xor.reduceat(shingles[order], head)
        agree = len(head) - d
        which = ordered[head] if agree > 0 else np.arange(chunks)
        made = arrays.mix(arrays.mix(which.astype(U64) + U64(band << 32)) ^ parity[which])
        keys.append((made, max(1, agree)))
    return keys


def wide_sketch(shingles: np.ndarray) -> list[int]:
    """1024 parity bits of a set."""
    place = arrays.mix(shingles ^ U64(0x5851F42D4C957F2D)) & U64(64 * WIDE - 1)
    flips = np.bincount(place.astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8").tolist()


def sign(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, s1, s2 = [], [], []
            for x in shingle_sets(texts, rule.words):
                n.append(len(x))
                s1.append(x.sum(dtype=U64))
                s2.append(arrays.mix(x).sum(dtype=U64))
            columns = [pa.array(n, pa.int64()), *(pa.array(np.array(s, U64).view(np.int64)) for s in (s1, s2))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), *columns], ["doc", "h", "n", "s1", "s2"])

    return signs


def block_keys(table: pa.Table, rule: Rule) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a block's texts; all their keys; each key's group (a text in a band); each group's text and need."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    sets = list(shingle_sets(texts, rule.words))
    made = [(i, keys, need) for i, x in enumerate(sets) for keys, need in chunk_keys(x, rule)]
    group = np.repeat(np.arange(len(made)), [len(k) for _, k, _ in made])
    owner, need = (np.array([m[at] for m in made], np.int64) for at in (0, 2))
    return sets, np.concatenate([*(k for _, k, _ in made), np.zeros(0, U64)]), group, owner, need


def distinct_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys in bucket order, and their buckets (the low bits)."""
    turned = np.unique(keys << U64(64 - bits) | keys >> U64(bits)) if bits else np.unique(keys)
    return turned, (turned >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(turned), np.int64)


def send(rule: Rule, bits: int) -> Callable[[pa.Table], pa.Table]:
    def index(table: pa.Table) -> pa.Table:
        keys, bucket = distinct_keys(block_keys(table, rule)[1], bits)
        begin = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(keys))[: len(begin)]
        short = keys.view(np.uint8).reshape(-1, 8)[:, :6]
        payload = [short[a:b].tobytes() for a, b in zip(begin, stop, strict=True)]
        arrays.give_back()
        block = pa.array([table.column("block")[0].as_py()] * len(begin), pa.int64())
        return pa.table([pa.array(bucket[begin], pa.int64()), block, pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    return index


def answer(table: pa.Table) -> pa.Table:
    """For each block of a bucket, a bit per key: does another block have it?"""
    payloads = table.column("payload").to_pylist()
    sizes = [len(p) // 6 for p in payloads]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 6)
    keys = wide.view("<u8").ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    ends = np.cumsum(sizes).tolist()
    parts = [shared[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    payload = [zlib.compress(np.packbits(p).tobytes(), 1) if p.any() else None for p in parts]
    reply = pa.table([table.column("bucket"), table.column("block"), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])
    return reply.filter(reply.column("payload").is_valid())


def settle(rule: Rule, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block, its answers and its representatives: rows (key, document) of shared keys, those documents' sketches."""

    def found(docs: pa.Table, notes: pa.Table) -> pa.Table:
        notes = notes.to_pylist()
        chosen = {(x["doc"], x["h"]) for x in notes if x["payload"] is None}
        sets, keys, group, owner, need = block_keys(docs, rule)
        known, bucket = distinct_keys(keys, bits)
        shared = np.zeros(len(known), bool)
        for x in notes:
            if x["payload"] is not None:
                lo, hi = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
                got = np.unpackbits(np.frombuffer(zlib.decompress(x["payload"]), np.uint8), count=hi - lo)
                shared[lo:hi] = got.astype(bool)
        place = np.searchsorted(known, keys << U64(64 - bits) | keys >> U64(bits) if bits else keys)
        ids, h = docs.column("doc").to_pylist(), docs.column("h").to_pylist()
        pairs = np.unique(np.stack([place, owner[group]]), axis=1) if len(place) else np.zeros((2, 0), np.int64)
        shared |= np.bincount(pairs[0], minlength=len(known)) > 1
        rep = np.array([(d, x) in chosen for d, x in zip(ids, h, strict=True)], bool)
        mine = np.flatnonzero(shared[place] & rep[owner[group]]) if len(place) else place
        # A linked partner shares ``need`` of a group's shared keys, so in one common order (of the keys' values) both
        # meet in all but the last need - 1 of them; a group with fewer shared keys has no partner.
        order = mine[np.lexsort((place[mine], group[mine]))]
        held = np.bincount(group[order], minlength=len(owner))
        rank = np.arange(len(order)) - (np.cumsum(held) - held)[group[order]]
        order = order[rank < (held - need + 1)[group[order]]]
        value, of = known[place[order]].view(np.int64).tolist(), owner[group[order]]
        rows = [(0, ids[i], len(sets[i]), k, *[None] * WIDE) for k, i in zip(value, of.tolist(), strict=True)]
        rows += [(1, ids[i], len(sets[i]), None, *wide_sketch(sets[i])) for i in np.unique(of).tolist()]
        arrays.give_back()
        kinds = [pa.int8(), *[pa.int64()] * (3 + WIDE)]
        columns = zip(*rows, strict=True) if rows else [[]] * (4 + WIDE)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return found


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of documents with up to ``BROADCAST_IDS`` rows (about 150 bytes each)."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def within_sketches(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that sizes and 1024-bit sketches leave open."""
    for end in ("a", "b"):
        mine = sketches.select(F.col("doc").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in SKETCH))
        pairs = pairs.join(mine, end)
    return pairs.where(open_pair("a", "b", rule))


def open_pair(a: str, b: str, rule: Rule) -> Column:
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    differ = sum(F.bit_count(F.col(f"{a}_w{i}").bitwiseXOR(F.col(f"{b}_w{i}"))) for i in range(WIDE))
    return (100 * F.least(n, m) >= rule.percent * F.greatest(n, m)) & (differ <= most_apart(n + m, rule))


def most_apart(both: Column, rule: Rule) -> Column:
    return F.floor(both * (100 - rule.percent) / (100 + rule.percent))


def sets_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(doc, body): the sets of the documents in the pairs, made again from the representatives' texts.

    Up to ``BROADCAST_IDS`` documents (16 bytes each) are broadcast, so that no text is shuffled; more are joined.
    """
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    ids = materialize(ids.join(classes, "rep").select(F.col("rep").alias("doc"), F.col("rep_h").alias("h")), "ids")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], rule.words)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([x.tobytes() for x in got], pa.binary())], ["doc", "body"])

    return texts.join(small(ids), ["doc", "h"]).select("doc", "text").mapInArrow(arrays.tidy(make), "doc long, body binary")


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked) of the pairs (a, b), from their exact sets."""
    one = sets.select(F.col("doc").alias("a"), F.col("body").alias("left"))
    two = sets.select(F.col("doc").alias("b"), F.col("body").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(rule.linked(len(x), len(y), common))
            columns = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked"])

    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(arrays.tidy(compare), "a long, b long, linked boolean").distinct()


def near_duplicates(docs: DataFrame, rule: Rule, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), a row for each input row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, bits = max(1, total // block_bytes), max(0, total // block_bytes).bit_length()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text")
    signs = materialize(keyed.mapInArrow(arrays.tidy(sign(rule)), SIGNS), "signs")
    classes = signs.where("n > 0 and doc is not null").groupBy("s1", "s2", "n").agg(
        F.min("doc").alias("rep"), F.min_by("h", F.struct("doc", "h")).alias("rep_h"), F.count("*").alias("size")
    )
    classes = materialize(classes, "classes")

    block = F.pmod(F.xxhash64("doc", "h"), F.lit(n_blocks)).alias("block")
    blocks = keyed.where("doc is not null").select(block, "doc", "h", "text")
    sent = blocks.groupBy("block").applyInArrow(send(rule, bits), "bucket long, block long, payload binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "bucket long, block long, payload binary")
    none = F.lit(None)
    chosen = classes.select(F.col("rep").alias("doc"), F.col("rep_h").alias("h")).select(
        none.cast("long").alias("bucket"), block, none.cast("binary").alias("payload"), "doc", "h"
    )
    notes = chosen.unionByName(replies.withColumns({"doc": none.cast("long"), "h": none.cast("long")}))
    found = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(settle(rule, bits), FOUND)
    found = materialize(found, "sketches")
    keys, sketches = found.where("kind = 0").select("key", "doc"), small(found.where("kind = 1").select("doc", *SKETCH))

    hubs = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").drop("last")
    with_hub = keys.join(hubs, "key").where("doc > hub").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    pairs = materialize(within_sketches(with_hub, sketches, rule).select("a", "b").distinct(), "pairs")
    compared = materialize(verify(pairs, sets_of(pairs, classes, keyed, rule), rule), "compared")

    links = compared.where("linked").select("a", "b").union(one_document(signs, classes))
    links = materialize(links.where("a <> b"), "links")
    labels = materialize(components(links, "a", "b"), "labels")

    left = materialize(leftover(keys, sketches, compared, labels, rule), "leftover")
    more = None
    if not left.isEmpty():
        more = materialize(verify(left, sets_of(left, classes, keyed, rule), rule).where("linked").select("a", "b"), "more")
    if more and not more.isEmpty():
        labels = components(links.union(more), "a", "b")
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    with_set = signs.where("n > 0").join(named, ["s1", "s2", "n"], "left")
    # A row with an empty set is in no class; its id has a component where other rows of the id have links.
    without = signs.where("n = 0").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    joined = with_set.unionByName(without)
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_document(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id whose rows have different sets, and the representative of each of them."""
    ends = (f(F.struct("s1", "s2", "n")).alias(f.__name__) for f in (F.min, F.max))
    several = signs.where("doc is not null").groupBy("doc").agg(*ends).where("min <> max").select("doc")
    of = signs.where("n > 0").join(several, "doc").join(classes, ["s1", "s2", "n"])
    return of.select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()


def leftover(keys: DataFrame, sketches: DataFrame, compared: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of one key in different components that the bounds leave open and that were not compared yet.

    Narrow rows (key, document) are shuffled once; components and sketches join them where they have arrived.
    """
    placed = keys.repartition("key").join(small(labels.withColumnRenamed("node", "doc")), "doc", "left")
    rows = placed.withColumn("component", F.coalesce("component", "doc")).join(sketches, "doc")
    columns = ["doc", "component", *SKETCH]
    x = rows.select("key", *(F.col(c).alias(f"x_{c}") for c in columns))
    y = rows.select("key", *(F.col(c).alias(f"y_{c}") for c in columns))
    wanted = (F.col("x_doc") > F.col("y_doc")) & (F.col("x_component") != F.col("y_component")) & open_pair("x", "y", rule)
    pairs = x.join(y, "key").where(wanted).select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).distinct()
    return pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
