"""Benchmark decontamination: BM25 retrieval of benchmark items by every training passage, then verification.

Index. Items are cut into segments of ``SEGMENT`` words at most; a segment is one indexed unit. Its BM25 impacts are
divided by its score against itself, so 1 means that a passage has all its words, and one threshold serves all.
Postings are cut into blocks of ``BLOCK`` neighbouring units with the largest impact of each term in the block.

Query. Every passage (``2 * SEGMENT`` words, a new one each ``SEGMENT``, so that any segment lies whole in one) is a
query. Block-max pivoting: a block whose largest impacts over the passage's words do not add up to the threshold is
skipped; in the others units are scored in full. All units at the threshold are retrieved (no top k).

Verification. The item's question (all but its last line or sentence) and its answer (that last one) must both overlap
with the text from one segment before to one behind the retrieved passages by word n-grams.

Defined results: words are runs of characters that are neither white space nor ASCII punctuation, lower-cased; a
null or empty text or item has none and matches nothing; equal items are retrieved each; repeated rows are judged each;
leaks are in order of item id (null first), score and overlaps.

Parts. Document frequencies, the number of units and their mean length are counted over the whole benchmark by Spark.
Items are dealt to parts of bounded size, each indexed in a task from its items and its words' counts, so scores are
the same for any number of parts. One pass over the documents applies them all, a worker holding one part at a time.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.llm import arrays
from longfeat.sources.storage import materialize

SEGMENT = 64
BLOCK = 4
K1, B = 1.2, 0.75
#: An index of more text than this is built and applied in several parts; rows do not depend on it.
PART_BYTES = 4 << 20
LEAK = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_APART = arrays.WHITE | _PUNCTUATION


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words, n + 1 offsets of the texts' words)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    begin, stop = arrays.runs(~_APART[data], ends)
    return arrays.fingerprints(data, begin, stop), np.searchsorted(begin, ends)


def question_and_answer(text: bytes) -> tuple[bytes, bytes]:
    """The last line, or without a line break the last sentence, is the answer; an item of one sentence is all question."""
    stripped = text.rstrip()
    cut = stripped.rfind(b"\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(rb"[.?!]\s", stripped)]
        cut = ends[-1] if ends else len(stripped)
    return stripped[:cut], stripped[cut:]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    return np.unique(arrays.gram_hashes(words, n)) if n else np.zeros(0, np.uint64)


@dataclass
class Counts:
    """Of all units: how many there are, their words, and how many units hold a term (at least the terms needed)."""

    units: int
    words: int
    terms: np.ndarray  # ascending
    holding: np.ndarray


def cut_units(texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """(words of each segment, its text)."""
    prints, at = word_prints(texts)
    spans = [(i, lo, min(lo + SEGMENT, at[i + 1])) for i in range(len(texts)) for lo in range(at[i], at[i + 1], SEGMENT)]
    return [prints[lo:hi] for _, lo, hi in spans], [i for i, _, _ in spans]


def count(texts: list[bytes]) -> Counts:
    units, _ = cut_units(texts)
    terms, holding = np.unique(np.concatenate([np.unique(u) for u in units] + [np.zeros(0, np.uint64)]), return_counts=True)
    return Counts(len(units), sum(map(len, units)), terms, holding)


@dataclass
class Index:
    """Units (segments) with normalised impacts: per term its blocks' maxima, per unit its terms."""

    terms: np.ndarray
    block_at: np.ndarray  # terms' offsets into block and block_max
    block: np.ndarray
    block_max: np.ndarray
    unit_at: np.ndarray  # units' offsets into unit_term and impact
    unit_term: np.ndarray
    impact: np.ndarray
    unit_item: np.ndarray
    items: list[tuple[int | None, np.ndarray, np.ndarray]]  # id, words of the question, words of the answer
    copies: list[int]  # rows of each item


def build(
    items: list[tuple[int | None, str | None]], counts: Counts | None = None, copies: list[int] | None = None
) -> Index:
    """The index of some items; ``counts`` are those of the whole benchmark, or None if these items are all."""
    whole = [lowered(t) for _, t in items]
    counts = counts or count(whole)
    units, unit_item = cut_units(whole)
    counted = [np.unique(u, return_counts=True) for u in units]
    unit_at = np.concatenate([[0], np.cumsum([len(t) for t, _ in counted], dtype=np.int64)])
    flat = np.concatenate([t for t, _ in counted] + [np.zeros(0, np.uint64)])
    tf = np.concatenate([c for _, c in counted] + [np.zeros(0, np.int64)])
    terms, unit_term = np.unique(flat, return_inverse=True)
    df = counts.holding[np.searchsorted(counts.terms, terms)]
    idf = np.log(1 + (counts.units - df + 0.5) / (df + 0.5))
    length = np.array([len(u) for u in units], float)
    unit = np.repeat(np.arange(len(units)), np.diff(unit_at))
    norm = K1 * (1 - B + B * length / (counts.words / counts.units if counts.units else 1))
    impact = idf[unit_term] * tf * (K1 + 1) / (tf + norm[unit])
    impact = impact / np.bincount(unit, impact, len(units))[unit]
    key = unit_term * (len(units) // BLOCK + 1) + unit // BLOCK
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(key) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact[order], head) if len(key) else impact
    at_term = np.searchsorted(unit_term[order][head], np.arange(len(terms) + 1))
    parts = [question_and_answer(w) for w in whole]
    words = [(word_prints([q])[0], word_prints([a])[0]) for q, a in parts]
    named = [(i, q, a) for (i, _), (q, a) in zip(items, words, strict=True)]
    block = (unit // BLOCK)[order][head]
    unit_item = np.array(unit_item, np.int64)
    return Index(terms, at_term, block, block_max, unit_at, unit_term, impact, unit_item, named, copies or [1] * len(items))


def retrieve(index: Index, prints: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(text, passage, unit, score) of every unit that a passage scores at the threshold or above."""
    found: list[tuple[int, int, int, float]] = []
    if not len(prints) or not len(index.terms):
        return found
    place = np.minimum(np.searchsorted(index.terms, prints), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == prints)
    # Cells of SEGMENT words; a passage is a cell and the next one of its text.
    cells = -(-np.diff(at) // SEGMENT)
    cell_at = np.concatenate([[0], np.cumsum(cells)])
    text = np.searchsorted(at, known, "right") - 1
    cell = cell_at[text] + (known - at[text]) // SEGMENT
    key = np.unique(cell * len(index.terms) + place[known])
    cell, term = key // len(index.terms), key % len(index.terms)
    last = np.zeros(cell_at[-1], bool)
    last[cell_at[1:][cells > 0] - 1] = True
    cell_of = np.searchsorted(cell, np.arange(cell_at[-1] + 1))
    n_blocks = int(index.block.max()) + 1
    step = max(1, (1 << 21) // n_blocks)
    for lo in range(0, int(cell_at[-1]), step):
        hi = min(lo + step + 1, int(cell_at[-1]))
        a, b = cell_of[lo], cell_of[hi]
        wide = np.diff(index.block_at)[term[a:b]]
        each = np.repeat(np.arange(a, b), wide)
        posting = np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide) + index.block_at[term[each]]
        bound = np.bincount((cell[each] - lo) * n_blocks + index.block[posting], index.block_max[posting], (hi - lo) * n_blocks)
        bound = bound.reshape(hi - lo, n_blocks)
        # The sum of two cells' bounds holds for their union.
        both = bound.copy()
        both[:-1] += np.where(last[lo : hi - 1, None], 0, bound[1:])
        for passage, block in zip(*np.nonzero(both[: hi - lo if hi == cell_at[-1] else step] >= threshold - 1e-9), strict=True):
            passage += lo
            more = passage + (1 if last[passage] else 2)
            mine = np.unique(term[cell_of[passage] : cell_of[more]])
            for unit in range(block * BLOCK, min(block * BLOCK + BLOCK, len(index.unit_item))):
                span = slice(index.unit_at[unit], index.unit_at[unit + 1])
                score = float(index.impact[span][np.isin(index.unit_term[span], mine)].sum())
                if score >= threshold:
                    found.append((int(np.searchsorted(cell_at, passage, "right")) - 1, int(passage), unit, score))
    starts = cell_at.tolist()
    return [(t, p - starts[t], u, s) for t, p, u, s in found]


def verify(index: Index, words: np.ndarray, hits: list[tuple[int, int, float]], least: float, gram: int) -> list[dict]:
    """The items that a text (its words) leaks, of its retrieved (passage, unit, score)."""
    by_item: dict[int, list] = {}
    for passage, unit, score in hits:
        by_item.setdefault(int(index.unit_item[unit]), []).append((passage, score))
    leaks = []
    for i, got in sorted(by_item.items()):
        item, question, answer = index.items[i]
        lo, hi = min(p for p, _ in got) - 1, max(p for p, _ in got) + 3
        near = words[max(0, lo * SEGMENT) : hi * SEGMENT]
        overlap = []
        for part in (question, answer):
            mine = grams(part, gram)
            there = grams(near, min(gram, len(part))) if len(part) else mine
            overlap.append(float(np.isin(mine, there).mean()) if len(mine) else 1.0)
        if min(overlap) >= least:
            leak = {"item_id": item, "score": max(s for _, s in got), "question_overlap": overlap[0], "answer_overlap": overlap[1]}
            leaks += [leak] * index.copies[i]
    return leaks


def _opened(parts: list[Broadcast]) -> Iterator[Index]:
    """The parts' indexes, one in memory at a time."""
    for part in parts:
        yield pickle.loads(part.value)
        if len(parts) > 1:
            del part._value  # read again from the executor's copy when it is needed


def _in_order(leak: dict) -> tuple:
    item = leak["item_id"]
    return item is not None, item or 0, leak["score"], leak["question_overlap"], leak["answer_overlap"]


def _flagger(parts: list[Broadcast], keep: list[str], threshold: float, least: float, gram: int) -> Callable:
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])
    )

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = next(_opened(parts)) if len(parts) == 1 else None
        for batch in batches:
            text = batch.column("text")
            leaks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            # Several parts are each read once for a whole batch.
            for index in [only] if only else _opened(parts):
                for lo, hi in arrays.slices(text):
                    prints, at = word_prints([lowered(t) for t in text[lo:hi].to_pylist()])
                    hits: dict[int, list] = {}
                    for t, passage, unit, score in retrieve(index, prints, at, threshold):
                        hits.setdefault(t, []).append((passage, unit, score))
                    for t, got in hits.items():
                        leaks[lo + t] += verify(index, prints[at[t] : at[t + 1]], got, least, gram)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(x, key=_in_order) for x in leaks], kind)], [*keep, "leaks"])

    return flag


def index_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, payload): the index of all items in parts of about ``part_bytes`` of text, written to the shared folder.

    Equal rows are one item with a number of copies, so that no part outgrows its bound through them.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    items = materialize(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, copies, part in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "part")), strict=True):
                mine = count([lowered(text)])
                rows.append((part, None, copies * mine.units, copies * mine.words))
                rows += [(part, t, copies * n, 0) for t, n in zip(mine.terms.view(np.int64).tolist(), mine.holding.tolist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "term", "n", "words"])

    tallied = items.mapInArrow(tally, "part long, term long, n long, words long")
    # The row without a term holds a part's units and words.
    tallied = materialize(tallied.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
    units, words = tallied.where("term is null").agg(F.sum("n"), F.sum("words")).first()
    everywhere = tallied.groupBy("term").agg(F.sum("n").alias("holding"))
    needed = tallied.select("part", "term").join(everywhere, "term").select("part", "term", "holding")

    def make(mine: pa.Table, terms: pa.Table) -> pa.Table:
        key = terms.column("term").to_numpy().view(np.uint64)
        order = np.argsort(key)
        counts = Counts(units, words, key[order], terms.column("holding").to_numpy()[order])
        rows = zip(*(mine.column(c).to_pylist() for c in ("item_id", "text", "copies")), strict=True)
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        index = build([(i, t) for i, t, _ in rows], counts, [n for _, _, n in rows])
        return pa.table({"part": pa.array([mine.column("part")[0].as_py()], pa.int64()), "payload": pa.array([pickle.dumps(index)], pa.binary())})

    made = items.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(make, "part long, payload binary")
    return materialize(made, "index")


def flag_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.7,
    least_overlap: float = 0.6,
    gram: int = 5,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents with ``leaks``: the items that each text holds, with score and overlaps. No shuffle of documents.

    A column of the input named ``leaks`` is replaced; all others pass through. The driver passes the parts on one by
    one; executors keep them as broadcast blocks, on disk where memory is short.
    """
    keep = [c for c in docs.columns if c != "leaks"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("leaks", T._parse_datatype_string(LEAK))])
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(bytes(row.payload)) for row in index_parts(benchmark, part_bytes).toLocalIterator()]
    return docs.select(keep).mapInArrow(_flagger(parts, keep, threshold, least_overlap, gram), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, **options: float | int) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each item that a document leaks."""
    flagged = flag_leaks(docs.select("doc_id", "text"), benchmark, **options)
    return flagged.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
