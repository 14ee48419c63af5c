"""Fill-in-the-middle documents: cut each text in three, move the middle behind the suffix, and back.

Cuts, form and order come from the sha256 of the document's id, so a lost task gives the same rows again. A slice of
texts is moved as one byte array: scanned cuts give three segments a text, a difference array at the segments' first
bytes holds how far each must move more than the one before, its running sum is every byte's shift, and one scatter
writes the output, another the marks. Restoring finds the marks in the output, sums the differences of the segments
there and gathers the bytes from where they are.

Defined results: a null text is empty; an empty text, or one that holds a mark, stays plain; a null id hashes as the
seed alone; rows are handled one by one, repeated ones alike; input columns pass through, and one named like an output
is replaced. Memory is bounded by a slice (``arrays.SLICE_BYTES``, or one text where a text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.llm import arrays

OUT = ["n", "form", "prefix_chars", "middle_chars", "output"]
FORMS = ("plain", "psm", "spm")
#: By form: the order of the segments (0 prefix, 1 middle, 2 suffix) in the output, and the mark before each.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


@dataclass(frozen=True)
class Rule:
    """Of 100 texts ``plain`` stay as they are; of 100 others ``spm`` have the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    marks: tuple[str, str, str] = ("<P>", "<M>", "<S>")  # before prefix, middle, suffix


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed:id as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _spread(length: np.ndarray) -> np.ndarray:
    """Offsets of consecutive pieces of these lengths."""
    return np.concatenate([[0], np.cumsum(length, dtype=np.int64)])


def _shift(n: int, begin: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Every byte's shift, of segments that begin at ``begin`` (rising, empty ones too) and move by ``moved``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begin, np.diff(moved, prepend=0))
    return np.cumsum(steps[:-1])


def _holds(data: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which texts hold one of the marks."""
    found = np.zeros(len(ends) - 1, bool)
    for mark in marks:
        found[np.searchsorted(ends, _find(data, ends, mark), "right") - 1] = True
    return found


def _find(data: np.ndarray, ends: np.ndarray, mark: bytes) -> np.ndarray:
    """Where the mark stands within a text."""
    n = len(data) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    here = np.flatnonzero(data[:n] == mark[0])
    for i, byte in enumerate(mark[1:], 1):
        here = here[data[here + i] == byte]
    return here[np.searchsorted(ends, here, "right") == np.searchsorted(ends, here + len(mark) - 1, "right")]


def move(data: np.ndarray, ends: np.ndarray, h: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """The texts' outputs: ``data`` and ``ends``, and n, form (a number of FORMS), prefix and middle in code points."""
    marks = [m.encode() for m in rule.marks]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(lead, ends)
    n = np.diff(first)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    cuts = np.stack([np.zeros_like(n), np.minimum(one, two), np.maximum(one, two), n])
    plain = (n == 0) | _holds(data, ends, marks) | (h[2] % 100 >= 100 - rule.plain)
    form = np.where(plain, 0, np.where(h[3] % 100 < rule.spm, 2, 1))
    at = np.append(lead, len(data))[first[:-1] + cuts]  # the byte where each segment begins, and the text's end
    at[3] = ends[1:]
    size = np.diff(at, axis=0)
    mark = np.where(form > 0, np.array([[len(m)] for m in marks]), 0)
    order = np.array([(0, 1, 2), *ORDERS.values()]).T[:, form]  # segment by its rank in the output
    pieces = np.take_along_axis(size + mark, order, 0)
    out_ends = _spread(pieces.sum(0))
    began = np.empty_like(size)  # where each segment's mark begins in the output
    np.put_along_axis(began, order, out_ends[:-1] + np.cumsum(pieces, axis=0) - pieces, 0)
    shift = _shift(len(data), at[:3].T.ravel(), (began + mark - at[:3]).T.ravel())
    out = np.empty(out_ends[-1], np.uint8)
    out[np.arange(len(data)) + shift] = data
    for k, text in enumerate(marks):
        for i, byte in enumerate(text):
            out[began[k][form > 0] + i] = byte
    return {"data": out, "ends": out_ends, "n": n, "form": form, "prefix": cuts[1], "middle": cuts[2] - cuts[1]}


def gather(data: np.ndarray, ends: np.ndarray, form: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The texts again, from outputs and forms alone."""
    marks = [m.encode() for m in rule.marks]
    n = len(form)
    moved = np.flatnonzero(form > 0)
    begin, stop = np.zeros((3, n), np.int64), np.zeros((3, n), np.int64)
    begin[0], stop[0] = ends[:-1], ends[1:]
    begin[1:], stop[1:] = ends[1:], ends[1:]
    if len(moved):
        place = np.zeros((3, n), np.int64)
        for k, mark in enumerate(marks):
            here = _find(data, ends, mark)
            owner = np.searchsorted(ends, here, "right") - 1
            place[k][owner[form[owner] > 0]] = here[form[owner] > 0]
        order = np.array([(0, 1, 2), *ORDERS.values()]).T[:, form]
        in_order = np.take_along_axis(place, order, 0)
        close = np.concatenate([in_order[1:], ends[None, 1:]])
        last = np.empty_like(place)
        np.put_along_axis(last, order, close, 0)
        for k, mark in enumerate(marks):
            begin[k][moved], stop[k][moved] = place[k][moved] + len(mark), last[k][moved]
    size = (stop - begin).T.ravel()
    back = _spread(size)
    source = np.arange(back[-1]) + _shift(int(back[-1]), back[:-1], begin.T.ravel() - back[:-1])
    return data[source], back[::3]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def transform(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    kept = [c for c in docs.columns if c not in OUT]
    draw = [f"__fim_{i}" for i in range(4)]
    schema = T.StructType(
        [
            *(docs.schema[c] for c in kept),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            *(T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")),
            T.StructField("output", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__fim_text")
            for lo, hi in arrays.slices(text):
                h = np.stack([batch.column(c)[lo:hi].to_numpy() for c in draw])
                got = move(*arrays.text_bytes(text[lo:hi]), h, rule)
                plain = got["form"] == 0
                columns = [batch.column(c)[lo:hi] for c in kept]
                columns += [pa.array(got["n"], pa.int64()), pa.array(FORMS).take(pa.array(got["form"]))]
                columns += [pa.array(got[c], pa.int64(), mask=plain) for c in ("prefix", "middle")]
                yield pa.RecordBatch.from_arrays([*columns, _binary(got["data"], got["ends"])], schema.names)

    drawn = zip(draws(F.col("doc_id"), rule.seed), draw, strict=True)
    made = docs.select(*kept, F.col("text").cast("binary").alias("__fim_text"), *(d.alias(c) for d, c in drawn))
    return made.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restore(moved: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows with ``restored``: the texts rebuilt from ``output`` and ``form``; a null form counts as plain."""
    kept = [c for c in moved.columns if c != "restored"]
    schema = T.StructType([*(moved.schema[c] for c in kept), T.StructField("restored", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__fim_output")
            for lo, hi in arrays.slices(text):
                form = np.array([FORMS.index(f or "plain") for f in batch.column("__fim_form")[lo:hi].to_pylist()], np.int64)
                data, ends = gather(*arrays.text_bytes(text[lo:hi]), form, rule)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in kept), _binary(data, ends)], schema.names)

    made = moved.select(*kept, F.col("output").cast("binary").alias("__fim_output"), F.col("form").alias("__fim_form"))
    return made.mapInArrow(run, schema).withColumn("restored", F.col("restored").cast("string"))
