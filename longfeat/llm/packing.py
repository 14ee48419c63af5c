"""Bounded-space online packing of documents' ids into sequences of at most ``size`` tokens.

Each partition keeps ``OPEN`` windows. A document's full windows leave at once; what is over goes into the open window
it fits best. When it fits none and no window may be opened, the fullest is filled up with the head of the document
and emitted. At the end a partition pours its open windows together and at most one is left; the leftovers of groups
of partitions are then merged, whole windows best-fit. Only leftovers are ever moved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.llm import arrays
from longfeat.llm.words import WordEncoder
from longfeat.sources.storage import materialize

OPEN = 32
MERGED_PARTS = 64
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, part int, open boolean"
)
NAMES = [c.split()[0] for c in PIECES.split(", ")]
KINDS = [*[pa.int64()] * 8, pa.int32(), pa.bool_()]


class OpenWindows:
    """The open windows of one partition: a list of pieces (doc_id, start, ids, doc_tokens) and its length each."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.windows: list[tuple[int, list]] = []

    def place(self, piece: tuple) -> Iterator[list]:
        """Take a piece shorter than a window; yields the window that had to be emitted, if any."""
        doc, start, ids, total = piece
        n = len(ids) // 4
        fits = [(used, i) for i, (used, _) in enumerate(self.windows) if used + n <= self.size]
        if fits:
            used, i = max(fits)
            self.windows[i][1].append(piece)
            self.windows[i] = (used + n, self.windows[i][1])
            if used + n == self.size:
                yield self.windows.pop(i)[1]
        elif len(self.windows) < self.most:
            self.windows.append((n, [piece]))
        else:
            used, i = max((used, i) for i, (used, _) in enumerate(self.windows))
            gap = self.size - used
            full = self.windows.pop(i)[1]
            if gap:
                full.append((doc, start, ids[: 4 * gap], total))
            yield full
            yield from self.place((doc, start + gap, ids[4 * gap :], total))

    def pour(self) -> Iterator[tuple[list, bool]]:
        """Pour the smallest windows into the fullest, cutting pieces; yields windows and whether one is left open."""
        left = sorted(self.windows, key=lambda w: -w[0])
        self.windows = []
        pieces = [p for _, window in left for p in window]
        window, used = [], 0
        for doc, start, ids, total in pieces:
            while ids:
                head = ids[: 4 * (self.size - used)]
                window.append((doc, start, head, total))
                used, start, ids = used + len(head) // 4, start + len(head) // 4, ids[len(head) :]
                if used == self.size:
                    yield window, False
                    window, used = [], 0
        if window:
            yield window, True


def pack_partitions(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, open_windows: int = OPEN) -> DataFrame:
    """Pieces of all documents; ``open`` marks those of the one window a partition leaves. A null text is empty."""
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(path), TaskContext.get().partitionId()
        state, made, rows = OpenWindows(size, open_windows), 0, []

        def add(window: list, is_open: bool) -> None:
            nonlocal made
            offset, used = 0, sum(len(ids) for _, _, ids, _ in window) // 4
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, (part << 32) + made, offset, used, part, is_open))
                offset += n
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

        for batch in batches:
            text, doc = batch.column("text"), batch.column("doc_id")
            for lo, hi in arrays.slices(text):
                for d, ids in zip(doc[lo:hi].to_pylist(), encoder.ids(text[lo:hi].to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % size
                    for start in range(0, whole, size):
                        add([(d, start, ids[4 * start : 4 * (start + size)], total)], False)
                    if whole < total:
                        for window in state.place((d, whole, ids[4 * whole :], total)):
                            add(window, False)
                yield out()
        for window, is_open in state.pour():
            add(window, is_open)
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrays.tidy(pieces), PIECES)


def merge_leftovers(left: DataFrame, size: int = 2048) -> DataFrame:
    """Join the leftover windows of ``MERGED_PARTS`` neighbouring partitions, best-fit by falling length.

    A group holds one window of each of its partitions at most, so it is bounded.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        used = group.groupby("sequence_id")["sequence_tokens"].first().sort_values(ascending=False, kind="stable")
        hosts: list[list] = []  # [tokens, sequence]
        target = {}
        for sequence, n in used.items():
            fits = [h for h in hosts if h[0] + n <= size]
            host = max(fits) if fits else [0, sequence]
            if not fits:
                hosts.append(host)
            target[sequence] = (host[1], host[0])
            host[0] += n
        total = {sequence: n for n, sequence in hosts}
        moved = group["sequence_id"].map(target)
        group["offset"] += moved.str[1]
        group["sequence_id"] = moved.str[0]
        group["sequence_tokens"] = group["sequence_id"].map(total)
        return group

    return left.groupBy(F.floor(F.col("part") / MERGED_PARTS)).applyInPandas(merge, PIECES)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, open_windows: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens: a row for each piece.

    The partitions' pieces are written once to the shared folder, so that leftovers are merged without packing again.
    """
    pieces = materialize(pack_partitions(docs, path, size, end_id, open_windows), "pieces")
    merged = merge_leftovers(pieces.where("open"), size)
    return pieces.where(~F.col("open")).unionByName(merged).drop("part", "open")
