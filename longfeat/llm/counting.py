"""Token counts of whole texts by a piece vocabulary with byte fallback, without building the tokens.

Rank-synchronous array merging: the distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In
each round every pre-token applies its lowest-ranked pair (the leftmost at ties) at once with all others; pre-tokens
that have none left drop out. What survives is counted: a known symbol is one token, an unknown character one token
for each of its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longfeat.llm import arrays

MEMO = 900_000
BATCH = 20_000
#: Longer pre-tokens would need as many rounds; they are merged by a queue, one at a time.
LONG = 512
SPACE = "▁"
NONE = np.iinfo(np.int64).max


class PieceCounter:
    _held: dict[str, PieceCounter] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        chars = sorted({c for p in pieces for c in p})
        names = [*chars, *(p for p in pieces if len(p) > 1)]
        symbol = {p: i for i, p in enumerate(names)}
        self.n = len(names) + 1
        self.unknown = len(names)
        # A character can be inside a piece without being one; alone it is then bytes.
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in names] + [0], np.int64)
        rank = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs, near = {}, set()
        for p, score in pieces.items():
            near.update(zip(p, p[1:], strict=False))
            for cut in range(1, len(p)):
                left, right = symbol.get(p[:cut]), symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (rank[score], symbol[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.codes = np.array([ord(c) for c in chars], np.uint32)
        self.near = np.array(sorted(symbol[a] * self.n + symbol[b] for a, b in near), np.int64)
        self.memo: dict[bytes, int] = {}

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text. Pre-tokens are a run of spaces with what follows up to the next space."""
        split = []
        for text in texts:
            data = (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")
            if not data:
                split.append([])
            elif data[:1] == b" " or data[-1:] == b" " or b"  " in data:
                split.append(re.findall(rb" +[^ ]*", b" " + data))
            else:
                split.append(data.split(b" "))
        seen = set().union(*split)
        new = [w for w in seen if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(seen)
        for i in range(0, len(new), BATCH):
            some = new[i : i + BATCH]
            # A pre-token of the plain split has lost its one space.
            whole = [(w if w[:1] == b" " else b" " + w).decode("utf-8", "surrogatepass") for w in some]
            self.memo.update(zip(some, self.merge(whole).tolist(), strict=True))
        get = self.memo.__getitem__
        return [sum(map(get, parts)) for parts in split]

    def merge(self, pretokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        lengths = np.array([len(p) for p in pretokens], np.int64)
        code = np.frombuffer("".join(pretokens).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[place] == code
        symbol = np.where(known, place, self.unknown)
        total = np.bincount(owner[~known], _utf8_bytes(code[~known]), len(pretokens)).astype(np.int64)
        # No piece spans two characters that never stand side by side in one: such places cut a pre-token safely.
        joins = (owner[1:] == owner[:-1]) & _inside(self.near, symbol[:-1] * self.n + symbol[1:])
        begin = np.flatnonzero(np.concatenate([[True], ~joins])) if len(symbol) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(symbol)))
        single = length == 1
        np.add.at(total, owner[begin[single]], self.cost[symbol[begin[single]]])
        for at in np.flatnonzero(length > LONG):
            run = symbol[begin[at] : begin[at] + length[at]].tolist()
            total[owner[begin[at]]] += self._queue(run)
        some = (length > 1) & (length <= LONG)
        take = np.repeat(some, length)
        self._rounds(symbol[take], length[some], owner[begin[some]], total)
        return total

    def _rounds(self, symbol: np.ndarray, length: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
        rank, made = self._pairs(symbol[:-1], symbol[1:])
        rank, made = np.append(rank, NONE), np.append(made, 0)
        last = np.cumsum(length) - 1
        rank[last] = NONE  # a sequence's last symbol has no right neighbour
        while len(length):
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            order = np.where(rank == NONE, NONE, (rank << 32) + np.arange(len(rank)))
            best = np.minimum.reduceat(order, begin)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, length)
                sums = np.add.reduceat(self.cost[symbol], begin)
                np.add.at(total, owner[over], sums[over])
                symbol, rank, made = symbol[~gone], rank[~gone], made[~gone]
                length, owner = length[~over], owner[~over]
                continue
            at = best & 0xFFFFFFFF
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            ends_here = at + 1 == begin + length - 1
            # The pair to the left and the pair to the right of the new symbol change.
            right = np.where(ends_here, at, np.minimum(at + 2, len(symbol) - 1))
            rank[at], made[at] = self._pairs(symbol[at], symbol[right])
            rank[at[ends_here]] = NONE
            has_left = at > begin
            left = at[has_left] - 1
            rank[left], made[left] = self._pairs(symbol[left], symbol[at[has_left]])
            symbol, rank, made = symbol[keep], rank[keep], made[keep]
            length = length - 1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[place] == key
        return np.where(found, self.ranks[place], NONE), self.made[place]

    def _queue(self, run: list[int]) -> int:
        """The same merges for one long run, by a queue of (rank, place)."""
        n = len(run)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int]] = []

        def look(i: int) -> None:
            j = after[i]
            if j >= 0 and (got := self.pairs.get(run[i] * self.n + run[j])):
                heapq.heappush(queue, (got[0], i, run[i], run[j]))

        for i in range(n - 1):
            look(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if run[i] != left or j < 0 or run[j] != right:
                continue
            run[i] = self.pairs[left * self.n + right][1]
            run[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return int(sum(self.cost[s] for s in run if s >= 0))


def _inside(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they pass ``limit``. A null text is empty; rows are kept as they come."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(path)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in arrays.slices(text):
                some = text[lo:hi]
                n = counter.counts(some.to_pylist())
                columns = [batch.column("doc_id")[lo:hi], np.diff(arrays.text_bytes(some)[1]), np.array(n, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
