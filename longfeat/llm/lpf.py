"""Suffix-array deduplication of bytes by longest-previous-factor arrays.

Pieces that share an anchor are concatenated in document order and all their suffixes are sorted, by prefix doubling
from 8-byte loads up to the longest piece; no match crosses the end of a piece. In suffix order the previous and the
next suffix that stand in a smaller document (a smaller position; a document is no reference for itself) share the
longest prefixes with a suffix among all earlier ones, so the longer of the two common prefixes is its longest
previous factor. Common prefixes are read off the ranks that the doubling left, from the longest step down. Bytes
under factors of a window or longer are duplicates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from longfeat.llm.repeats import BLOCK_BYTES, Unit, remove_repeats

BYTE_UNIT = Unit(words=False, window=50, gram=24)
LOAD = 8


def _ordered(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, places still equal to another) once the places ``some`` of equal ranks are told apart by ``key``.

    A rank is the number of suffixes before; ``key`` orders by rank first.
    """
    order = np.argsort(key)
    some, key = some[order], key[order]
    at = np.arange(len(some))
    old, same = rank[some], np.zeros(len(some) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    head = np.maximum.accumulate(np.where(same[:-1], 0, at))
    group = np.maximum.accumulate(np.where(np.concatenate([[False], old[1:] == old[:-1]])[: len(at)], 0, at))
    made = rank.copy()
    made[some] = old + head - group
    return made, np.sort(some[same[:-1] | same[1:]])


def suffix_ranks(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """8 bytes from each place as a number, and ranks of all places by their first 8, 16, 32, ... until no two are equal.

    ``left`` is the number of bytes from a place to the end of its piece. A suffix shorter than the reach stands behind
    those that it is a prefix of and equals none: such ones are told apart by their place.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * LOAD, np.uint8)])
    loads = np.empty(n, np.uint64)
    for at in range(min(LOAD, n)):
        part = loads[at::LOAD]
        part[:] = np.frombuffer(padded[at : at + LOAD * len(part)].tobytes(), ">u8")
    short = np.maximum(LOAD - left, 0)
    # Bytes beyond the piece are set, so that a shorter suffix is behind.
    loads |= (np.uint64(1) << (short * 8).astype(np.uint64)) - np.uint64(1)
    place = np.arange(1, n + 1, dtype=np.int64)
    rank, equal = _ordered(np.zeros(n, np.int32), np.arange(n), loads)
    with_short = np.zeros(n, bool)
    with_short[rank[short > 0]] = True
    mixed = with_short[rank[equal]]
    some = equal[mixed]
    rank, again = _ordered(rank, some, rank[some] * np.int64(n + 1) + np.where(short[some] > 0, place[some], 0))
    equal = np.concatenate([equal[~mixed], again])
    ranks, reach = [rank], LOAD
    while len(equal):
        # Of the suffixes still equal to another, one that ends right at the reach is told apart now.
        behind = np.where(left[equal] == reach, n + place[equal], rank[np.minimum(equal + reach, n - 1)])
        rank, equal = _ordered(rank, equal, rank[equal] * np.int64(2 * n + 1) + behind)
        ranks.append(rank)
        reach *= 2
    return loads, ranks


def common_prefix(loads: np.ndarray, left: np.ndarray, ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, each up to the end of its piece."""
    limit = np.minimum(left[a], left[b])
    common = np.zeros(len(a), np.int64)
    # No two suffixes are equal on the last level, so each level is needed once at most, and none without the first.
    long = np.flatnonzero(ranks[0][a] == ranks[0][b])
    x, y, most = a[long], b[long], limit[long]
    step = np.zeros(len(long), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero(step < most) if step.any() else slice(None)
        same = ranks[level][x[at] + step[at]] == ranks[level][y[at] + step[at]]
        step[at] += same * (LOAD << level)
    common[long] = step
    last = len(loads) - 1
    apart = loads[np.minimum(a + common, last)] ^ loads[np.minimum(b + common, last)]
    for n in range(1, LOAD):
        common += apart < np.uint64(1 << 8 * (LOAD - n))  # another leading byte is equal
    return np.minimum(common, limit)


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; chains are halved in each round."""
    before = np.arange(-1, len(value) - 1)
    active = np.flatnonzero(before >= 0)
    active = active[value[before[active]] >= value[active]]
    while len(active):
        before[active] = before[before[active]]
        active = active[before[active] >= 0]
        active = active[value[before[active]] >= value[active]]
    return before


def previous_factors(data: np.ndarray, left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array: how long a prefix of each suffix starts in a smaller document."""
    n = len(data)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    loads, ranks = suffix_ranks(data, left)
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    ordered = doc[order]
    for found in (previous_smaller(ordered), n - 1 - previous_smaller(ordered[::-1])[::-1]):
        there = np.flatnonzero((found >= 0) & (found < n))
        here = order[there]
        longest[here] = np.maximum(longest[here], common_prefix(loads, left, ranks, here, order[found[there]]))
    return longest


def mark_factors(anchor: np.ndarray, doc: np.ndarray, bodies: list[bytes], window: int = 50) -> tuple[np.ndarray, ...]:
    """(piece, first window, end) of the runs of windows under factors of a window or longer."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    length = np.array([len(b) for b in bodies], np.int64)
    piece = np.repeat(np.arange(len(bodies)), length)
    place = np.arange(len(data)) - (np.cumsum(length) - length)[piece]
    # Equal windows have equal anchors, so factors of a window from another anchor's pieces do not exist.
    hit = previous_factors(data, length[piece] - place, doc[piece]) >= window
    before = np.zeros(len(hit), bool)
    before[1:] = hit[:-1] & (piece[1:] == piece[:-1])
    after = np.zeros(len(hit), bool)
    after[:-1] = hit[1:] & (piece[1:] == piece[:-1])
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    return piece[first], place[first], place[last] + 1


def dedup_bytes(
    docs: DataFrame, with_text: bool = False, unit: Unit = BYTE_UNIT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Documents without the bytes under any 50-byte string that starts in an earlier document too."""
    return remove_repeats(docs, unit, mark_factors, with_text, block_bytes)
