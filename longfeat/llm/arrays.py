"""Texts of an Arrow batch as flat numpy arrays: bytes, words, lines and their 64-bit fingerprints.

Nulls count as empty texts. All functions are pure and work on one slice of a batch, so memory is bounded by the
slice (``SLICE_BYTES``, or one text where a single text is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

#: The white space of the contracts: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(2**40, 2**62)) * 8 + 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + 1)
        held = np.full(size, base & (2**64 - 1), U64)
        held[0] = 1
        np.cumprod(held, out=held)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``limit`` bytes of text each; one row at least."""
    _, ends = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return what a worker has freed to the system; a worker serves many tasks and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over a partition, then ``give_back``."""

    def over(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string or binary column."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    n = len(column)
    if not n or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[ends[0] : ends[-1]] if what is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses the end of a text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words, and n + 1 offsets of the texts' words among them."""
    starts, stops = runs(~WHITE[data], ends)
    return starts, stops, np.searchsorted(starts, ends)


def lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(starts, ends) of the \n-split lines, and n + 1 offsets of the texts' lines; every text has a line at least."""
    breaks = np.flatnonzero(data == 0x0A)
    per = np.diff(np.searchsorted(breaks, ends)) + 1
    firsts = np.concatenate([[0], np.cumsum(per)])
    starts = np.empty(firsts[-1], np.int64)
    stops = np.empty(firsts[-1], np.int64)
    opening = np.zeros(firsts[-1], bool)
    opening[firsts[:-1]] = True
    closing = np.zeros(firsts[-1], bool)
    closing[firsts[1:] - 1] = True
    starts[opening], starts[~opening] = ends[:-1], breaks + 1
    stops[closing], stops[~closing] = ends[1:], breaks
    return starts, stops, firsts


def fingerprints(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each byte range, by one running polynomial over all bytes; another table, another hash."""
    if not len(starts):
        return np.zeros(0, U64)
    running = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * _power(_BASE, len(data)), out=running[1:])
    value = (running[stops] - running[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(value + (stops - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive 64-bit symbols; len(symbols) - size + 1 of them."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    running = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * _power(_BASE, len(symbols)), out=running[1:])
    return mix((running[size:] - running[:-size]) * _power(_BASE_INVERSE, n))


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes (a multiple of 8), from unaligned 8-byte loads."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    loads = np.empty(len(data) - 7, U64)
    for at in range(8):
        part = loads[at::8]
        part[:] = np.frombuffer(data[at : at + 8 * len(part)].tobytes(), "<u8")
    value = loads[:n] * U64(0x9E3779B97F4A7C15)
    for step in range(8, size, 8):
        value ^= value >> U64(29)
        value += loads[step : step + n]
        value *= U64(0xBF58476D1CE4E5B9)
    return mix(value)


POSITION_BITS = 28
_POSITION = U64((1 << POSITION_BITS) - 1)


def anchored_runs(grams: np.ndarray, gram: int, window: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of every text into runs that share a minimiser.

    ``grams`` are the hashes of all ``gram``-symbol runs of the concatenated texts, ``ends`` the texts' n + 1 offsets.
    A window's minimiser is its smallest gram (the leftmost at ties), so equal windows have equal minimisers at equal
    places. Returns, per run, its first window, its number of windows and its minimiser's position.
    """
    width = window - gram + 1
    n = int(ends[-1]) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    assert len(grams) <= 1 << POSITION_BITS, "one text is longer than the positions reach"
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[:n] & _POSITION).astype(np.int64)
    inside = np.ones(n, bool)
    reach = np.zeros(n + 1, np.int32)  # windows that start fewer than ``window`` symbols before a text's end
    np.add.at(reach, np.clip(np.maximum(ends[1:-1] - window + 1, ends[:-2]), 0, n), 1)
    np.add.at(reach, np.clip(ends[1:-1], 0, n), -1)
    inside = np.cumsum(reach[:-1]) == 0
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    return starts, np.flatnonzero(last) + 1 - starts, at[starts]
