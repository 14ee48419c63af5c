"""Substring deduplication by relative Lempel-Ziv parsing of word sequences.

The reference is all documents with smaller ids. Its blocks are the groups of pieces that share an anchor; every
50-word window is in exactly one block, so parsing a piece against its anchor's block is parsing it against them all.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from longfeat.llm import arrays
from longfeat.llm.repeats import BLOCK_BYTES, Unit, remove_repeats

WORD_UNIT = Unit(words=True, window=50, gram=16)


def factor(words: list[bytes], keys: list[int], index: dict[int, tuple[list[bytes], int]], window: int) -> list[tuple[int, int]]:
    """Greedy factors (first window, end) of one piece that are ``window`` words or longer.

    At a place whose window the block has, the factor is extended word by word as far as the reference goes. The next
    factor would begin behind it; windows across that boundary can match another reference, so parsing goes on at the
    first window that the factor does not hold whole. Words are compared themselves, not their hashes.
    """
    found, i = [], 0
    while i < len(keys):
        hit = index.get(keys[i])
        if hit and hit[0][hit[1] : hit[1] + window] == words[i : i + window]:
            reference, at = hit
            n = window
            while i + n < len(words) and at + n < len(reference) and words[i + n] == reference[at + n]:
                n += 1
            found.append((i, i + n - window + 1))
            i += n - window + 1
        else:
            i += 1
    return found


def mark_factors(anchor: np.ndarray, doc: np.ndarray, bodies: list[bytes], window: int = 50) -> tuple[np.ndarray, ...]:
    """Parse each piece against the pieces of its anchor from documents before it."""
    data = np.frombuffer(b" ".join(bodies), np.uint8)
    begin, stop, _ = arrays.words(data, np.array([0, len(data)]))
    keys = arrays.gram_hashes(arrays.fingerprints(data, begin, stop), window).tolist()
    split = [b.split(b" ") for b in bodies]
    at = np.concatenate([[0], np.cumsum([len(w) for w in split])]).tolist()
    piece, first, end = [], [], []
    for _, block in groupby(range(len(bodies)), key=anchor.__getitem__):
        index: dict[int, tuple[list[bytes], int]] = {}
        for _, same_doc in groupby(block, key=doc.__getitem__):
            mine = list(same_doc)
            for p in mine:
                words = split[p]
                for a, b in factor(words, keys[at[p] : at[p] + len(words) - window + 1], index, window):
                    piece.append(p)
                    first.append(a)
                    end.append(b)
            for p in mine:  # only now: a document is no reference for itself
                for i in range(len(split[p]) - window + 1):
                    index.setdefault(keys[at[p] + i], (split[p], i))
    return np.array(piece, np.int64), np.array(first, np.int64), np.array(end, np.int64)


def dedup_words(
    docs: DataFrame, with_text: bool = False, unit: Unit = WORD_UNIT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Documents without the words under any 50-word window that starts in an earlier document too."""
    return remove_repeats(docs, unit, mark_factors, with_text, block_bytes)
