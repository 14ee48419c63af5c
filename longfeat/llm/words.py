"""Token ids of whole texts by a public tokenizer, word by word.

The tokenizer file drops white space and never joins across it, so a text's ids are its words' ids one after the
other. Each Python worker keeps the ids of words it has met (at most ``MEMO`` of them; then it starts anew) and asks
the tokenizers library only for the others, many to a call: words of letters with spaces between, cut behind the ids
that end a pre-token, and other words with a special token between. Lower-case ASCII words need the file's merges only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import batched, pairwise
from typing import TYPE_CHECKING

import numpy as np

from longfeat.llm import arrays

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MEMO = 900_000
CALL_WORDS = 500
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: By the last two bytes of UTF-8: Latin letters whose lower case is one letter; the others have marks that join what
#: stands behind them.
LETTERS = np.zeros((256, 256), bool)
for _c in map(chr, range(0x250)):
    if _c.isalpha() and len(_c.lower()) == 1:
        LETTERS[tuple(_c.encode()) if ord(_c) > 127 else (slice(None), ord(_c))] = True

#: Steps of a tokenizer file that make a lower-case ASCII word one pre-token, as it is.
LEAVE_ASCII_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def words_apart(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of each text, ASCII capitals folded, in pieces whose ids, one after the other, are the text's.

    A pre-token of letters ends before punctuation, so "word," gives "word" and ",". Words with "<|" may hold a special
    token and stay as they are written.
    """
    whole = b"\n".join([b"", b"", *texts])
    data = np.frombuffer(whole.lower(), np.uint8)
    at = np.flatnonzero(PUNCTUATION[data])
    at = at[LETTERS[data[at - 2], data[at - 1]]]
    if b"<|" in whole:
        white = np.flatnonzero(arrays.WHITE[data])
        kept = np.unique(np.searchsorted(white, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))))
        at = at[~np.isin(np.searchsorted(white, at), kept)]
        data = data.copy()
        for a, b in zip(white[kept - 1].tolist(), np.append(white, len(data))[kept].tolist(), strict=True):
            data[a:b] = np.frombuffer(whole[a:b], np.uint8)
    ends = np.cumsum([2, *(len(t) + 1 for t in texts)])
    ends += np.searchsorted(at, ends)
    apart = np.insert(data, at, ord(" ")).tobytes()
    return (apart[a:b].split() for a, b in pairwise(ends.tolist()))


class Memo(dict[bytes, bytes]):
    """Ids by word. A word it lacks gets a place in ``new``, empty until it is learned."""

    new: dict[bytes, bytearray]

    def __missing__(self, word: bytes) -> bytearray:
        return self.new.setdefault(word, bytearray())


class WordEncoder:
    """``ids(texts)``: the little-endian uint32 ids of each text, as the library gives them without special tokens."""

    _held: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.between = self.special[-1]
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.last = self._last_tokens()
        self.plain = self._as_they_are()
        self.memo = Memo()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each worker and file."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        split = words_apart([(text or "").encode("utf-8", "surrogatepass") for text in texts])
        self.memo.new = {}
        # A text's words are looked up and dropped before the next text is split, so they stay in the processor's cache.
        found = [list(map(self.memo.__getitem__, words)) for words in split]
        self._learn(self.memo.new)
        return list(map(b"".join, found))

    def _as_they_are(self) -> Tokenizer | None:
        """The file's merges for lower-case ASCII words with spaces between, where its other steps leave those alone."""
        from tokenizers import Tokenizer, pre_tokenizers

        steps = json.loads(self.tokenizer.to_str())
        if {k: steps[k] for k in LEAVE_ASCII_WORDS} != LEAVE_ASCII_WORDS:
            return None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return plain

    def _last_tokens(self) -> np.ndarray | None:
        """Which ids end a pre-token, where the tokenizer marks them and has such an id for every byte; else None."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = [(t, i) for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        if sum(len(t) == len(suffix or "") + 1 for t, _ in ends) < 256:
            return None
        last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        last[[i for _, i in ends]] = True
        return last

    def _learn(self, new: dict[bytes, bytearray]) -> None:
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        plain, letters, others = [], [], []
        for w in new:
            if self.plain is not None and self.last is not None and w.isalpha():  # ASCII letters
                plain.append(w)
            elif b"<|" in w:
                self.memo[w] = self._alone(w)
            else:
                (letters if self.last is not None and w.decode("utf-8", "surrogatepass").isalpha() else others).append(w)
        for some in batched(plain, CALL_WORDS):
            self._spaced(some, self.plain)
        for some in batched(letters, CALL_WORDS):
            self._spaced(some, self.tokenizer)
        for some in batched(others, CALL_WORDS):
            self._marked(some)
        for w, place in new.items():
            place[:] = self.memo[w]

    def _spaced(self, some: tuple[bytes, ...], tokenizer: Tokenizer) -> None:
        """Words of letters only, with spaces between. Each has a pre-token at least, so equal counts mean one each."""
        joined = b" ".join(some).decode("utf-8", "surrogatepass")
        got = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[got]) + 1
        if len(ends) != len(some):  # a letter that becomes a letter and a mark
            self._marked(some)
            return
        self._keep(some, got.tobytes(), [0, *ends[:-1].tolist()], ends.tolist())

    def _marked(self, some: tuple[bytes, ...]) -> None:
        """Any words, with a special token between."""
        joined = self.between.encode().join(some).decode("utf-8", "surrogatepass")
        got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(got == self.between_id)
        if len(cuts) != len(some) - 1:  # a word that the library reads together with the mark beside it
            self.memo.update((w, self._alone(w)) for w in some)
            return
        self._keep(some, got.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(got)])

    def _keep(self, some: tuple[bytes, ...], data: bytes, starts: list[int], ends: list[int]) -> None:
        for w, a, b in zip(some, starts, ends, strict=True):
            self.memo[w] = data[4 * a : 4 * b]

    def _alone(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
