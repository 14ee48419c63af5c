r"""Quality rules: base counts of each text, and its divergence from its language's histograms.

A text's histogram of character classes and its histogram of common words are compared with the totals of its
language over all documents that pass the base rules, by Jensen-Shannon distance (0 to 1). Guards: a text with fewer
than ``least_chars`` characters or ``least_words`` words gets no verdict from the respective histogram. The reference
of a language with fewer than ``least_docs`` such documents is smoothed towards the total of all languages, the more the
fewer it has. A null text has no words (it fails the base rules); a null language is a language of its own. Rows are
judged one by one, repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.llm import arrays
from longfeat.sources.storage import materialize

# Frequent function words.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as by this are from or an at have not which you but they",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec aux mais",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya este",
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
# Characters by class; the others are ASCII letters, digits or beyond ASCII.
CLASSES = ["lower", "upper", "digit", "space", "newline", "sentence", "symbol", "control", "beyond"]
SENTENCE = b".,;:!?'\"-()"
SYMBOLS = b"#*$%&|<>"
REPEAT = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
HISTOGRAMS = ["classes", "common"]
VERDICTS = ["base_failed", "class_distance", "word_distance", "kept"]
BROADCAST_LANGUAGES = 10_000
#: What the total of all languages weighs beside a language's first documents, in documents; it falls to 0 at least_docs.
SMOOTHING_DOCS = 10


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), np.int8)
    table[:0x20] = table[0x7F] = CLASSES.index("control")
    table[0x20] = CLASSES.index("space")
    table[[0x09, 0x0B, 0x0C, 0x0D]] = CLASSES.index("space")
    table[0x0A] = CLASSES.index("newline")
    table[list(SENTENCE)] = CLASSES.index("sentence")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[0x80:0xC0] = len(CLASSES)  # inside a character
    table[0xC0:] = CLASSES.index("beyond")
    return table


_CLASS = _class_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    starts, stops, _ = arrays.words(joined, np.array([0, len(joined)]))
    prints = arrays.fingerprints(joined, starts, stops)
    order = np.argsort(prints)
    return prints[order], order


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends])


def repeated(prints: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where the same print occurs again in the same text."""
    key = arrays.mix(prints + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def text_counts(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and both histograms of each text of a slice."""
    n = len(ends) - 1
    starts, stops, words = arrays.words(data, ends)
    white = arrays.WHITE[data]
    out = {"n_words": np.diff(words)}
    out["word_chars"] = _per_text(~white & ((data & 0xC0) != 0x80), ends)
    out["n_symbols"] = _per_text(_IS_SYMBOL[data], ends)

    begin, stop, lines = arrays.lines(data, ends)
    solid = np.concatenate([[0], np.cumsum(~white, dtype=np.int64)])
    full = solid[stop] > solid[begin]
    owner = np.repeat(np.arange(n), np.diff(lines))[full]
    key = arrays.mix(arrays.fingerprints(data, begin[full], stop[full]) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    different = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[different], minlength=n)

    grams = arrays.gram_hashes(arrays.fingerprints(data, starts, stops), REPEAT)
    text_of_word = np.repeat(np.arange(n), np.diff(words))
    inside = np.flatnonzero(text_of_word[: len(grams)] == text_of_word[REPEAT - 1 :]) if len(grams) else np.zeros(0, int)
    twice = inside[repeated(grams[inside], text_of_word[inside])] if len(inside) else inside
    cover = np.zeros(len(starts) + 1, np.int32)
    cover[twice] += 1
    np.subtract.at(cover, twice + REPEAT, 1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover[:-1]) > 0, words)

    kinds = len(CLASSES) + 1
    flat = np.repeat(np.arange(n) * kinds, np.diff(ends)) + _CLASS[data]
    out["classes"] = np.bincount(flat, minlength=n * kinds).reshape(n, kinds)[:, :-1]
    table, order = _word_table()
    prints = arrays.fingerprints(_LOWER[data], starts, stops)
    place = np.minimum(np.searchsorted(table, prints), len(table) - 1)
    which = np.where(table[place] == prints, order[place], len(WORDS))
    out["common"] = np.bincount(text_of_word * (len(WORDS) + 1) + which, minlength=n * (len(WORDS) + 1)).reshape(n, -1)
    return out


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the base counts, ``classes`` and ``common`` (histograms) for each row, in one pass."""
    added = [T.StructField(c, T.LongType()) for c in COUNTS]
    added += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in HISTOGRAMS]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__text")
            for lo, hi in arrays.slices(text):
                got = text_counts(*arrays.text_bytes(text[lo:hi]))
                columns = [batch.column(c)[lo:hi] for c in keep] + [pa.array(got[c].astype(np.int64)) for c in COUNTS]
                for c in HISTOGRAMS:
                    wide = got[c].astype(np.int32)
                    offsets = pa.array(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1])
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(wide.ravel())))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS, *HISTOGRAMS])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(arrays.tidy(count), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of two count arrays of equal length; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # Both totals travel with the arrays through one fold, so that no element sums the array anew.
    shares = F.zip_with(counts, reference, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    start = F.struct(F.lit(0.0).alias("d"), total(counts).alias("m"), total(reference).alias("n"))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def add(s: Column, x: Column) -> Column:
        p, q = x["a"] / s["m"], x["b"] / s["n"]
        more = (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2
        return F.struct((s["d"] + more).alias("d"), s["m"].alias("m"), s["n"].alias("n"))

    root = F.aggregate(shares, start, add, lambda s: F.sqrt(F.greatest(s["d"], F.lit(0.0))))
    return F.when((total(counts) > 0) & (total(reference) > 0), root)


def language_histograms(docs: DataFrame, least_docs: int = 100) -> DataFrame:
    """(__lang, ref_classes, ref_common): totals per language over its documents that pass the base rules.

    With fewer than ``least_docs`` documents: its shares mixed with those of all languages. The totals are written.
    """
    counted = measure(docs.select("lang", "text"), ["lang"]).where(~base_failed())
    sums = [
        F.array(*(F.sum(F.col(c)[i]).cast("double") for i in range(n))).alias(f"ref_{c}")
        for c, n in zip(HISTOGRAMS, (len(CLASSES), len(WORDS) + 1), strict=True)
    ]
    totals = counted.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__docs"), *sums)
    totals = materialize(totals, "languages")
    wide = zip(HISTOGRAMS, (len(CLASSES), len(WORDS) + 1), strict=True)
    every = totals.agg(*(F.array(*(F.sum(F.col(f"ref_{c}")[i]) for i in range(n))).alias(f"all_{c}") for c, n in wide))
    prior = SMOOTHING_DOCS * (1 - F.col("__docs") / least_docs)
    own = F.col("__docs") / (F.col("__docs") + prior)
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smoothed(c: str) -> Column:
        mine, total = F.col(f"ref_{c}"), F.col(f"all_{c}")
        mixed = F.zip_with(mine, total, lambda a, b: own * a / size(mine) + (1 - own) * b / size(total))
        return F.when(F.col("__docs") >= least_docs, mine).otherwise(mixed).alias(f"ref_{c}")

    return totals.crossJoin(F.broadcast(every)).select("__lang", *(smoothed(c) for c in HISTOGRAMS))


def judge(
    docs: DataFrame,
    most_class_distance: float = 0.32,
    most_word_distance: float = 0.16,
    least_chars: int = 300,
    least_words: int = 50,
    least_docs: int = 100,
    short_words: float = 1.5,
) -> DataFrame:
    """The documents with the base counts, ``base_failed``, both distances (null where a guard holds) and ``kept``.

    A short text's words vary more: the word distance may be ``most_word_distance`` + ``short_words`` / root of n_words.

    Two passes over the texts: one for the languages' histograms, one for the verdicts. The histograms (under 1 kB a
    language) are broadcast up to ``BROADCAST_LANGUAGES`` of them. Input columns named like an output are replaced.
    """
    keep = [c for c in docs.columns if c not in (*COUNTS, *HISTOGRAMS, *VERDICTS)]
    base = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    reference = language_histograms(base, least_docs)
    if reference.count() <= BROADCAST_LANGUAGES:
        reference = F.broadcast(reference)
    measured = measure(base, list(dict.fromkeys([*keep, "lang"])))
    joined = measured.join(reference, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    chars = F.aggregate("classes", F.lit(0), lambda s, x: s + x)
    enough_chars, enough_words = chars >= least_chars, F.col("n_words") >= least_words
    judged = joined.withColumns(
        {
            "base_failed": base_failed(),
            "class_distance": F.when(enough_chars, distance(F.col("classes"), F.col("ref_classes"))),
            "word_distance": F.when(enough_words, distance(F.col("common"), F.col("ref_common"))),
        }
    )
    near = F.coalesce(F.col("class_distance") <= most_class_distance, F.lit(True))
    limit = most_word_distance + short_words / F.sqrt("n_words")
    near &= F.coalesce(F.col("word_distance") <= limit, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & near).select(*keep, *COUNTS, *VERDICTS)
