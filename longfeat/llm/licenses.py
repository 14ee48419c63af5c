r"""License scans by a positional index of rare words. DataFrame functions only; no text is shuffled.

A text's words are the runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Templates are short
word sequences with a label: the base phrases, and notices with mandatory key phrases. A template word weighs its
inverse document frequency over all texts. A template stands at a place if the words that agree there, each at its
relative position, hold at least ``share`` of its weight and all its mandatory words agree; for a base phrase all do.

Only a template's rarest words are indexed: in falling weight, until those left out hold less than ``share``, so a place
that reaches the share agrees in an indexed word (for a base phrase its single rarest word is enough). A file's indexed
words are looked up, each posting gives the place where the template would start, and places that several postings name
meet in one candidate, whose words are then compared. Two passes: one counts documents for each template word
(the table, as long as the templates have words, comes to the driver), one scans.

Defined results: a null text is empty; every row is scanned by itself, repeated and null ids too; the first and last
word are null where no base phrase stands; without a place the labels are empty and the score is 0; input columns pass
through, and one named like an output is replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text``: words with one space between them. ``must``: key phrases among them; None: every word."""

    label: str
    text: str
    must: tuple[str, ...] | None = None

    @property
    def base(self) -> bool:
        return self.must is None

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def mandatory(self) -> list[int]:
        """The places of the words that must agree."""
        words, held = self.words, set()
        for phrase in self.must if self.must is not None else (self.text,):
            part = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            held.update(range(at, at + len(part)))
        return sorted(held)


# The base phrases of the contract.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
# Opening words of public license notices.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
SHARE = 0.7


def words_of(text: Column) -> Column:
    # lower() leaves word boundaries where they are; beyond A-Z only the Kelvin sign becomes an ASCII letter.
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))
    spaced = F.trim(F.regexp_replace(plain, BETWEEN, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def weights(docs: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """Each template word's inverse document frequency over all rows."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col("text")))
    # The empty word stands in every row, and counts them.
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r.word: r.n for r in counted.collect()}
    return {w: math.log(1 + seen.get("", 0) / (1 + seen.get(w, 0))) + 1e-6 for w in vocabulary}


def indexed(template: Template, weight: dict[str, float], share: float) -> list[int]:
    """The places of the template's rarest words; those left out hold less than ``share`` of its weight."""
    words = template.words
    order = sorted(range(len(words)), key=lambda i: (-weight[words[i]], i))
    rest = total = sum(weight[w] for w in words)
    least = (1 if template.base else share) * total * (1 - 1e-9)
    chosen = []
    for i in order:
        if rest < least:
            break
        chosen.append(i)
        rest -= weight[words[i]]
    return chosen


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, share: float = SHARE) -> DataFrame:
    """The rows with ``n_words``, the base phrases' places (``n_base``, ``first_word``, ``last_word``), ``base_labels``,
    all ``labels`` and ``score``, the largest share of a template's weight that stands in the text, to six digits."""
    templates = [*base, *notices]
    weight = weights(docs, templates)
    postings = [
        {"word": t.words[i], "template": k, "at": i} for k, t in enumerate(templates) for i in indexed(t, weight, share)
    ]
    index = _table(postings, "word: string, template: int, at: int")
    known = _table(
        [
            {
                "label": t.label,
                "base": t.base,
                "total": sum(weight[w] for w in t.words),
                "words": [{"word": w, "weight": weight[w], "at": i, "must": i in t.mandatory()} for i, w in enumerate(t.words)],
            }
            for t in templates
        ],
        "label: string, base: boolean, total: double, words: array<struct<word: string, weight: double, at: int, must: boolean>>",
    )
    rare = F.array(*map(F.lit, sorted({p["word"] for p in postings})))

    kept = [c for c in docs.columns if c not in OUT]
    fresh = _fresh_names(docs, ("words", "places", "hits"))
    words, places, hits = map(F.col, fresh)
    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: F.array_contains(rare, x["word"]))
    starts = F.transform(
        spots,
        lambda x: F.transform(
            F.filter(index, lambda p: p["word"] == x["word"]), lambda p: F.struct(p["template"].alias("template"), (x["i"] - p["at"]).alias("start"))
        ),
    )
    none = F.array().cast("array<struct<template: int, start: int>>")
    candidates = F.when(F.arrays_overlap(words, rare), F.array_distinct(F.flatten(starts))).otherwise(none)

    def compare(place: Column) -> Column:
        template = F.get(known, place["template"])
        agrees = lambda t: F.coalesce(F.get(words, place["start"] + t["at"]) == t["word"], F.lit(False))
        weight_here = F.aggregate(template["words"], F.lit(0.0), lambda s, t: s + F.when(agrees(t), t["weight"]).otherwise(0.0))
        mandatory = F.forall(template["words"], lambda t: agrees(t) | ~t["must"])
        return F.struct(
            template["label"].alias("label"),
            template["base"].alias("base"),
            place["start"].alias("start"),
            F.when(mandatory, weight_here / template["total"]).otherwise(0.0).alias("share"),
        )

    stands = F.filter(F.transform(places, compare), lambda x: x["share"] >= share)
    of_base = F.filter(hits, lambda x: x["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    staged = docs.select(*kept, words_of(F.col("text")).alias(fresh[0]))
    staged = staged.select("*", candidates.alias(fresh[1])).select("*", stands.alias(fresh[2]))
    return staged.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(F.transform(of_base, lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(of_base, lambda x: x["start"])).cast("long").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(hits).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform(hits, lambda x: x["share"])), F.lit(0.0)), 6).alias("score"),
    )


def _table(rows: list[dict], fields: str) -> Column:
    """A constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def _fresh_names(docs: DataFrame, names: Sequence[str]) -> list[str]:
    """Names that no input column has, whatever its case."""
    held = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while (name := f"_{name}") in held:
            pass
        found.append(name)
    return found
