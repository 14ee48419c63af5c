"""License scans, whitening and fill-in-the-middle (operators 11 to 13) against brute force."""

import hashlib
import math
import os
import re
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from longfeat.llm import fim, licenses, whitening  # noqa: E402
from longfeat.llm.oracle import ORACLE  # noqa: E402
from longfeat.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", ["op11_rare_token_index", "op13_displacement_scatter"])
def test_query_matches_sql_on_more_rows(lspark, duck, mid_root, name):
    ours, theirs = QUERIES[name](lspark, mid_root), duck(mid_root).sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert plain(ours.select(columns).collect()) == plain(theirs.select(*columns).fetchall())


# op11
NOTICES = [
    (101, "GNU GENERAL-PUBLIC  License; gnu general public gnu general public license"),
    (102, "under the Apache License, Version 2.0. Licensed under the apache licence version 2 0"),
    (103, "mit license" * 2 + " mit\nlicense MIT-License mit_license"),
    (104, "CC BY-NC 4.0 and licensed under CC-BY 4.0, cc bý 4"),
    (105, "Permission is hereby granted, at no charge, free of charge to any person obtaining a copy of this software"),
    (105, "Permission is hereby granted, free of charge to any person getting a copy of the software"),
    (106, "mİt license MIT licenſe apacheé license é apache"),
    (107, ("filler words of the file " * 200 + "all rights reserved. Released under the MIT License. ") * 20),
    (108, "Redistribution and use in source and binary forms, with or without change are permitted"),
    (109, "gnu " * 50 + "general public license version 3"),
    (None, "cc by"),
    (None, "cc by"),
]


def brute_scan(rows, templates, share):
    texts = [WORD.findall(brute.lower(t or "")) for _, t in rows]
    seen = Counter(w for words in texts for w in set(words))
    weight = {w: math.log(1 + len(rows) / (1 + seen[w])) + 1e-6 for t in templates for w in t.words}
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        hits = []
        for t in templates:
            total = sum(weight[w] for w in t.words)
            for start in range(-len(t.words), len(words)):
                agree = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)]
                part = sum(weight[w] for w, yes in zip(t.words, agree, strict=True) if yes) / total
                if all(agree[i] for i in t.mandatory()) and part >= share:
                    hits.append((t.label, t.base, start, part))
        base = [h for h in hits if h[1]]
        starts = [h[2] for h in base]
        labels = [",".join(sorted({h[0] for h in x})) for x in (base, hits)]
        out.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), *labels, round(max((h[3] for h in hits), default=0), 6)))
    return out


def test_licenses(lspark, odd_docs, odd):
    clash = odd_docs.columns[2:]
    more = lspark.createDataFrame([(*r, *["y"] * len(clash)) for r in NOTICES], odd_docs.schema)
    docs = odd_docs.union(more).withColumn("Hits", F.lit(1)).withColumn("_words", F.lit(2))
    got = licenses.scan(docs)
    assert [c for c in got.columns if c in clash and c not in licenses.OUT] == [c for c in clash if c != "n_words"]
    want = brute_scan([*odd, *NOTICES], [*licenses.BASE, *licenses.NOTICES], licenses.SHARE)
    assert plain(got.select("doc_id", *licenses.OUT).collect()) == plain(want)
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[102] == "apache,apache-2.0" and labels[107] == "all-rights-reserved,mit" and labels[106] == ""
    assert labels[104] == "cc-by,cc-by-4.0,cc-by-nc-4.0" and labels[108] == "bsd"


@pytest.mark.parametrize("share", [0.4, 0.95])
def test_no_place_is_lost(lspark, mid_root, share):
    """Rare and frequent words in the templates: the index reaches every place that has the share."""
    docs = lspark.read.parquet(f"{mid_root}/documents.parquet").limit(250).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    own = [licenses.Template("x", "the of and", ()), licenses.Template("y", "and the license the of", ("the",)), licenses.Template("z", "of the")]
    frozen = lspark.createDataFrame(rows, docs.schema)
    got = licenses.scan(frozen, base=own[2:], notices=own[:2], share=share).drop("text")
    assert plain(got.collect()) == plain(brute_scan(rows, [own[2], *own[:2]], share))


def test_scan_is_one_stage_of_built_in_functions(lspark, small_root):
    plan = QUERIES["op11_rare_token_index"](lspark, small_root)._jdf.queryExecution().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


# op12
ODD_VECTORS = [
    (1, [0.1, -0.2, 3.0]),
    (2, [0.1, -0.2, 3.0]),
    (2, [0.1, -0.2, 3.0]),
    (None, [-1.5, 0.015625, 2.0]),
    (3, None),
    (4, [0.1, None, 3.0]),
    (5, [0.1, float("nan"), 3.0]),
    (6, [float("-inf"), 0.2, 3.0]),
    (7, [1e300, 0.2, 3.0]),
    (8, [0.5, 0.5]),
    (9, []),
    (10, [-0.001, 12.0, -7.0]),
    (11, [900.0, 12.0, 1.0]),
    (12, [0.4, 1.0, -0.3]),
]


def brute_whitening(rows, most):
    d = Counter(len(v) for _, v in rows if v and all(c is not None and abs(c) < 2**56 for c in v)).most_common(1)[0][0]
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and abs(c) < 2**56 for c in v)]
    n = len(kept)
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    away = [[Fraction(n * x[j] - sums[j], n) for j in range(d)] for _, x in kept]
    cov = np.array([[float(sum(a[i] * a[j] for a in away) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in kept]
    white = np.array([[float(v) for v in a] for a in away]) @ vectors / np.sqrt(values)
    return n, [i for i, _ in kept], deviation, white, values / np.trace(cov)


@pytest.mark.parametrize("name", ["odd", "small"])
def test_whitening(lspark, small_root, name):
    if name == "odd":
        vectors = lspark.createDataFrame([(*r, "x", 9) for r in ODD_VECTORS], "vec_id long, embedding array<double>, x string, component int").repartition(3)
        rows = ODD_VECTORS
    else:
        vectors = lspark.read.parquet(f"{small_root}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    n, ids, deviation, white, explained = brute_whitening(rows, 32)
    got = whitening.whiten(vectors).collect()
    k = white.shape[1]
    assert len(got) == n * k and {r.n for r in got} == {n}
    for c in range(1, k + 1):
        mine = sorted([(str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c], key=lambda r: (r[:2], abs(r[2])))
        want = sorted([(str(i), v if v < 2**63 else None, w) for i, v, w in zip(ids, deviation, white[:, c - 1].tolist(), strict=True)], key=lambda r: (r[:2], abs(r[2])))
        assert [r[:2] for r in mine] == [r[:2] for r in want]
        a, b = np.array([r[2] for r in mine]), np.array([r[2] for r in want])
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)
    assert max(r.identity_error for r in got) < 1e-4
    assert {r.component: r.explained for r in got} == pytest.approx(dict(enumerate(explained.tolist(), 1)), rel=1e-6)


def test_pair_sums_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for most in (50, 2**31, 2**61):
        z = rng.integers(-most, most, (7, 4))
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        own = z.astype(object)
        want = [sum((a[i] if i == j else a[i] + a[j]) ** 2 for a in own) for i, j in pairs]
        assert whitening.squares(z) == want


def test_whitening_without_variance(lspark):
    ddl = "vec_id long, embedding array<float>"
    assert whitening.whiten(lspark.createDataFrame([], ddl)).collect() == []
    assert whitening.whiten(lspark.createDataFrame([(1, None), (2, [])], ddl)).collect() == []
    one = whitening.whiten(lspark.createDataFrame([(1, [0.5, 0.25])], ddl)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2)]
    flat = whitening.whiten(lspark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], ddl)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in flat] == [False, True] * 4 and flat[0].identity_error < 1e-9 and flat[0].explained == 1


# op13
def brute_middle(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((one % (n + 1), two % (n + 1)))
    sha = brute.sha(text.encode())
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return doc, n, "plain", None, None, sha, sha
    prefix, middle, suffix = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    form = "spm" if four % 100 < 20 else "psm"
    out = suffix + prefix + middle if form == "spm" else prefix + suffix + middle
    return doc, n, form, a, b - a, brute.sha(out.encode()), sha


def digest(df):
    hashed = [F.sha2(c, 256).alias(c) for c in ("output", "restored")]
    return plain(df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed).collect())


def test_middles(lspark, odd_docs, odd):
    rows = [(1000 + i, t) for i in range(60) for t in ("<", "<P", "S>", "<<", "M>é<", "ab<P>c", "<S>", "aé漢😀z" * i, "<P" * i + ">")]
    rows += [(2000 + i, "long é " * 200_000 + str(i)) for i in range(3)]
    clash = odd_docs.columns[2:]
    docs = odd_docs.union(lspark.createDataFrame([(*r, *["y"] * len(clash)) for r in rows], odd_docs.schema)).withColumn("form", F.lit("mine"))
    back = fim.restore(fim.transform(docs))
    assert [c for c in back.columns if c in clash] == clash
    assert digest(back) == plain(brute_middle(d, t) for d, t in [*odd, *rows])


def test_middles_without_rows(lspark, no_docs):
    assert fim.restore(fim.transform(no_docs)).collect() == []
    assert licenses.scan(no_docs).collect() == []


def test_restoring_reads_output_and_form_only(lspark):
    rows = [("psm", "<P>ab<S>ef<M>cd"), ("spm", "<S>ef<P>ab<M>cd"), ("plain", "<P>x"), (None, "y"), ("psm", "<P><S><M>"), ("plain", None)]
    got = fim.restore(lspark.createDataFrame(rows, "form string, output string")).collect()
    assert [r.restored for r in got] == ["abcdef", "abcdef", "<P>x", "y", "", ""]
