"""Plain Python versions of the operators, a row at a time."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def base_counts(text):
    words = WORD.findall(text or "")
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    counts = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
    return (*counts, len(words) < 20 or 100 * len(covered) > 30 * len(words))


def repeats(docs, words, window=50):
    """[(doc_id, n, n_removed, n_spans, sha256)] in the order of the rows."""
    plain = [WORD.findall(t or "") if words else (t or "").encode() for _, t in docs]
    first = {}
    for (d, _), x in zip(docs, plain, strict=True):
        for i in range(len(x) - window + 1 if d is not None else 0):
            k = tuple(x[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), x in zip(docs, plain, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1 if d is not None else 0):
            if first[tuple(x[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(x, gone, strict=True) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, sha(" ".join(kept) if words else bytes(kept))))
    return out


def lines(docs, least=10):
    def key(line):
        return lower(line.strip(WHITE))

    held = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (d is not None and len(held.get(key(x), ())) > 1 and min(held[key(x)]) < d)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, n):
    words = WORD.findall(lower(text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(docs, n, percent):
    """[(doc_id, set size, component)]; rows of one id are one node."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted, seen = collections.defaultdict(list), []
    for d, s in sets:
        if d is None:
            continue
        common = collections.Counter(j for x in s for j in inverted[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(seen[j][1]) - c):
                a, b = find(d), find(seen[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(len(seen))
        seen.append((d, s))
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def maximal_conversations(rows):
    turns = collections.defaultdict(lambda: collections.defaultdict(list))
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv][turn].append((role, text))
    order = lambda t: (t is not None, t or 0)
    whole = {c: [(t, sorted(x[t], key=str)) for t in sorted(x, key=order)] for c, x in turns.items()}
    return {
        c for c, x in whole.items()
        if not any(y[: len(x)] == x and (len(y) > len(x) or e < c) for e, y in whole.items() if e != c)
    }
