"""Substring dedup by words and by bytes, against plain counts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from factloom.llm import recompression, suffixes
from tests.llm.helpers import ODD, documents, with_clashes

RNG = np.random.RandomState(9)


def texts(n, words, vocabulary):
    pool = [" ".join(f"w{x}" for x in RNG.randint(0, vocabulary, words)) for _ in range(6)]
    out = []
    for i in range(n):
        own = " ".join(f"w{x}" for x in RNG.randint(0, vocabulary, RNG.randint(1, words)))
        parts = [own, pool[RNG.randint(6)], pool[RNG.randint(6)][RNG.randint(40) :]]
        out.append((i % (n - 3), "  ".join(parts[: RNG.randint(1, 4)])))
    return [*out, (90, "the " * 300), (91, "x " + "the " * 200), (92, "a b " * 100), (93, "b a " * 100)]


def plain_words(rows, width):
    first = {}
    split = [(10**18 if i is None else i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [2, 40, 100000])
def test_words(spark, vocabulary):
    rows = texts(40, 60, vocabulary) + ODD
    got = recompression.remove_repeats(with_clashes(documents(spark, rows))).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == plain_words(rows, 13)


def plain_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "levels"), [(1, 0), (2, 2), (suffixes.HOT, 4)])
def test_bytes(spark, monkeypatch, hot, levels):
    monkeypatch.setattr(suffixes, "LEVELS", levels)
    rows = [r for r in texts(40, 60, 1000) + ODD if len(r[1] or "") < 5000] + [(7, "é✓" * 90)]
    got = suffixes.remove_repeats(with_clashes(documents(spark, rows)), length=100, hot=hot).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == plain_bytes(rows, 100)


def test_segments(spark, monkeypatch):
    rows = [(1, "".join(map(str, RNG.randint(0, 10, 3000)))), (2, "".join(map(str, RNG.randint(0, 10, 900))))]
    rows += [(3, rows[0][1][500:1700] + rows[1][1][100:400])]
    monkeypatch.setattr(suffixes, "SEGMENT", 256)
    found = [b for g in suffixes._segments([t for _, t in rows], 100) for b in [g]]
    assert len(found) > 10 and sum(len(g[0]) for g in found) > 15
    got = suffixes.remove_repeats(documents(spark, rows), length=100).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == plain_bytes(rows, 100)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 50, 200, 301])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_suffix_array(n, letters):
    text = RNG.randint(1, letters + 1, n)
    assert suffixes.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_empty(spark):
    assert recompression.remove_repeats(documents(spark, [])).count() == 0
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0
