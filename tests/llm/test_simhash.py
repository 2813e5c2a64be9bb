from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash
from tests.llm.helpers import ODD, documents, with_clashes

RNG = np.random.RandomState(5)


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_groups(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {frozenset(v for v in values if find(v) == r) for r in map(find, values)}


def near(n, spread):
    base = [int(x) for x in RNG.randint(0, 1 << 62, 8)]
    return {base[RNG.randint(8)] ^ sum(1 << int(b) for b in RNG.randint(0, 64, RNG.randint(spread))) for _ in range(n)}


def test_fingerprint():
    for text in [None, "", " \t", "a", "A b", "one TWO three four", "ÀÉ é x\x0by z", "word " * 70000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [5, simhash.HOT])
def test_links(spark, hot):
    values = near(250, 5)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = simhash.links(spark.createDataFrame(signed, "fingerprint long"), 3, hot).collect()
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in got:
        root[find(r["a"] % (1 << 64))] = find(r["b"] % (1 << 64))
    assert {frozenset(v for v in values if find(v) == r) for r in map(find, values)} == plain_groups(values, 3)


def test_large_bucket():
    values = np.array(sorted(near(700, 6)), np.uint64)
    a, b = simhash.linked(np.zeros(len(values), np.int64), values, 3)
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    assert {frozenset(v for v in root if find(v) == r) for r in map(find, root)} == plain_groups(list(root), 3)


def test_odd_rows(spark):
    rows = [*ODD, (20, "the same few words in another order here " * 3), (21, "the same few words in another order here " * 3)]
    got = simhash.near_groups(with_clashes(documents(spark, rows)).drop("fingerprint")).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    groups = plain_groups(set(prints.values()), 3)
    expected = []
    for i, t in rows:
        group = next(g for g in groups if prints[t] in g)
        expected.append((i, min((j for j, u in rows if j is not None and prints[u] in group), default=None)))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(expected, key=str)
    kept = simhash.kept_rows(documents(spark, rows)).collect()
    assert len(kept) == len(groups)


def test_empty(spark):
    assert simhash.near_groups(documents(spark, [])).count() == 0
