from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from factloom.llm import nearcopies
from tests.llm.helpers import ODD, documents, with_clashes


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def similarity(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def plain_kept(rows, least=0.8):
    """Indices of rows kept: the smallest id of each group of linked texts."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similarity(rows[i][1], rows[j][1]) >= least:
            root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def changed(rng, words, low, high):
    """A copy with words changed here and there, of a similarity within the bounds."""
    while True:
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randint(1, len(words) // 40)):
            copy[at] = f"x{rng.randrange(10**9)}"
        if low <= similarity(" ".join(words), " ".join(copy)) <= high:
            return copy


def planted(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([120, 200, 400]))]
        rows.append((2 * i, " ".join(words)))
        low = [0.8, 0.85, 0.9, 0.6][i % 4]
        rows.append((2 * i + 1, " ".join(changed(rng, words, low, 0.78 if low == 0.6 else low + 0.05))))
    return rows


def test_stage_drops_near_copies_and_nothing_else(spark):
    rows = planted()
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    expected = plain_kept(rows)
    assert len(expected) == 75
    assert sorted(r["doc_id"] for r in got.collect()) == expected


def test_one_key_with_many_groups(spark):
    """A chain, two groups and single texts that share most shingles: each pair of groups is compared."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    rows = [(100, " ".join(words))]
    for i in range(12):
        rows.append((i, " ".join(changed(rng, words, 0.7, 0.9))))
    rows += [(50 + i, " ".join(changed(rng, words[:75] + [f"v{j}" for j in range(25)], 0.7, 0.95))) for i in range(12)]
    got = nearcopies.kept_rows(documents(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


@pytest.mark.parametrize("seed", range(3))
def test_families_of_borderline_copies(spark, seed, monkeypatch):
    """Copies of copies around the threshold, of several lengths; fingerprints link none of them beforehand."""
    monkeypatch.setattr(nearcopies.simhash, "fingerprint", lambda text, width: xxhash.xxh64_intdigest(text or ""))
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        texts = [[f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]]
        for _ in range(14):
            words = list(rng.choice(texts))
            for _ in range(rng.choice([1, 2, 3])):
                at = rng.randrange(len(words))
                span = rng.choice([0, 1, len(words) // 16])
                words[at : at + span] = [f"x{rng.randrange(10**9)}" for _ in range(rng.choice([0, 1, span]))]
            texts.append(words)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(texts)]
    pairs = [similarity(a[1], b[1]) for a, b in itertools.combinations(rows, 2)]
    assert sum(0.75 < s < 0.85 for s in pairs) > 20
    got = nearcopies.kept_rows(documents(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_rows_meet_only_where_they_may_be_similar(spark):
    """Many texts with a passage in common do not meet, and a group of equal sets costs a pair for each row."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join(own(50) + passage + own(50)) for _ in range(80)]
    counts = np.zeros(nearcopies.BUCKETS, np.uint32)
    for text in texts:
        np.add.at(counts, nearcopies._bucket(nearcopies.shingles(text)), 1)
    shared = nearcopies.shingles(" ".join(passage))
    firsts = [nearcopies.first_shingles(nearcopies.shingles(t), counts, 0.8) for t in texts]
    assert not any(np.isin(f, shared).any() for f in firsts)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_similar_sets_share_a_first_shingle(least):
    rng = np.random.RandomState(7)
    counts = rng.randint(0, 4, nearcopies.BUCKETS).astype(np.uint32)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        drop, add = rng.randint(0, n // 3 + 1, 2)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.randint(0, 2**62, add).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if not len(b) or common < least * (len(a) + len(b) - common) - 1e-9:
            continue
        small, large = sorted((a, b), key=len)
        index = nearcopies.first_shingles(small, counts, least)
        index = index[: len(small) - int(np.ceil(2 * least / (1 + least) * len(small) - 1e-9)) + 1]
        assert np.isin(index, nearcopies.first_shingles(large, counts, least)).any()


def test_signs_differ_no_more_than_sets():
    rng = np.random.RandomState(8)
    for n in (1, 5, 50, 500, 5000):
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: rng.randint(0, n + 1)], rng.randint(0, 2**62, rng.randint(0, n + 1)).astype(np.uint64))))
        apart = sum(bin(x).count("1") for x in (nearcopies.signs(a) ^ nearcopies.signs(b)).view(np.uint64).tolist())
        assert apart <= len(np.setxor1d(a, b))
        if n < 100:
            assert apart >= 0.7 * len(np.setxor1d(a, b))


def test_counts_of_buckets(spark):
    rows = planted()
    expected = np.zeros(nearcopies.BUCKETS, np.int64)
    for _, text in rows:
        np.add.at(expected, nearcopies._bucket(nearcopies.shingles(text)), 1)
    assert (nearcopies.bucket_counts(documents(spark, rows).select("text"), 5) == expected).all()


@pytest.mark.parametrize("text", [None, "", "a", "A b c", "one TWO three four five six", "word " * 70000])
def test_shingles(text):
    assert len(nearcopies.shingles(text)) == len(plain_set(text))


def test_odd_rows(spark):
    docs = with_clashes(documents(spark, ODD))
    got = nearcopies.kept_rows(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 4, 5, 6, 7]
    assert nearcopies.kept_rows(documents(spark, [])).count() == 0
