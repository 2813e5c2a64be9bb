from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from factloom.llm import spelling
from tests.llm.helpers import ODD, documents, with_clashes


def plain_words(rows, shortest=5, least=3, typo_every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, w, n, len(near), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return out


def found(df):
    rows = df.collect()
    out = {r["word"]: [r[c] for c in ("form", "root", "n", "n_near", "form_n")] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    letters = "abÀÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6]))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([20, 200, 2000])]).title() for _ in range(200))) for i in range(120)]
    expected = plain_variants(plain_words(rows))
    assert sum(v[0] is not None for v in expected.values()) > 50 and any(v[0] != v[1] for v in expected.values() if v[0])
    assert found(spelling.variants(documents(spark, rows), typo_every=97)) == expected


def test_doubled_letters_count_once(spark):
    rows = [(1, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa abaaaa abaaaa abaaaa baaaa baaaa baaaa")]
    expected = plain_variants(plain_words(rows, typo_every=None))
    assert expected["aaaaa"][3] == 3
    assert found(spelling.variants(documents(spark, rows))) == expected


def test_long_words(spark):
    """Words around the length from which rotations are known by digests, with ties and a run of 20,000 letters."""
    rng = random.Random(4)
    rows, base = [], "".join(rng.choice("abc") for _ in range(spelling.LONG + 3))
    for length in range(spelling.LONG - 2, spelling.LONG + 4):
        word = base[:length]
        for copy in (word, word[:10] + "x" + word[11:], word[:40] + "y" + word[41:], word[:30] + word[31:]):
            rows.append((len(rows), f"{copy} " * rng.choice([3, 3, 7, 20])))
    huge = "pq" * 10_000
    rows.append((999, f"{huge} {huge} {huge} {huge}z {huge}z {huge}z " + f"{huge[:-1]} " * 9))
    expected = plain_variants(plain_words(rows))
    assert expected[huge][3] == 2
    assert found(spelling.variants(documents(spark, rows), typo_every=97)) == expected


def test_chains_end_at_the_root(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(1, " ".join(f"{w} " * (3 * 2**i) for i, w in enumerate(chain)))]
    got = found(spelling.variants(documents(spark, rows)))
    assert got == plain_variants(plain_words(rows, typo_every=None))
    assert got["aaaaa"][:2] == ["aaaab", "bbbbb"]


def test_odd_rows(spark):
    rows = [*ODD, (8, "Übung übung ÜBUNG Übung Übung"), (None, "Übung"), (9, "don't’s"), (10, "\U0001f4a9wordsĀwords words")]
    docs = with_clashes(documents(spark, rows)).withColumnsRenamed({"row": "word", "key": "prefix", "digest": "root"})
    got = found(spelling.variants(docs, shortest=2, least=1, typo_every=2))
    assert got == plain_variants(plain_words(rows, 2, 1, 2))
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "")])).count() == 0
