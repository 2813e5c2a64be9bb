from __future__ import annotations

import itertools
import random
import re

import pytest

from factloom.llm import filter_audit
from tests.llm.helpers import ODD, documents, with_clashes


def plain_masks(rows):
    """The letters each (doc_id, text, source) row fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [i for i, t, _ in rows if (t or "") == text and i is not None]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": doc_id is not None and min(same) < doc_id,
        }
        out.append({f for f, failed in fails.items() if failed})
    return out


def plain_audit(rows, labels):
    """Run every order over every document."""
    fails = plain_masks(rows)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                shapley[letter] += len(here)
                total = sum(letter in f for _, f in docs)
                out[part, "".join(order), step] = [
                    len(left),
                    len(here),
                    total - len(here),
                    sum(f == {letter} for _, f in docs),
                    sum(i in good for i, _ in here),
                    sum(i in toxic for i, _ in here),
                    letter,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return out


def audited(df):
    assert df.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in rows}
    assert len(found) == len(rows)
    return found


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def random_rows():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(30 if rng.random() < 0.3 else 10**6)}" for _ in range(rng.choice([5, 199, 200, 300]))]
        if rng.random() < 0.3:
            words[0] = rng.choice(["A" * 60, "50%", "x|y"])
        rows.append((i, " ".join(words), rng.choice(["a", "b", None])))
    rows += [(200 + i, rows[rng.randrange(5)][1], rng.choice(["a", "", "c"])) for i in range(60)]
    return rows


def test_equals_every_order_run_over_every_document(spark):
    rows = random_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 260, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audited(filter_audit.audit(docs, labels_of(spark, labels))) == plain_audit(rows, labels)


def test_odd_rows(spark):
    rows = [(i, t, None) for i, t in ODD]
    labels = [(4, 1, 1), (5, 0, None)]
    docs = with_clashes(documents(spark, ODD)).withColumnsRenamed({"weight": "part", "tokens": "mask", "gone": "good"})
    assert audited(filter_audit.audit(docs, labels_of(spark, labels))) == plain_audit(rows, labels)


def test_empty_tables(spark):
    assert filter_audit.audit(documents(spark, []), labels_of(spark, [])).count() == 0
    found = audited(filter_audit.audit(documents(spark, [(1, "a")]), labels_of(spark, [])))
    assert len(found) == 600 and found["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("filters", ["A", "AB", "ABCD"])
def test_walk_stores_the_survivors_of_every_subset(filters):
    import numpy as np

    counted = np.random.RandomState(1).randint(0, 9, (1 << len(filters), 3)).astype(np.int64)
    states = filter_audit.gray_walk(counted)
    for subset in range(len(counted)):
        left = [m for m in range(len(counted)) if not m & subset]
        assert states[subset].tolist() == counted[left].sum(axis=0).tolist()
