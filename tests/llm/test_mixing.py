from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing
from tests.llm.helpers import ODD, documents, with_clashes

ROWS = [(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", None][i % 4 if i % 3 else 0], ["en", "de"][i // 5 % 2]) for i in range(400)]


def mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return mixing.mix(docs, {"source": docs["source"], "lang": docs["lang"]}, **options).collect()


def test_margins_meet_their_targets(spark):
    wanted = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0), (None, 1.0), ("absent", 9.0)], "value string, share double")
    got = mixed(spark, ROWS, targets={"source": wanted}, alpha=0.5, budget=0.3)
    share = {}
    for r in got:
        share[r["source"]] = share.get(r["source"], 0) + r["mix"]["tokens"] * r["mix"]["weight"]
    assert share == pytest.approx({"a": 0.2, "b": 0.4, "c": 0.2, None: 0.2}, abs=1e-5)


def test_against_a_plain_fit(spark):
    got = mixed(spark, ROWS, alpha=0.7, budget=0.4, seed=3)
    cells = {}
    for _, text, source, lang in ROWS:
        cells[source, lang] = cells.get((source, lang), 0) + len(text.split())
    weight = dict.fromkeys(cells, 1.0)
    for _ in range(200):
        for at in (0, 1):
            values = {c[at] for c in cells}
            own = {v: sum(n for c, n in cells.items() if c[at] == v) ** 0.7 for v in values}
            for v in values:
                have = sum(n * weight[c] for c, n in cells.items() if c[at] == v)
                for c in cells:
                    if c[at] == v:
                        weight[c] *= own[v] / sum(own.values()) / have
    total = sum(cells.values())
    low, high = 0.0, 1e9
    for _ in range(200):
        scale = (low + high) / 2
        kept = sum(n * min(1, scale * weight[c]) for c, n in cells.items())
        low, high = (scale, high) if kept < 0.4 * total else (low, scale)
    for r in got:
        expected = min(1, scale * weight[r["source"], r["lang"]])
        assert r["mix"]["probability"] == pytest.approx(expected, rel=1e-4)
        drawn = int(hashlib.md5(f"3:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r["mix"]["kept"] == (drawn < r["mix"]["probability"])
    kept = sum(r["mix"]["tokens"] for r in got if r["mix"]["kept"])
    assert abs(kept / total - 0.4) < 0.1


@pytest.mark.parametrize("source", ["a", None])
def test_three_margins_with_one_source(spark, source):
    """The first margin holds from the start; the others still have to meet."""
    cells = {("en", "prose"): 80, ("en", "table"): 5, ("de", "prose"): 5, ("de", "table"): 10}
    rows = [(i, "w " * n, source, *c) for i, (c, n) in enumerate(cells.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    got = mixing.mix(docs, {m: docs[m] for m in ("source", "lang", "topic")}, alpha=0.7).collect()
    for at, margin in enumerate(("lang", "topic")):
        values = {c[at] for c in cells}
        own = {v: sum(n for c, n in cells.items() if c[at] == v) ** 0.7 for v in values}
        for v in values:
            have = sum(r["mix"]["tokens"] * r["mix"]["weight"] for r in got if r[margin] == v)
            assert have == pytest.approx(own[v] / sum(own.values()), abs=1e-6)


def test_a_fit_says_what_gap_it_leaves(spark):
    assert {r["mix"]["gap"] < 1e-6 for r in mixed(spark, ROWS)} == {True}
    rows = [(1, "w " * 50, "a", "en"), (2, "w " * 50, "b", "de")]
    source = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    lang = spark.createDataFrame([("en", 0.9), ("de", 0.1)], "value string, share double")
    got = mixed(spark, rows, targets={"source": source, "lang": lang})
    assert all(r["mix"]["gap"] == pytest.approx(0.4, abs=1e-6) for r in got)


def test_the_whole_budget_keeps_all(spark):
    assert all(r["mix"]["kept"] for r in mixed(spark, ROWS, budget=1.0))


def test_odd_rows(spark):
    docs = with_clashes(documents(spark, ODD))
    got = mixing.mix(docs, {"source": docs["source"], "lang": docs["lang"]}, budget=0.5).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() == {*docs.columns, "mix"}
    assert {r["mix"]["tokens"] for r in got if r["text"] is None} == {0}
    empty = documents(spark, [])
    assert mixing.mix(empty, {"source": empty["source"]}).count() == 0
    blank = documents(spark, [(1, None), (2, "")])
    assert mixing.mix(blank, {"source": blank["source"]}).where(F.col("mix.kept")).count() == 0
    assert np.isfinite([r["mix"]["weight"] for r in mixing.mix(blank, {"source": blank["source"]}).collect()]).all()
