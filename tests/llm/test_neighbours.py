from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import neighbours

RNG = np.random.RandomState(4)
VECTORS = "vec_id long, embedding array<double>, id string, vec int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def plain(rows, top=20):
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            scored = sorted((-float(np.dot(q, v)), j) for j, v in rows if j != i)[:top]
            out[i] = [(j, -s) for s, j in scored]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_searched_whole(spark):
    rows = [(i, RNG.randint(-3, 4, 5).astype(float).tolist()) for i in range(120)]
    rows = [(i, v) for i, v in rows if any(v)]
    got = by_query(neighbours.nearest(table(spark, rows), F.col("id") % 20 == 0))
    assert got == plain(rows)


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, monkeypatch, lengths):
    x = RNG.randn(3000, 32)
    x /= np.linalg.norm(x, axis=1)[:, None] * (RNG.uniform(0.5, 2, (3000, 1)) if lengths else 1)
    rows = list(enumerate(x.tolist()))
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1000)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    got, best = by_query(neighbours.nearest(table(spark, rows), F.col("id") % 20 == 0)), plain(rows)
    assert got.keys() == best.keys() and all(len(v) == 20 for v in got.values())
    found = sum(len({j for j, _ in got[q]} & {j for j, _ in best[q]}) for q in best)
    assert found >= 0.9 * 20 * len(best)
    for q, near in got.items():
        assert all(s == pytest.approx(float(x[q] @ x[j]), abs=1e-12) for j, s in near)


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (2, [0.0, 2.0])]
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0])]
    bad += [(120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (140, [1.0, 1.0, 1.0])]
    got = by_query(neighbours.nearest(table(spark, good + bad), F.col("id") % 20 == 0))
    assert got == {0: [(1, 0.5), (2, 0.5), (2, 0.0), (3, -1.0)]}


def test_empty(spark):
    assert neighbours.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0
