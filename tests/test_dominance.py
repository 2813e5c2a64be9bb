"""Dominant values: both forms against a plain count, ties, thresholds, odd values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators import dominance as D
from factloom.schemas import ITEMS

CFG = EngineConfig()


def page_rows(spark, pages: list[list[dict | None]]):
    def kind(v):
        return "null" if v is None else "string" if isinstance(v, str) else "long"

    rows = [
        (
            i,
            [
                None if item is None else [(k, None if v is None else str(v), kind(v)) for k, v in item.items()]
                for item in items
            ],
        )
        for i, items in enumerate(pages)
    ]
    return spark.createDataFrame(rows, f"page_id bigint, items {ITEMS}")


def modes(df) -> dict:
    done = D.page_dominance(df, CFG)
    return {
        r.page_id: ({d.kind: (d.value, d.n) for d in r.dominance}, {d.kind for d in r.dominance if d.dominant}, r.first)
        for r in done.withColumn("first", D.first_attribute(F.col("dominance"), CFG)).collect()
    }


def test_values_written_by_hand(spark):
    mixed = [
        {"brand": "Aa", "title": "Aa One Two Three", "size": " s "},
        {"brand": "Aa", "product_name": "Aa One Two", "title": "else", "size": "s"},
        {"brand": " Aa", "name": "One x Two Aa", "size": None},
        None,
        {"brand": 7, "title": "Aa One Two", "color": "red"},
        {"brand": "", "title": "Bb", "condition": "new"},
    ]
    nothing = [{"brand": "Aa", "title": "Aa"}, {"brand": None, "title": "One Two"}]
    got = modes(page_rows(spark, [mixed, nothing]))
    assert got[0][0] == {
        "brand": ("Aa", 3),
        "brand_model": ("Aa One Two", 3),
        "size": ("s", 2),
        "color": ("red", 1),
        "condition": ("new", 1),
    }
    assert got[0][1] == {"brand", "brand_model", "size"}
    assert got[1][0] == {"brand": ("Aa", 1)} and got[1][1] == {"brand"}


def test_ties_thresholds_and_order(spark):
    tie = [{"size": "z"}, {"size": "a"}]  # the first seen wins, not the smaller text
    exact = [{"brand": "B"}, {"brand": "B"}, {"x": "1"}, {"x": "1"}]  # exactly one half
    attribute = [{"color": "red"}] * 3 + [{"x": "1"}] * 7  # exactly three tenths
    below = [{"color": "red"}] * 2 + [{"x": "1"}] * 8
    order = [{"type": "t"}, {"capacity": "c", "type": "t"}, {"capacity": "c"}]  # type appears first
    same_item = [{"type": "t", "capacity": "c"}, {"type": "t", "capacity": "c"}]  # then the fixed order
    got = modes(page_rows(spark, [tie, exact, attribute, below, order, same_item, [{"size": "x"}]]))
    assert got[0][0]["size"] == ("z", 1)
    assert got[1][1] == {"brand"}
    assert got[2][1] == {"color"} and got[3][1] == set()
    assert got[4][2] == "t" and got[5][2] == "c"
    assert got[6][1] == set()  # one item dominates nothing


def test_table_form_equals_page_form(spark):
    rng = random.Random(11)
    pages = [
        [{k: rng.choice("abc") for k in ("size", "color") if rng.random() < 0.8} for _ in range(rng.randint(1, 9))]
        for _ in range(80)
    ]
    by_page = modes(page_rows(spark, pages))
    flat = [(i, p, item.get("size"), item.get("color")) for i, items in enumerate(pages) for p, item in enumerate(items)]
    table = spark.createDataFrame(flat, "page_id bigint, pos int, size string, color string")
    kinds = {"size": F.col("size"), "color": F.col("color")}
    wide = D.dominant_values(table, ["page_id"], ["pos"], kinds, {"size": 0.3, "color": 0.3})
    rows = wide.withColumn("first", D.first_dominant(["size", "color"])).collect()
    assert len(rows) == len(pages)
    for r in rows:
        values = {k: (r[f"{k}_value"], r[f"{k}_n"]) for k in kinds if r[f"{k}_value"] is not None}
        assert values == by_page[r.page_id][0]
        assert {k for k in kinds if r[f"{k}_dominant"]} == by_page[r.page_id][1]
        assert r.first == by_page[r.page_id][2]


def test_table_form_has_no_window_and_no_join(spark):
    table = spark.range(10).select(
        (F.col("id") % 2).alias("page_id"), F.col("id").alias("pos"), F.lit("x").alias("size")
    )
    wide = D.dominant_values(table, ["page_id"], ["pos"], {"size": F.col("size")}, {"size": 0.3})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("empty", [[], [None, None]])
def test_pages_without_values(spark, empty):
    got = modes(page_rows(spark, [empty]))
    assert got[0] == ({}, set(), None)


def test_table_form_moves_no_row_per_kind(spark):
    table = spark.range(10).select((F.col("id") % 2).alias("page_id"), F.col("id").alias("pos"), F.lit("x").alias("size"))
    wide = D.dominant_values(table, ["page_id"], ["pos"], {"size": F.col("size")}, {"size": 0.3})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # printed from the top: nothing is dealt out after the rows per kind


def test_table_form_of_repeated_and_null_keys(spark):
    rng = random.Random(3)
    flat = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 9), rng.choice([None, "", "a", "b"]), rng.choice([None, "a", "c"])) for _ in range(400)]
    table = spark.createDataFrame(flat + flat[:50], "page_id int, pos int, size string, color string").repartition(5)
    kinds = {"size": F.col("size"), "color": F.col("color")}
    wide = D.dominant_values(table, ["page_id"], ["pos", "size"], kinds, {"size": 0.3, "color": 0.3}).collect()
    assert len(wide) == 4
    for r in wide:
        own = [x for x in flat + flat[:50] if x[0] == r.page_id]
        first = {v: min((x[1], x[2] is not None, x[2] or "") for x in own if x[3] == v) for v in "ac"}
        n = {v: sum(x[3] == v for x in own) for v in "ac"}
        best = min("ac", key=lambda v: (-n[v], first[v], v))
        assert (r["items"], r.color_value, r.color_n) == (len(own), best, n[best])
        assert r.color_share == n[best] / len(own)
