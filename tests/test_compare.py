"""Run comparison on small runs, with empty runs and no cost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.operators import compare as C
from factloom.operators.fields import gaps
from factloom.plans.run_comparison import RunComparison
from factloom.schemas import ITEMS
from factloom.sources.prices import price_list

ROW = f"page_id bigint, clean_html string, items {ITEMS}, shape string, time_seconds double"
HTML = "x" * 4000


def s(k, v, t="string"):
    return (k, v, t)


def compared(spark, a, b, seconds=(5.0, 1.0), models=("gemini-2.0-flash", "gemini-2.5-flash")):
    left = spark.createDataFrame([(i, HTML, items, "items", seconds[0]) for i, items in enumerate(a)], ROW)
    right = spark.createDataFrame([(i, HTML, items, "items", seconds[1]) for i, items in enumerate(b)], ROW)
    return RunComparison.of_runs(left, right, "page_id", models, price_list(spark))


def test_diff_and_verdicts(spark):
    a = [[[s("title", "Lamp"), s("price", "5", "long"), s("note", None, "null"), s("old", "1")]]]
    b = [[[s("title", "Lamp"), s("price", "5.0", "double"), s("note", "", "string"), s("new", "v" * 60)], [s("t", "2")]]]
    result = compared(spark, a, b)
    rows = result.diff().collect()
    assert all(len(r.a_shown) <= 53 and (r.a_value is None or r.a_shown[:50] == r.a_value[:50]) for r in rows)
    diff = {(r.pos, r.field): (r.a_shown, r.b_shown, r.match) for r in rows}
    assert diff == {
        (0, "title"): ("Lamp", "Lamp", True),
        (0, "price"): ("5", "5.0", True),
        (0, "note"): ("None", "", False),
        (0, "old"): ("1", "MISSING", False),
        (0, "new"): ("MISSING", "v" * 50 + "...", False),
        (1, "t"): ("MISSING", "2", False),
    }
    v = result.verdicts().first()
    assert (v.a_items, v.b_items, v.a_total_fields, v.b_total_fields) == (1, 2, 4, 5)
    assert (v.a_populated, v.b_populated, v.a_missing, v.b_missing) == (3, 4, 1, 1)
    assert (v.items_winner, v.total_fields_winner, v.populated_winner, v.missing_winner) == ("b", "b", "b", "tie")
    assert (v.avg_fields_winner, v.time_winner, v.cost_winner) == ("a", "b", "a")
    assert (v.quality_gain, v.verdict) == (1, "marginal")


def test_empty_runs_and_no_cost(spark):
    result = compared(spark, [[], []], [[], [[s("a", "1")] * 1]], models=("free", "also free"))
    rows = {r.page_id: r for r in result.verdicts().collect()}
    assert rows[0].a_items == 0 and rows[0].a_avg_fields_per_item == 0.0
    assert rows[0].a_populated_pct is None and rows[0].cost_increase_pct is None
    assert rows[0].verdict == "use a" and rows[1].verdict == "marginal"
    assert rows[0].items_winner == "tie" and rows[1].items_winner == "b"
    originals = spark.createDataFrame([(0, "zero.html"), (1, "one.html")], "page_id bigint, original_file string")
    reports = result.reports(originals).collect()
    texts = {r.page_id: r.comparison_markdown for r in reports}
    assert "**Test File:** zero.html" in texts[0] and "n/a" in texts[0]
    assert "MISSING" not in texts[1]  # no sample unless both runs found an item


def test_item_diff_equals_the_table_diff(spark):
    rng = random.Random(3)

    def item():
        kinds = [("string", "x"), ("string", "y"), ("long", "1"), ("double", "1.0"), ("null", None), ("string", None)]
        fields = []
        for name in rng.sample("abcdef", rng.randint(0, 5)):
            t, v = rng.choice(kinds)
            fields.append((name, v, t))
        return fields

    pairs = [([item()], [item()]) for _ in range(60)]
    result = compared(spark, [p[0] for p in pairs], [p[1] for p in pairs])
    table = sorted(tuple(r) for r in C.first_item(result.diff()).drop("pos", "a_value", "b_value").collect())
    in_row = result.verdicts().select(
        "page_id", F.explode(C.item_diff(F.col("a__first"), F.col("b__first"))).alias("d")
    )
    assert sorted(tuple(r) for r in in_row.select("page_id", "d.*").collect()) == table


def test_ties_within_limits(spark):
    pair = spark.createDataFrame(
        [(1, 1, 10, 10, 5, 5, 5, 5, 2.00, 2.05, 10.0, 11.9), (1, 1, 10, 10, 5, 12, 5, 4, 2.0, 2.5, 10.0, 5.0)],
        "a_items int, b_items int, a_total_fields int, b_total_fields int, a_populated int, b_populated int,"
        "a_missing int, b_missing int, a_avg_fields_per_item double, b_avg_fields_per_item double,"
        "a_time_seconds double, b_time_seconds double",
    ).withColumns({"a_cost": F.lit(1.0), "b_cost": F.lit(3.0)})
    first, second = C.recommendation(C.winners(pair)).orderBy("b_populated").collect()
    assert (first.avg_fields_winner, first.time_winner, first.missing_winner) == ("tie", "tie", "tie")
    assert (second.avg_fields_winner, second.time_winner, second.missing_winner) == ("b", "b", "b")
    assert second.verdict == "use b" and second.cost_per_extra_field == 2.0 / 7
    assert second.cost_increase_pct == 200.0 and second.b_cost_many_pages == 300.0


def test_gaps(spark):
    rows = [(1, 0, "price", "5"), (1, 0, "condition", "N/A"), (1, 1, "price", None), (1, 1, "condition", "new"),
            (1, 2, "price", "6"), (1, 2, "condition", "used")]
    df = spark.createDataFrame(rows, "page_id int, pos int, field string, value string")
    row = gaps(df, ["page_id"], ["pos"], ["price", "condition"]).first()
    assert (row["items"], row.without_price, row.without_condition, row.comparable_items) == (3, 1, 1, 1)
