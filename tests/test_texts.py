"""Text, number and date functions, and the classes of pages."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import jsontext, text
from factloom.operators.ledger import call_cost
from factloom.operators.naming import base_name, source_part
from factloom.operators.profile import page_class
from factloom.operators.stats import price_statistics
from factloom.operators.validate import data_quality, expected_number, extraction_status, found_ratio
from factloom.config import EngineConfig


def apply(spark, values, *fns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = rows.select("i", *[f(F.col("v")) for f in fns]).orderBy("i").collect()
    return [r[1] if len(fns) == 1 else tuple(r[1:]) for r in out]


def test_price(spark):
    texts = ["$3,400", "US $225.00", "279", None, "Free", "499.99", "$1,234,567.5"]
    assert apply(spark, texts, text.price) == [3400.0, 225.0, 279.0, None, None, 499.99, 1234567.5]


def test_magnitude(spark):
    texts = ["(1.3K)", "2005 Reviews", "98.3% positive", "(15K)", "2M sold", "none", None, "5 KB"]
    assert apply(spark, texts, text.magnitude) == [1300.0, 2005.0, 98.3, 15000.0, 2e6, None, None, 5.0]


def test_first_integer(spark):
    assert apply(spark, ["16", "about 30 or 40", "", None, "none"], text.first_integer) == [16, 30, 0, 0, 0]


def test_previews(spark):
    assert apply(spark, ["a" * 50, "a" * 51], lambda v: text.preview(v, 50)) == ["a" * 50, "a" * 50 + "..."]


def test_words(spark):
    assert apply(spark, ["  a bb  ccc dd "], lambda v: text.first_words(v, 2, 2)) == ["bb ccc"]
    assert apply(spark, ["  a bb  ccc dd "], lambda v: text.first_words(v, 3)) == ["a bb ccc"]


def test_listing_dates(spark):
    texts = ["Dec-26 07:49", "12/17", "Wed Dec 24 2025 14:11:46 GMT-0800 (PST)", "soon", None]
    got = apply(spark, texts, lambda v: text.listing_date(v, F.lit("2025")))
    assert got == [
        datetime.datetime(2025, 12, 26, 7, 49), datetime.datetime(2025, 12, 17),
        datetime.datetime(2025, 12, 24, 14, 11, 46), None, None,
    ]


def test_stem(spark):
    assert apply(spark, ["/a/b.c/x.y.html", "plain", "/q/.html"], text.stem) == ["x.y", "plain", ".html"]


@pytest.mark.parametrize(
    ("page_type", "item_count", "kind"),
    [
        ("auction results", "multiple", "auction"),
        ("Live Bidding", "1", "auction"),
        ("page", "1", "single"),
        ("single product", "single", "single"),
        ("product listing", "16", "single"),
        ("product listing", "multiple (estimate 30)", "list"),
        ("page", "many", "list"),
        ("page", "16", "list"),
        ("Search page", "", "list"),
        ("catalog", None, "list"),
        ("page", "", "unknown"),
        (None, None, "unknown"),
        ("page", "0", "unknown"),
    ],
)
def test_page_class(spark, page_type, item_count, kind):
    df = spark.createDataFrame([(page_type, item_count)], "t string, c string")
    assert df.select(page_class(F.col("t"), F.col("c"))).first()[0] == kind


def test_source_part(spark):
    assert apply(spark, ["eBay", "America's Tire", "", None, "***", "A" * 30], source_part) == [
        "Ebay", "Americastire", "Unknown", "Unknown", "Unknown", "A" + "a" * 19,
    ]


def test_long_names_lose_product(spark):
    def name(product: str, source: str, limit: int = 100):
        cols = [F.lit("20250102-0304"), F.lit(source), F.lit(product), F.lit("list")]
        return spark.range(1).select(base_name(*cols, limit)).first()[0]

    assert name("p" * 10, "S") == "20250102-0304-S-pppppppppp-list"
    cut = name("p" * 200, "S")
    # 100 - 13 - 3 separators, less source, kind and two separators, is left for the product
    assert cut == "20250102-0304-S-" + "p" * (100 - 13 - 3 - 1 - 4 - 2) + "-list"
    assert name("p" * 200, "S" * 90) == "20250102-0304-" + "S" * 90 + "-list"


def test_quality_steps(spark):
    cfg = EngineConfig()
    cases = [
        # item count text, found, missing share -> quality, status
        ("24 items", 24, 0.0, "excellent", "success"),
        ("24", 22, 0.0, "good", "success"),
        ("24", 18, 0.0, "fair", "extraction_incomplete"),
        ("24", 2, 0.0, "poor", "extraction_incomplete"),
        ("24", 0, 0.0, "poor", "extraction_failed"),
        ("24", 24, 0.15, "excellent", "success"),
        ("24", 24, 0.16, "good", "success"),
        ("multiple (estimate)", 2, 0.0, "excellent", "success"),
        ("multiple", 1, 0.0, "fair", "extraction_incomplete"),
        ("multiple", 0, 0.0, "poor", "extraction_failed"),
        ("single", 1, 0.0, "excellent", "success"),
        ("multiple (estimate 100+)", 20, 0.0, "poor", "extraction_incomplete"),
    ]
    df = spark.createDataFrame(cases, "c string, n bigint, m double, q string, s string")
    found = found_ratio(expected_number(F.col("c")), F.col("n"))
    rows = df.select("*", data_quality(found, F.col("m"), cfg).alias("dq"), extraction_status(found, cfg).alias("st"))
    for r in rows.collect():
        assert (r.dq, r.st) == (r.q, r.s), r


def test_json_items_keep_order_types_and_gaps(spark):
    texts = [
        '{"items":[{"b":1,"a":null,"q":"x\\"y é"},"text",5,null,{"a":[1,{"z":2}],"t":true,"p":499.99}]}',
        '{"item":{"t":"x"}}',
        '{"other":1}',
        "{broken",
    ]
    rows = apply(spark, texts, jsontext.extraction_shape, jsontext.extraction_items)
    assert [r[0] for r in rows] == ["items", "item", "unexpected", "unexpected"]
    first = rows[0][1]
    assert len(first) == 5 and first[1] is None and first[2] is None and first[3] is None
    assert [tuple(f) for f in first[0]] == [
        ("b", "1", "long"), ("a", None, "null"), ("q", 'x"y é', "string"),
    ]
    assert [tuple(f) for f in first[4]] == [
        ("a", '[1,{"z":2}]', "array"), ("t", "true", "boolean"), ("p", "499.99", "double"),
    ]
    assert rows[1][1][0][0].value == "x" and rows[2][1] == [] and rows[3][1] == []


def test_one_long_number_does_not_end_the_job(spark):
    rows = spark.createDataFrame([("k", "$5"), ("k", "123456789012345678"), ("k", None)], "key string, price string")
    got = price_statistics(rows, ["key"], F.col("price")).first()
    assert (got.items, got.priced, got.price_sum) == (3, 1, 5)


def test_costs_are_exact(spark):
    cost = call_cost(F.lit(7), F.lit(9), F.lit("0.001251"), F.lit("0.000001"))
    assert spark.range(1).select(cost.alias("c")).first().c == Decimal("8.766E-9")
