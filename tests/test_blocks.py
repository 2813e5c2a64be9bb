"""Repeated blocks and their fields on hand-made pages, and the one pass that finds them."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import tags
from factloom.functions.blocks import Blocks, items_of
from factloom.plans.page_flow import PageFlow

CFG = EngineConfig(min_file_bytes=0, min_raw_chars=0, min_clean_chars=0)


def found(html):
    page = tags.clean(html)
    blocks = Blocks(tags.Elements(page.text, page.tags))
    return blocks, [dict(item) for item in items_of(blocks)]


def validated(spark, html):
    rows = spark.createDataFrame([(1, "http://x.com/f", "f", html)], "page_id long, url string, original_file string, html string")
    return PageFlow(CFG).validated(rows).first()


CARDS = "".join(f'<h2><a href="/{i}">Item {i}</a></h2>' for i in range(30))
PRICED = "".join(f'<li><a href="/p{i}">Part {i}</a> $5</li>' for i in range(5))
ROWS = "".join(f'<tr><td><a href="/r{i}">Row {i}</a></td><td>$7</td></tr>' for i in range(4))


@pytest.mark.parametrize(
    ("html", "n"),
    [
        ("<ul>" + "".join(f'<li><a href="/p{i}">Part {i}</a> $5</li>' for i in range(2)) + "</ul>" + CARDS, 32),
        ("".join(f'<li><a title="a > b" href="/{i}">Item {i}</a></li>' for i in range(5)), 5),
        (f"<ul>{PRICED}</ul><table>{ROWS}</table>", 9),
    ],
)
def test_every_run_counts(spark, html, n):
    row = validated(spark, html)
    assert len(row["items"]) == n and row.hypothesis.item_count == f"multiple (estimate {n})"
    assert (row.status, row.validation.data_quality) == ("success", "excellent")


def test_blocks_without_a_link_are_expected_but_not_found(spark):
    row = validated(spark, "<ul>" + PRICED + "<li>sold $3</li>" * 5 + "</ul>")
    assert row.hypothesis.item_count == "multiple (estimate 10)" and len(row["items"]) == 5
    assert row.status == "extraction_incomplete"


def test_containers_and_inner_lists():
    colors = '<ul><li><a href="/red">red</a></li><li><a href="/blue">blue</a></li></ul>'
    cards = "".join(f'<div class="card"><a href="/{i}">Item {i}</a> $5 {colors}</div>' for i in range(3))
    assert [i["link"] for i in found(cards)[1]] == ["/0", "/1", "/2"]
    sections = "".join(
        f'<div class="part"><p>Part {s}</p><ul>'
        + "".join(f'<li><a href="/{s}{i}">Item</a> $5</li>' for i in range(3))
        + f'</ul><a href="/all{s}">See all</a></div>'
        for s in "ab"
    )
    assert [i["link"] for i in found(sections)[1]] == ["/a0", "/a1", "/a2", "/b0", "/b1", "/b2"]


def test_links_in_running_text_and_breadcrumbs_are_no_items():
    html = '<p>see <a href="/a">this</a> and <a href="/b">that</a></p><p><a href="/c">more</a></p><div><a href="/d">x</a></div>'
    assert found(html)[1] == []


def test_a_link_around_a_card_is_a_block():
    html = "".join(f'<a href="/{i}" class="tile"><h3>Item {i}</h3><span>$5.{i}</span></a>' for i in range(3))
    assert found(html)[1][1] == {"title": "Item 1", "link": "/1", "price": "$5.1"}


def test_fields_are_named_by_tags_headers_labels_and_values():
    cards = "".join(
        f'<article><img src="/i{i}.png"><h3><a href="/{i}">Item {i}</a></h3><b itemprop="price">${i}.50</b>'
        f'<span class="s-item__seller">Shop {i}</span><span>Austin, TX</span><span>Dec-2{i} 10:00</span><span>Free shipping</span>'
        f'<span>(1.{i}K)</span><em>4.{i} out of 5 stars</em><p>Open box</p><p>Item weight: {i} kg</p><i class="old-price">$9{i}</i>'
        f'<u>note {i}</u><a href="/cart">Add to cart</a></article>'
        for i in range(3)
    )
    assert found(cards)[1][2] == {
        "title": "Item 2", "link": "/2", "price": "$2.50", "image": "/i2.png", "seller": "Shop 2", "place": "Austin, TX",
        "date": "Dec-22 10:00", "shipping": "Free shipping", "reviews": "(1.2K)", "rating": "4.2 out of 5 stars",
        "condition": "Open box", "item_weight": "2 kg", "old_price": "$92", "detail": "note 2",
    }
    header = "<thead><tr><th>Name<th>Price<th>Ships from<th>Condition</thead>"
    rows = "".join(f'<tr><td><a href="/{i}">N{i}</a><td>$3<td>Boise<td>{"Odd" if i else "Used"}' for i in range(3))
    assert found(f"<table>{header}<tbody>{rows}</table>")[1][1] == {
        "title": "N1", "link": "/1", "price": "$3", "ships_from": "Boise", "condition": "Odd",
    }


def test_missing_parts_do_not_shift_the_columns():
    html = "<table><tr><th>Name<th>Condition<th>Place</tr>" + "".join(
        f'<tr><td><a href="/{i}">N{i}</a><td>{"" if i == 1 else "Used"}<td>P{i}</tr>' for i in range(3)
    )
    items = found(html + "</table>")[1]
    assert items[1] == {"title": "N1", "link": "/1", "place": "P1"} and items[2]["condition"] == "Used"


def test_prices_do_not_run_into_what_follows():
    html = "".join(f'<li><a href="/{i}">N</a><b>$5</b><span>3{i} left</span></li>' for i in range(2))
    assert [i["price"] for i in found(html)[1]] == ["$5", "$5"]
    split = "".join(f'<li><a href="/{i}">N</a><b>$</b><span>3{i}.50</span></li>' for i in range(2))
    assert [i["price"] for i in found(split)[1]] == ["$30.50", "$31.50"]


@pytest.mark.parametrize(
    ("html", "left", "tags_removed"),
    [
        ("<svg><svg><path d='1'/></svg><text>x</text></svg>b", "b", 3),
        ("<noscript><noscript>x</noscript>y</noscript>b", "b", 2),
        ('<p title="a > b" class=\'c > d\'>e</p>', '<p title="a > b" class=\'c > d\'>e</p>', 0),
        ('<img alt="1 > 0" src="data:image/png;base64,AA">', '<img alt="1 > 0" src="[BASE64_REMOVED]">', 0),
        ("<p title=it's>a</p> don't <b>c</b>", "<p title=it's>a</p> don't <b>c</b>", 0),
        ('<p title="open>a</p>', '<p title="open>a</p>', 0),
        ("a < b <3 c", "a < b <3 c", 0),
        ("<svg><script>'</svg>'</script>x</svg>b", "b", 2),
        ("<iframe src='>'>x</iframe>b<iframe/>c", "bc", 2),
    ],
)
def test_cleaning_knows_quotes_and_nesting(html, left, tags_removed):
    page = tags.clean(html)
    assert (page.text, page.removed_tags) == (left, tags_removed)


@pytest.mark.parametrize(
    "tag",
    ["<div><a href=/x>y</a>$5", "<div>$5<a href=/x>y</a>", "<li><a href=/x>y<ul>", "<div><a href=x>y", '<a href="', "<p a=\"'",
     "<table><tr><td><a href=/x>y</a>", "<dl><dt><a href=/x>y</a><dd>", "<h2><a href=x>y", "&amp", "<svg><svg>", "<b>$1<i>"],
)
def test_any_nesting_is_read_in_linear_time(tag):
    start = time.monotonic()
    found("<body>" + tag * 20_000)
    assert time.monotonic() - start < 20


def test_a_page_is_read_once_and_nothing_is_shuffled(spark):
    pages = spark.range(3).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("f").alias("original_file"), F.lit("<p>").alias("html")
    )
    plan = PageFlow(CFG).validated(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan and "split(" not in plan


def test_whole_pages_without_anything(spark):
    for html in ("", " ", "<", "<>", "&;", "<a>", "<a href>", "</p></div>", "<!--", "<script", "\x00", "<li><li><li>"):
        row = validated(spark, html)
        assert row["items"] is not None or row.reason is not None
