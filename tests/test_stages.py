"""Profile rules, extraction rules, and swapped stages."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators.extract import long_fields
from factloom.operators.ledger import price_usage, stage_usage
from factloom.operators.render import TITLE_FIELDS, item_block
from factloom.plans.page_flow import PageFlow, partition_stage
from factloom.schemas import HYPOTHESIS
from factloom.sources.prices import price_list

CFG = EngineConfig(min_file_bytes=0, min_raw_chars=0, min_clean_chars=0)
FLOW = PageFlow(CFG)
PAGE = "page_id bigint, url string, original_file string, html string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, url, f"{i}.html", html) for i, (url, html) in enumerate(rows)], PAGE)


LI = '<li><a href="/{0}">Item {0}</a></li>'
LD = '<script type="application/ld+json">{}</script>'


@pytest.mark.parametrize(
    ("url", "html", "page_type", "item_count", "confidence"),
    [
        ("http://x.com/auction/1", "<p>", "auction", "single", "low"),
        ("http://x.com/1", "<title>Place your BIDS now</title>", "auction", "single", "low"),
        ("http://x.com/f?q=lamp", LI.format(1) + LI.format(2), "search results", "multiple (estimate 2)", "medium"),
        ("http://x.com/f?a=1&page=2", "<p>", "category listing", "single", "low"),
        ("http://x.com/f", LI.format(1) * 3, "category listing", "multiple (estimate 3)", "high"),
        ("http://x.com/f", LI.format(1), "single product", "single", "medium"),
        ("http://x.com/f", "<h1>Lamp</h1>", "single product", "single", "low"),
        ("http://x.com/f", "<p>text</p>", "unknown", "single", "low"),
        ("http://x.com/f", LI.format(1) * 3 + LD.format('{"@type":"Product","name":"L"}'), "single product", "single", "medium"),
        ("http://x.com/f", LD.format('[{"@type":"Product","name":"L"},{"@type":"Product","name":"M"}]'),
         "category listing", "multiple (estimate 2)", "medium"),
        ("http://x.com/f", LD.format('{"@type":"SearchResultsPage"}'), "search results", "single", "low"),
        ("http://x.com/f", LD.format('{"@type":["ItemList"],"itemListElement":[{"item":{"name":"A"}},{"name":"B"},'
                                     '{"url":"no name"},"text"]}'),
         "category listing", "multiple (estimate 2)", "medium"),
    ],
)
def test_profile_rules(spark, url, html, page_type, item_count, confidence):
    row = FLOW.profile(FLOW.clean(pages(spark, (url, html))), CFG).first().hypothesis
    assert (row.page_type, row.item_count, row.confidence) == (page_type, item_count, confidence)
    assert row.source == "x.com"


def test_profile_and_extraction_read_the_whole_page(spark):
    html = LI.format(1) * 2 + "<p>" + "x" * 70_000 + "</p>" + LI.format(3) * 20
    row = FLOW.extracted(pages(spark, ("http://x.com/f", html))).first()
    assert row.hypothesis.item_count == "multiple (estimate 22)" and len(row["items"]) == 22


@pytest.mark.parametrize(
    "block",
    [
        '<li><a href="/{0}">Item {0}</a> $5</li>',
        '<div class="card"><h2 class=t><a href="/{0}">Item {0}</a></h2><p>&#36;5</p></div>',
        '<h3> <span><a href="/{0}">Item {0}</a></span></h3> $5',
        '<tr><td><a href="/{0}">Item {0}</a></td><td>$5</td></tr>',
    ],
)
def test_items_of_every_layout(spark, block):
    html = "<h1>Shop</h1><p>" + "x" * 60_000 + "</p>" + "".join(block.format(i) for i in range(20))
    row = FLOW.extracted(pages(spark, ("http://x.com/f", html))).first()
    assert row.hypothesis.item_count == "multiple (estimate 20)"
    found = [{f.field: f.value for f in item} for item in row["items"]]
    assert found == [{"title": f"Item {i}", "link": f"/{i}", "price": "$5"} for i in range(20)]


CARD = '<h2><a href="/{0}">Item {0}</a></h2>{1}'
ROW = '<tr><td><a href="/{0}">Item {0}</a></td><td>{1}</td></tr>'
ENTRY = '<li><a href="/{0}">Item {0}</a>{1}</li>'
MENU = '<ul>{}</ul>'


def test_a_menu_does_not_hide_the_items(spark):
    few = MENU.format("".join(f'<li><a href="/m{i}">Menu {i}</a></li>' for i in range(2)))
    many = MENU.format("".join(f'<li><a href="/m{i}">Menu {i}</a></li>' for i in range(30)))
    cases = [(menu, block, price) for block in (CARD, ROW) for menu, price in ((few, ""), (few, "$5"), (many, "$5"))]
    cases.append((few.replace("<li>", "<h2>").replace("</li>", "</h2>"), ENTRY, "$5"))
    docs = [("http://x.com/f", m + "".join(b.format(i, p) for i in range(20))) for m, b, p in cases]
    for row, (menu, _, _) in zip(FLOW.validated(pages(spark, *docs)).orderBy("page_id").collect(), cases):
        links = [next(f.value for f in item if f.field == "link") for item in row["items"]]
        assert links == [f"/{i}" for i in range(20)]
        assert row.hypothesis.item_count == "multiple (estimate 20)" and row.status == "success"
        assert row.validation.data_quality == ("good" if menu == many else "excellent")


def test_entities_are_read(spark):
    html = '<ul><li><a href="/1">AT&amp;T&nbsp;B</a> &#36;5</li><li><a href="/2">&amp;lt; two</a></li></ul>' + "x" * 1000
    items = FLOW.extracted(pages(spark, ("http://x.com/f", html))).first()["items"]
    assert [[f.value for f in i] for i in items] == [["AT&T B", "/1", "$5"], ["&lt; two", "/2"]]


def test_list_entries(spark):
    html = (
        "<ul><li class=a><a class=x href='/1'>One <b>bold</b></a> now $1,200.50 <li><a href=/2>Two</a>"
        '<li><a href="">no link</a></li><li><a href="/4"></a></li>'
        '<li>Group<ul><li><a href="/5">Five</a></li></ul></li></ul><a href="/6">outside</a>'
    )
    found = long_fields(FLOW.extracted(pages(spark, ("http://x.com/f", html))), "page_id").collect()
    assert [(r.pos, r.field, r.value) for r in found] == [
        (0, "title", "One bold"), (0, "link", "/1"), (0, "price", "$1,200.50"),
        (1, "title", "Two"), (1, "link", "/2"),
        (2, "title", "Five"), (2, "link", "/5"),
    ]


def test_headed_links_and_single_pages(spark):
    headed = "<ul><li>a<li>b</ul><h2><a href='/x'>Ex</a></h2><h3><a href='/y'>Why</a></h3>"
    single = "<title>T</title><h1>Main <i>thing</i></h1><p>for $5</p>"
    rows = FLOW.extracted(pages(spark, ("http://x.com/f", headed), ("http://x.com/g", single))).orderBy("page_id").collect()
    assert [[f.value for f in i] for i in rows[0]["items"]] == [["Ex", "/x"], ["Why", "/y"]]
    assert rows[0]["shape"] == "items" and rows[1]["shape"] == "item"
    assert [[f.value for f in i] for i in rows[1]["items"]] == [["Main thing", "http://x.com/g", "$5"]]


def test_json_ld_items(spark):
    html = LD.format(
        '{"@graph":[{"@type":"Product","name":"Lamp","sku":12,"brand":{"@type":"Brand","name":"Lumo"},'
        '"offers":[{"price":"9.50","priceCurrency":"EUR"}],"tags":["a","b"]},'
        '{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"Lamps"}}]}]}'
    )
    row = FLOW.extracted(pages(spark, ("http://x.com/f", html))).first()
    assert row.hypothesis.category == "Lamps"
    assert [tuple(f) for f in row["items"][0]] == [
        ("name", "Lamp", "string"), ("sku", "12", "long"), ("brand", "Lumo", "string"),
        ("tags", '["a","b"]', "array"), ("price", "9.50", "string"), ("currency", "EUR", "string"),
    ]
    assert row.hypothesis.expected_fields == ["name", "sku", "brand", "tags", "price", "currency"]


def test_item_block(spark):
    fields = [("price", "$5", "string"), ("shipping_cost", None, "null"), ("title", "Lamp", "string")]
    df = spark.createDataFrame([(fields,)], "f array<struct<field:string,value:string,value_type:string>>")
    block = df.select(item_block(F.col("f"), F.lit(3))).first()[0]
    assert block == "### Item 3: Lamp\n- **Price:** $5\n- **Shipping Cost:** N/A"
    assert TITLE_FIELDS[0] == "title"


def test_stage_swapped_for_a_dataframe_function(spark):
    def fixed(cleaned, cfg):
        values = ["auction results", "Bay", "lamps", "2"]
        struct = F.struct(
            *[F.lit(v).alias(n) for v, n in zip(values, ("page_type", "source", "category", "item_count"))],
            F.array(F.lit("title")).alias("expected_fields"), F.lit("high").alias("confidence"), F.lit("").alias("notes"),
        )
        return cleaned.withColumns({"hypothesis": F.when(F.col("reason").isNull(), struct), "title": F.lit(None).cast("string")})

    flow = replace(FLOW, profile=fixed)
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    row = flow.reports(pages(spark, ("http://x.com/f", LI.format(1) + LI.format(2))), at).first()
    assert row.base_name == "20250102-0304-Bay-lamps-auction" and row.status == "success"


def test_stage_swapped_for_a_partition_function(spark):
    def classify(batch: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(index=batch.index)
        out["hypothesis"] = [
            {"page_type": "single product", "source": "M", "category": f"n{len(h or '')}", "item_count": "single",
             "expected_fields": ["title"], "confidence": "low", "notes": ""}
            for h in batch["clean_html"]
        ]
        out["title"] = None
        out["profile_in_tok"] = [len(h or "") for h in batch["clean_html"]]
        out["profile_out_tok"] = 11
        return out

    added = f"struct<hypothesis:{HYPOTHESIS},title:string,profile_in_tok:bigint,profile_out_tok:bigint>"
    cfg = replace(CFG, stage_models={**CFG.stage_models, "Hypothesis": "gpt-4o"})
    flow = PageFlow(cfg, profile=partition_stage(classify, added, ("clean_html",)))
    at = F.lit("2025-01-02 03:04:05").cast("timestamp")
    done = flow.reports(pages(spark, ("http://x.com/f", "<h1>a</h1>"), ("http://x.com/g", "<h1>bcd</h1>")), at)
    rows = done.orderBy("page_id").collect()
    assert [r.hypothesis.category for r in rows] == ["n10", "n12"]
    priced = price_usage(stage_usage(done, cfg), price_list(spark)).where("task = 'Hypothesis'")
    assert sorted((r.in_tok, r.out_tok, float(r.cost_usd)) for r in priced.collect()) == [
        (10, 11, 0.000135), (12, 11, 0.00014),
    ]
