"""Stages after extraction, checked on recorded runs: five reports in `tests/recorded`, kept as they were once written.

The facts below were counted by hand from the pages that the runs were made of.
"""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import text
from factloom.operators.dominance import page_dominance
from factloom.operators.extract import long_fields
from factloom.operators.fields import completeness, count_fields
from factloom.operators.naming import name_reports
from factloom.operators.render import render_items
from factloom.operators.report import failure_markdown, success_markdown
from factloom.sources.reports import read_report_files

FILES = sorted(glob.glob(os.path.join(os.path.dirname(__file__), "recorded", "*.json")))

# By original file: items, fields, populated, missing, lowest and highest price.
FACTS = {
    "drives.html": (5, 25, 24, 1, 54.5, 1099.0),
    "amp.html": (1, 7, 6, 1, 279.0, 279.0),
    "lamps.html": (3, 9, 9, 0, 10.5, 12.5),
    "pcs.html": (6, 30, 27, 3, 499.99, 999.99),
    "empty.html": (1, 2, 2, 0, None, None),  # two entries without a link: the page itself is all there is
}
# By original file: kind -> value, count.
MODES = {
    "drives.html": {"brand": ("WD", 4), "condition": ("New", 3), "brand_model": ("WD Blue 1TB", 2)},
    "pcs.html": {"brand": ("Minis", 4), "brand_model": ("Minis Box", 4)},
}
STATUS = {
    "drives.html": "success",
    "amp.html": "success",
    "lamps.html": "extraction_incomplete",
    "pcs.html": "success",
    "empty.html": "extraction_incomplete",
}


@pytest.fixture(scope="module")
def reports(spark):
    df = read_report_files(spark, FILES).withColumn("file", F.col("meta.original_file"))
    return df.withColumns(
        {"status": F.col("meta.status"), "processed_at": F.to_timestamp("meta.timestamp", "yyyyMMdd-HHmm")}
    ).cache()


def test_all_are_there():
    assert len(FILES) == len(FACTS)


def test_counts_and_prices(reports):
    fields = long_fields(reports, "file")
    prices = fields.where("field = 'price'").groupBy("file").agg(
        F.min(text.price(F.col("value"))).alias("low"), F.max(text.price(F.col("value"))).alias("high"),
        F.count_if(text.price(F.col("value")).isNull() & F.col("value").isNotNull()).alias("unread"),
    )
    rows = {r.file: r for r in completeness(fields, ["file"], ["pos"]).join(prices, "file").collect()}
    for file, facts in FACTS.items():
        if facts[4]:
            r = rows[file]
            assert (r["items"], r.total_fields, r.populated, r.missing, r.low, r.high) == facts, file
            assert r.unread == 0
    in_row = {r.file: r for r in reports.select("file", *[c.alias(k) for k, c in count_fields(F.col("items")).items()]).collect()}
    assert {k: (r.n_items, r.total_fields, r.populated, r.missing) for k, r in in_row.items()} == {
        k: f[:4] for k, f in FACTS.items()
    }


def test_dominant_values(reports):
    rows = page_dominance(reports.where("shape = 'items'"), EngineConfig()).select("file", "dominance").collect()
    found = {r.file: {d.kind: (d.value, d.n) for d in r.dominance} for r in rows if r.dominance}
    assert {f: {k: v for k, v in found[f].items() if k in kinds} for f, kinds in MODES.items()} == MODES


def test_status_and_names(reports):
    named = name_reports(reports.withColumnRenamed("base_name", "recorded")).select("file", "status", "report_name", "path")
    rows = named.collect()
    assert {r.file: r.status for r in rows} == STATUS
    for r in rows:
        assert r.report_name == os.path.splitext(os.path.basename(r.path))[0]


def test_every_item_is_rendered(reports):
    rows = render_items(reports).select("file", "shape", "formatted_markdown").collect()
    for r in rows:
        if r["shape"] == "items":
            assert r.formatted_markdown.count("### Item ") == FACTS[r.file][0]
        else:
            assert r.formatted_markdown.startswith("## Product Details\n\n### Valve Amp ❤ Ünït\n")


def test_types_and_nulls_survive(reports):
    amp = reports.where("file = 'amp.html'").first()["items"][0]
    assert [tuple(f) for f in amp] == [
        ("name", "Valve Amp ❤ Ünït", "string"), ("brand", "Lumo", "string"), ("color", None, "null"), ("weight", "12", "long"),
        ("price", "279", "long"), ("balanced", "true", "boolean"), ("specs", '{"in":[1,2],"out":{"xlr":1}}', "object"),
    ]


def test_report_layouts(reports):
    """Rendered anew from what the JSON holds, every report is the recorded one, to the last character."""
    c = F.col
    rendered = name_reports(render_items(reports.withColumnRenamed("base_name", "recorded")))
    stamp = c("meta.timestamp")
    good = success_markdown(
        c("file"), stamp, c("hypothesis"), c("validation"), c("insights"), c("statistics"), c("formatted_markdown"), c("base_name")
    )
    bad = failure_markdown(
        c("file"), stamp, c("hypothesis"), c("validation"), c("user_message"), c("partial_summary"), c("formatted_markdown"),
        c("base_name"), c("status"), EngineConfig(),
    )
    rows = rendered.select("path", F.when(c("status") == "success", good).otherwise(bad).alias("ours")).collect()
    recorded = {os.path.basename(f): open(f[:-5] + ".md", encoding="utf-8").read() for f in FILES}
    assert {os.path.basename(r.path).replace("%3A", ":"): r.ours for r in rows} == recorded


def test_recorded_json_is_json():
    for file in FILES:
        report = json.load(open(file, encoding="utf-8"))
        outcome = {"insights", "statistics"} if report["meta"]["status"] == "success" else {"issue", "partial_insights"}
        assert set(report) == {"meta", "hypothesis", "extracted_data", "validation"} | outcome
