"""Page files, ledgers and reports on disk; batch and stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig, TASK_EXTRACT
from factloom.operators.ledger import ledger_rows, price_usage, stage_usage
from factloom.plans.page_flow import PageFlow
from factloom.plans.run_comparison import RunComparison
from factloom.sinks import tables
from factloom.sources.ledger import read_ledger
from factloom.sources.pages import read_page_files, stream_page_files
from factloom.sources.prices import price_list, read_price_list
from factloom.sources.reports import parse_reports, read_report_table
from factloom.streaming.page_stream import start_page_stream
from factloom.streaming.spend_stream import windowed_spend

FILLER = "<p>" + "words to fill the page " * 50 + "</p>"
LIST = (
    '<html><head><title>Shop</title><link rel="canonical" href="https://www.shop.example.com/lamps?page=1"></head>'
    "<body><ul>"
    + "".join(f'<li><a href="/l{i}">Lamp {i}</a> <b>${i}9.50</b>' for i in range(1, 5))
    + "</ul>" + FILLER + "</body></html>"
)
PRODUCT = (
    '<html><head><script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Product","name":"Desk Lamp",'
    '"brand":{"@type":"Brand","name":"Lumo"},"offers":{"price":49.5,"priceCurrency":"EUR"},"color":null}]}</script>'
    "</head><body><h1>Desk Lamp</h1>" + FILLER + "</body></html>"
)
EMPTY = "<html><body><ul><li><a href=''></a></li><li>none</li></ul>" + FILLER + "</body></html>"


@pytest.fixture
def queue(tmp_path):
    folder = tmp_path / "queue"
    folder.mkdir()
    files = {
        "list.html": LIST.encode(),
        "product.HTM": PRODUCT.encode(),
        "empty.html": EMPTY.encode(),
        "latin.html": ("<body>caf\xe9 " + FILLER + "</body>").encode("latin-1"),
        "2025-12-26_17:30:53.html": LIST.encode(),
        "small.html": b"<p>small</p>",
        "._list.html": LIST.encode(),
        "notes.txt": LIST.encode(),
        "page.htmx": LIST.encode(),
    }
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return str(folder)


ADMITTED = {"list.html", "product.HTM", "empty.html", "latin.html", "2025-12-26_17:30:53.html", "small.html"}


def at():
    return F.lit("2025-01-02 03:04:05").cast("timestamp")


def test_only_html_files_are_taken_up(spark, queue):
    rows = read_page_files(spark, queue).collect()
    names = {r.original_file.replace("%3A", ":") for r in rows}
    assert names == ADMITTED
    latin = next(r for r in rows if r.original_file == "latin.html")
    assert latin.html.startswith("<body>caf\xe9 ")
    small = next(r for r in rows if r.original_file == "small.html")
    assert small.size_bytes == 12


def test_flow_over_files(spark, queue):
    done = {r.original_file: r for r in PageFlow().reports(read_page_files(spark, queue), at()).collect()}
    listed = done["list.html"]
    assert listed.status == "success" and listed.disposition == "archive"
    assert listed.hypothesis.source == "shop.example.com" and listed.hypothesis.category == "lamps?page=1".split("?")[0]
    assert listed.hypothesis.item_count == "multiple (estimate 4)"
    assert json.loads(listed.extracted_data)["items"][0] == {"title": "Lamp 1", "link": "/l1", "price": "$19.50"}
    assert listed.statistics.key_metrics == "Price range: 19.5 - 49.5, median 29.5 (4 priced)"
    assert listed.report_name == "20250102-0304-Shopexamplecom-lamps-list"
    product = done["product.HTM"]
    assert product.shape == "item" and product.hypothesis.page_type == "single product"
    assert json.loads(product.report_json)["extracted_data"] == {
        "item": {"name": "Desk Lamp", "brand": "Lumo", "color": None, "price": 49.5, "currency": "EUR"}
    }
    assert product.formatted_markdown.startswith("## Product Details\n\n### Desk Lamp\n- **Brand:** Lumo")
    small = done["small.html"]
    assert (small.reason, small.disposition, small.items) == ("too_small", "errors", None)
    empty = done["empty.html"]
    assert empty.status == "extraction_failed" and empty.report_name.endswith("_FAILED")
    assert "issue" in json.loads(empty.report_json) and "insights" not in json.loads(empty.report_json)
    assert empty.report_markdown.startswith("# ⚠️ Extraction Report: empty.html\n")
    assert "### 📋 Partial Data Extracted" not in empty.report_markdown
    for r in done.values():
        if r.reason is None:
            debug = json.loads(r.debug_json)
            assert list(debug) == ["timestamp", "original_file", "hypothesis", "extracted_data",
                                   "formatted_markdown_length", "validation_result"]
            assert debug["formatted_markdown_length"] == len(r.formatted_markdown)


def test_stream_writes_what_the_batch_computes(spark, queue, tmp_path):
    root = str(tmp_path / "out")
    pages = stream_page_files(spark, queue, max_files=2)
    start_page_stream(pages, root, available_now=True, name="files").awaitTermination(300)
    columns = ["page_id", "reason", "status", "base_name", "extracted_data", "disposition", "formatted_markdown"]
    batch = PageFlow().reports(
        read_page_files(spark, queue), F.col("arrived_at")
    ).select(columns)
    streamed = spark.read.parquet(os.path.join(root, tables.FINISHED)).select(columns)
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).count() == 0
    routed = spark.read.parquet(os.path.join(root, tables.PAGES))
    assert {r.disposition: r["count"] for r in routed.groupBy("disposition").count().collect()} == {
        "archive": 3, "errors": 3,
    }
    log = spark.read.parquet(os.path.join(root, tables.LOG))
    # Eight stages of five pages, and the admission of the sixth.
    assert log.count() == 5 * 8 + 1 and log.where("stage = 'outcome'").count() == 5
    assert log.where("stage = 'admission' AND level = 'warning'").count() == 1
    ledger = read_ledger(spark, os.path.join(root, tables.LEDGER))
    assert ledger.count() == 4 * 5 and ledger.where("cost_usd <> 0").count() == 0
    reports = spark.read.parquet(os.path.join(root, tables.REPORTS))
    assert reports.count() == 5
    titles = reports.selectExpr("variant_get(extracted_data, '$.items[0].title', 'string') t").where("t is not null")
    assert {r.t for r in titles.collect()} == {"Lamp 1"}
    assert spark.read.parquet(os.path.join(root, tables.DEBUG)).count() == 5
    back = read_report_table(spark, os.path.join(root, tables.REPORTS))
    assert back.where("meta.status = 'success'").count() == 3


def test_stream_goes_on_where_it_stopped(spark, queue, tmp_path):
    root = str(tmp_path / "out")
    for added in (None, "late.html"):
        if added:
            with open(os.path.join(queue, added), "w") as f:
                f.write(LIST)
        start_page_stream(
            stream_page_files(spark, queue), root, available_now=True, name="again"
        ).awaitTermination(300)
    finished = spark.read.parquet(os.path.join(root, tables.FINISHED))
    assert finished.count() == 7 and finished.select("path").distinct().count() == 7


def test_old_files_are_kept(spark, tmp_path):
    """A file that arrives late with an old time stamp is a page like any other; a path counts once."""
    queue, root = tmp_path / "queue", str(tmp_path / "out")
    queue.mkdir()
    page = "<html><body>" + "<p>text</p>" * 200 + "</body></html>"
    (queue / "new.html").write_text(page)
    for _ in range(2):
        start_page_stream(stream_page_files(spark, str(queue)), root, available_now=True).awaitTermination(300)
        (queue / "old.html").write_text(page)
        os.utime(queue / "old.html", (1_600_000_000, 1_600_000_000))
    finished = spark.read.parquet(os.path.join(root, tables.FINISHED))
    assert sorted(os.path.basename(r.path) for r in finished.select("path").collect()) == ["new.html", "old.html"]


def test_live_spend_equals_batch(spark, tmp_path):
    source = str(tmp_path / "usage")
    usage = spark.range(500).select(
        F.timestamp_seconds(F.lit(1735689600) + F.col("id") * 600).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit("gpt-4o")).otherwise(F.lit("nobody")).alias("model"),
        F.lit("Extraction").alias("task"),
        (F.col("id") * 10).alias("in_tok"),
        F.col("id").alias("out_tok"),
    )
    usage.write.parquet(source)
    prices = price_list(spark)
    stream = windowed_spend(price_usage(spark.readStream.schema(usage.schema).parquet(source), prices), "1 day", "1 hour", "model")
    query = stream.writeStream.format("memory").outputMode("complete").queryName("spend").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windowed_spend(price_usage(spark.read.parquet(source), prices), "1 day", "1 hour", "model")
    assert sorted(map(tuple, spark.table("spend").collect())) == sorted(map(tuple, batch.collect()))


def test_ledger_round_trip_and_unknown_model(spark, tmp_path):
    usage = spark.createDataFrame(
        [("Formatting", "gpt-4o-mini", 6847, 1234), ("Formatting", "no-such-model", 10, 10)],
        "task string, model string, in_tok bigint, out_tok bigint",
    ).withColumn("ts", at())
    priced = price_usage(usage, price_list(spark))
    texts = {r.Model: r.Cost_USD for r in ledger_rows(priced).collect()}
    assert texts == {"gpt-4o-mini": "$0.001767", "no-such-model": "$0.000000"}
    tables.write_ledger(priced, str(tmp_path), 0)
    back = {r.model: r for r in read_ledger(spark, str(tmp_path / "ledger")).collect()}
    assert float(back["gpt-4o-mini"].cost_usd) == 0.001767 and back["gpt-4o-mini"].in_tok == 6847
    header = sorted(p for p in (tmp_path / "ledger" / "batch_id=0").iterdir() if p.suffix == ".csv")[0]
    assert header.read_text().splitlines()[0] == "Timestamp,Task,Model,Input_Tokens,Output_Tokens,Cost_USD"


def test_report_lines_keep_nulls_and_letters(spark, queue, tmp_path):
    done = PageFlow().reports(read_page_files(spark, queue), at())
    tables.write_report_lines(done, str(tmp_path / "lines"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == 5
    product = next(r for r in lines if r["meta"]["original_file"] == "product.HTM")
    assert product["extracted_data"]["item"]["color"] is None and product["validation"]["problem"] is None
    assert list(product) == ["meta", "hypothesis", "extracted_data", "validation", "insights", "statistics"]


def test_comparison_is_written_and_read_back(spark, queue, tmp_path):
    pages = read_page_files(spark, queue)
    found = PageFlow().extracted(pages).where("reason is null")
    comparison = RunComparison.of_runs(found, found, "page_id", ("A", "B"), price_list(spark))
    reports = comparison.reports(pages.select("page_id", "original_file"))
    kept = found.select("page_id", "items", "shape")
    tables.write_comparison(kept, kept, reports.select("page_id", "comparison_markdown"), str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "comparison")).collect()
    assert len(back) == 5 and all("| ❌ |" not in r.comparison_markdown for r in back)
    assert spark.read.parquet(str(tmp_path / "extraction_a")).count() == 5


def test_price_list_file(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("model,input,output\nm1,2.5,10\nm2,bad,1\n")
    rows = {r.model: (r.price_in, r.price_out) for r in read_price_list(spark, str(path)).collect()}
    assert float(rows["m1"][0]) == 2.5 and rows["m2"][0] is None


def test_broken_reports_do_not_throw(spark):
    df = spark.createDataFrame(
        [("a.json", "{broken"), ("b_INCOMPLETE.json", '{"meta":{"status":"x"},"extracted_data":{"items":[1]}}')],
        "path string, report_json string",
    )
    rows = {r.base_name: r for r in parse_reports(df).collect()}
    assert rows["a"].meta is None and rows["a"].items == []
    assert rows["b"].meta.status == "x" and rows["b"].items == [None]


def test_usage_reported_by_a_stage_wins(spark):
    pages = spark.createDataFrame(
        [(1, None, "x" * 400, "y" * 40, "z" * 80, 7, 3)],
        "page_id int, reason string, clean_html string, extracted_data string, formatted_markdown string, "
        "extract_in_tok bigint, extract_out_tok bigint",
    ).withColumns({"processed_at": at(), "hypothesis": F.struct(F.lit(1).alias("a")), "validation": F.struct(F.lit(1).alias("a"))})
    cfg = EngineConfig()
    rows = {r.task: (r.in_tok, r.out_tok) for r in stage_usage(pages, cfg).collect()}
    assert rows[TASK_EXTRACT] == (7, 3)
    assert rows["Hypothesis"] == (100, len('{"a":1}') // 4) and rows["Formatting"] == (10, 20)
