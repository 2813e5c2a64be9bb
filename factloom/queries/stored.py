"""Queries over stored reports and failing pages made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators.fields import count_fields
from factloom.plans.page_flow import PageFlow
from factloom.queries.registry import query, table
from factloom.sources.pages import from_table
from factloom.sources.reports import parse_reports

FAILING_FLOW = PageFlow(EngineConfig(min_file_bytes=60))
PAGE_PARTS = ("p_partkey", "p_name", "p_size")
PROCESSED_AT, STAMP = "2025-01-02 03:04:05", "20250102-0304"


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report text per part: lists with elements that are no objects, single items, unexpected data, broken texts."""
    item = F.concat(
        F.lit('{"title":'), F.to_json(F.array("p_name")), F.lit(',"price":'), F.col("p_retailprice").cast("string"),
        F.lit(',"size":'), F.col("p_size").cast("string"), F.lit(',"stock":null,"new":'),
        F.when(F.col("p_size") % 2 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit(',"specs":{"type":"'), F.col("p_type"),
        F.lit('","tags":["a","b"]},"brand":"'), F.col("p_brand"), F.lit('"}'),
    )
    kind = F.col("p_partkey") % 5
    data = (
        F.when(kind == 0, F.concat(F.lit('{"items":['), item, F.lit(',null,"{\\"no\\":1}",7,'), item, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('{"item":'), item, F.lit("}")))
        .when(kind == 2, F.lit('{"items":[]}'))
        .when(kind == 3, F.lit('{"rows":[1,2]}'))
    )
    report = F.concat(F.lit('{"meta":{"status":"success","source":"S"},"extracted_data":'), data, F.lit("}"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/out/r"), F.col("p_partkey").cast("string"), F.lit("_INCOMPLETE.json")).alias("path"),
        F.coalesce(report, F.lit('{"meta": {broken')).alias("report_json"),
    )


@query(
    "stored_report_shapes",
    """SELECT 'r' || p_partkey AS base_name, CASE p_partkey % 5 WHEN 0 THEN 'items' WHEN 1 THEN 'item' WHEN 2 THEN 'items'
        ELSE 'unexpected' END AS shape,
      CASE p_partkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END AS n_items,
      CASE p_partkey % 5 WHEN 0 THEN 14 WHEN 1 THEN 7 ELSE 0 END AS total_fields,
      CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS missing,
      CASE WHEN p_partkey % 5 < 4 THEN 'success' END AS status
    FROM part""",
)
def stored_report_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shape each report's data has; listed elements that are no objects count as items without fields."""
    counts = count_fields(F.col("items"))
    return parse_reports(stored_reports(spark, sf_dir)).select(
        "base_name", "shape", *(counts[c].alias(c) for c in ("n_items", "total_fields", "missing")), "meta.status"
    )


@query(
    "stored_report_fields",
    """SELECT 'r' || p_partkey AS base_name, pos, field_pos, field, value, value_type FROM (
      SELECT *, unnest(CASE p_partkey % 5 WHEN 0 THEN [0, 4] WHEN 1 THEN [0] ELSE [] END) AS pos FROM part), (
      SELECT unnest(range(7)) AS field_pos), LATERAL (SELECT
        ['title', 'price', 'size', 'stock', 'new', 'specs', 'brand'][field_pos + 1] AS field,
        CASE field_pos WHEN 0 THEN '["' || p_name || '"]' WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN NULL
          WHEN 4 THEN (p_size % 2 = 0)::VARCHAR WHEN 5 THEN '{"tags":["a","b"],"type":"' || p_type || '"}' ELSE p_brand END AS value,
        ['array', 'double', 'long', 'null', 'boolean', 'object', 'string'][field_pos + 1] AS value_type)""",
)
def stored_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every stored item, with its type and in its written order."""
    items = parse_reports(stored_reports(spark, sf_dir)).select("base_name", F.posexplode("items").alias("pos", "fields"))
    fields = items.select("base_name", "pos", F.posexplode("fields").alias("field_pos", "f"))
    value = F.when(F.col("f.field") == "price", F.col("f.value").cast("double").cast("string")).otherwise(F.col("f.value"))
    kind = F.when(F.col("f.field") == "price", F.lit("double")).otherwise(F.col("f.value_type"))
    return fields.select("base_name", "pos", "field_pos", "f.field", value.alias("value"), kind.alias("value_type"))


def failing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part: whole lists, lists whose later entries lost their links, and pages without anything to extract."""
    entry = lambda n: F.concat(
        F.lit(f'<li><a href="/{n}">'), F.col("p_name"), F.lit(f" {n}</a> $"), F.col("p_size").cast("string"), F.lit("</li>")
    )
    lost = F.lit("<li>sold out $1</li>")
    kind = F.col("p_partkey") % 3
    body = (
        F.when(kind == 0, F.concat(*(entry(n) for n in range(4))))
        .when(kind == 1, F.concat(entry(0), entry(1), lost, lost))
        .otherwise(F.lit("<li>nothing here</li><li>to be found</li>"))
    )
    html = F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul><p>all of it as shown in our shop</p></body></html>"))
    url = F.concat(F.lit("https://shop.example.com/offers/"), F.col("p_partkey").cast("string"))
    # A page takes far longer than its row of parts: neither few row groups nor few bytes may make few tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select(*PAGE_PARTS).repartition(tasks, *PAGE_PARTS)
    return parts.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


@query(
    "failing_report_markdown",
    f"""WITH pages AS (
      SELECT *, (p_partkey % 3)::INT AS kind, p_partkey::VARCHAR AS original_file,
        CASE p_partkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'extraction_incomplete' ELSE 'extraction_failed' END AS status,
        '{STAMP}-Shopexamplecom-offers-list' AS base_name,
        '## All Items Found' || chr(10) || chr(10) || '### Item 1: ' || p_name || ' 0' || chr(10) || '- **Link:** /0' || chr(10)
          || '- **Price:** $' || p_size || chr(10) || chr(10) || '### Item 2: ' || p_name || ' 1' || chr(10) || '- **Link:** /1'
          || chr(10) || '- **Price:** $' || p_size AS partial
      FROM part WHERE p_partkey % 3 > 0),
    said AS (
      SELECT *, CASE kind WHEN 1 THEN '4' ELSE '2' END AS n,
        CASE kind WHEN 1 THEN '2 items were extracted, expected multiple (estimate 4)' ELSE 'no items were extracted' END AS problem FROM pages)
    SELECT p_partkey AS page_id, status, concat_ws(chr(10) || chr(10),
      '# ⚠️ Extraction Report: ' || original_file || chr(10) || '**Processed:** {STAMP}',
      '## ❌ Status: EXTRACTION ISSUE',
      concat_ws(chr(10), '### 🔍 Page Analysis (Hypothesis)', '**Type:** category listing  ', '**Source:** shop.example.com  ', '**Category:** offers  ',
        '**Expected Items:** multiple (estimate ' || n || ')'),
      '### ⚠️ What Went Wrong' || chr(10) || 'The extraction is not complete: ' || problem || '.',
      concat_ws(chr(10), '**Problem:** ' || problem || '  ', '**Expected:** multiple (estimate ' || n || ') items  ',
        '**Actually Got:** ' || (CASE kind WHEN 1 THEN '2' ELSE '0' END) || ' items'),
      CASE kind WHEN 1 THEN '### 📦 Partial Results' || chr(10) || '2 items were extracted. Fields: 6 of 6 filled.' END,
      CASE kind WHEN 1 THEN '### 📋 Partial Data Extracted' || chr(10) || partial END) AS head
    FROM said""",
)
def failing_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure layout of reports, up to its fixed advice."""
    at = F.lit(PROCESSED_AT).cast("timestamp")
    reports = FAILING_FLOW.reports(from_table(failing_pages(spark, sf_dir)), at).where("status <> 'success'")
    head = F.substring_index("report_markdown", "\n\n### 🔧 Next Steps", 1)
    return reports.select("page_id", "status", head.alias("head"))


@query(
    "failing_page_routing",
    """SELECT CASE p_partkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'extraction_incomplete' ELSE 'extraction_failed' END AS status,
      CASE p_partkey % 3 WHEN 2 THEN 'errors' ELSE 'archive' END AS disposition,
      CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_INCOMPLETE' ELSE '_FAILED' END AS suffix, count(*) AS pages
    FROM part GROUP BY ALL""",
)
def failing_page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages of all three statuses go, and what their reports are called."""
    named = FAILING_FLOW.named(from_table(failing_pages(spark, sf_dir)), F.lit(PROCESSED_AT).cast("timestamp"))
    suffix = F.regexp_extract("report_name", "(_[A-Z]+)?$", 1)
    return named.groupBy("status", "disposition", suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("pages"))
