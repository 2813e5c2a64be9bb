"""Queries that compare two extraction runs over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import html as H
from factloom.functions import jsontext, text
from factloom.operators import compare as C
from factloom.operators.extract import extract_items
from factloom.plans.page_flow import PageFlow, Stage
from factloom.plans.run_comparison import RunComparison
from factloom.queries import page_sql as S
from factloom.queries.pages import pages_of
from factloom.queries.registry import query
from factloom.schemas import ITEMS
from factloom.session import fresh_folder
from factloom.sinks.files import comparison_files, read_named_files, write_named_files
from factloom.sources.prices import price_list

MODEL_A, MODEL_B = "gemini-2.0-flash", "gemini-2.5-flash"
ANY_ANCHOR = r"(?is)<a\s[^>]*>[^<]*</a\s*>"


def extract_long_anchors(profiled: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Another extraction stage: anchors with titles of four characters or more, and a slug."""

    def fields(anchor):
        title = H.plain_text(anchor)
        return F.when(
            F.length(title) >= 4,
            F.array(
                jsontext.text_pair("title", title),
                jsontext.text_pair("link", F.coalesce(H.attribute(anchor, "href"), F.lit("N/A"))),
                jsontext.text_pair("slug", F.lower(text.alphanumeric(title))),
            ),
        )

    anchors = F.regexp_extract_all("clean_html", F.lit(ANY_ANCHOR), F.lit(0))
    items = F.filter(F.transform(anchors, fields), lambda i: i.isNotNull()).cast(ITEMS)
    known = F.col("reason").isNull()
    return profiled.withColumns(
        {"items": F.when(known, items), "shape": F.when(known, F.lit("items"))}
    )


def _timed(stage: Stage, chars_per_second: float) -> Stage:
    """A stage that also says how long it took: as if it read so many characters a second."""

    def run(profiled: DataFrame, cfg: EngineConfig) -> DataFrame:
        return stage(profiled, cfg).withColumn("time_seconds", F.col("clean_chars") / F.lit(chars_per_second))

    return run


def comparison_of(spark: SparkSession, sf_dir: str) -> RunComparison:
    stages = (_timed(extract_items, 1000.0), _timed(extract_long_anchors, 2000.0))
    return RunComparison.of_stages(
        pages_of(spark, sf_dir), PageFlow(), stages, "page_id", (MODEL_A, MODEL_B), price_list(spark)
    )


_RUNS_SQL = f"""{S.RENDERED},
b_anchors AS (
  SELECT page_id, unnest(regexp_extract_all(clean_html, {S.q(ANY_ANCHOR)})) AS anchor,
    generate_subscripts(regexp_extract_all(clean_html, {S.q(ANY_ANCHOR)}), 1) AS n
  FROM profiled),
b_items AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, title,
    coalesce({S.attribute("anchor", "href")}, 'N/A') AS link, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) AS slug
  FROM (SELECT *, {S.plain("anchor")} AS title FROM b_anchors) WHERE length(title) >= 4),
run_fields AS (
  SELECT page_id, 'a' AS run, pos, 'title' AS field, title AS value FROM items
  UNION ALL SELECT page_id, 'a', pos, 'link', link FROM items WHERE link IS NOT NULL
  UNION ALL SELECT page_id, 'a', pos, 'price', price FROM items WHERE price IS NOT NULL
  UNION ALL SELECT page_id, 'b', pos, 'title', title FROM b_items
  UNION ALL SELECT page_id, 'b', pos, 'link', link FROM b_items
  UNION ALL SELECT page_id, 'b', pos, 'slug', slug FROM b_items),
b_json AS (
  SELECT page_id, '{{"items":[' || string_agg('{{"title":' || to_json(title)::VARCHAR || ',"link":'
    || to_json(link)::VARCHAR || ',"slug":' || to_json(slug)::VARCHAR || '}}', ',' ORDER BY pos) || ']}}' AS written
  FROM b_items GROUP BY page_id),
usage AS (
  SELECT page_id, 'a' AS run, length(clean_html) // 4 AS tokens_in, length(extracted_data) // 4 AS tokens_out,
    length(clean_html) / 1000.0::DOUBLE AS time_seconds, 0.075 AS pin, 0.30 AS pout FROM rendered
  UNION ALL
  SELECT page_id, 'b', length(clean_html) // 4, length(coalesce(written, '{{"items":[]}}')) // 4,
    length(clean_html) / 2000.0::DOUBLE, 0.30, 2.50 FROM rendered LEFT JOIN b_json USING (page_id)),
counted AS (
  SELECT page_id, run, count(DISTINCT pos) AS items, count(*) AS total_fields,
    count_if(value IS NULL OR value IN ('', 'N/A')) AS missing
  FROM run_fields GROUP BY ALL),
metrics AS (
  SELECT page_id, run, coalesce(items, 0) AS items, coalesce(total_fields, 0) AS total_fields,
    coalesce(total_fields - missing, 0) AS populated, coalesce(missing, 0) AS missing,
    coalesce(total_fields::DOUBLE / items, 0.0::DOUBLE) AS avg_fields_per_item, tokens_in, tokens_out, time_seconds,
    ((tokens_in * pin + tokens_out * pout)::DECIMAL(28, 6))::DOUBLE / 1000000 AS cost
  FROM usage LEFT JOIN counted USING (page_id, run)),
pair AS (
  SELECT a.page_id, a.items AS a_items, b.items AS b_items, a.total_fields AS a_total_fields,
    b.total_fields AS b_total_fields, a.populated AS a_populated, b.populated AS b_populated,
    a.missing AS a_missing, b.missing AS b_missing, a.avg_fields_per_item AS a_avg, b.avg_fields_per_item AS b_avg,
    a.time_seconds AS a_time, b.time_seconds AS b_time, a.cost AS a_cost, b.cost AS b_cost
  FROM metrics a JOIN metrics b ON a.page_id = b.page_id AND a.run = 'a' AND b.run = 'b')"""


@query(
    "run_metrics",
    f"""WITH {_RUNS_SQL} SELECT page_id, run, items, total_fields, populated, missing, avg_fields_per_item,
      tokens_in, tokens_out, time_seconds, round(cost, 9) AS cost FROM metrics""",
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = comparison_of(spark, sf_dir).metrics()
    return metrics.withColumn("cost", F.round(F.col("cost").cast("double"), 9))


def _winner_sql(a: str, b: str, more: bool, within: float | None = None) -> str:
    tie = f"{a} = {b}" if within is None else f"abs({a} - {b}) < {within}"
    return f"CASE WHEN {tie} THEN 'tie' WHEN {b} {'>' if more else '<'} {a} THEN 'b' ELSE 'a' END"


@query(
    "run_winners",
    f"""WITH {_RUNS_SQL} SELECT page_id, {_winner_sql("a_items", "b_items", True)} AS items_winner,
      {_winner_sql("a_total_fields", "b_total_fields", True)} AS total_fields_winner,
      {_winner_sql("a_populated", "b_populated", True)} AS populated_winner,
      {_winner_sql("a_missing", "b_missing", False)} AS missing_winner,
      {_winner_sql("a_avg", "b_avg", True, 0.1)} AS avg_fields_winner,
      {_winner_sql("a_time", "b_time", False, 2)} AS time_winner, 'a' AS cost_winner FROM pair""",
)
def run_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = comparison_of(spark, sf_dir).verdicts()
    return verdicts.select(
        "page_id", "items_winner", "total_fields_winner", "populated_winner", "missing_winner",
        "avg_fields_winner", "time_winner", "cost_winner",
    )


@query(
    "run_recommendation",
    f"""WITH {_RUNS_SQL}
    SELECT page_id, CASE WHEN a_total_fields > 0 THEN a_populated::DOUBLE / a_total_fields * 100 END AS a_populated_pct,
      CASE WHEN b_total_fields > 0 THEN b_populated::DOUBLE / b_total_fields * 100 END AS b_populated_pct,
      b_populated - a_populated AS quality_gain, round(b_cost - a_cost, 9) AS cost_difference,
      round(CASE WHEN a_cost > 0 THEN (b_cost - a_cost) / a_cost * 100 END, 6) AS cost_increase_pct,
      round((b_cost - a_cost) / greatest(1, b_populated - a_populated), 14) AS cost_per_extra_field,
      round(a_cost * 100, 7) AS a_cost_many_pages, round(b_cost * 100, 7) AS b_cost_many_pages,
      CASE WHEN b_populated - a_populated > 5 THEN 'use b' WHEN b_populated - a_populated > 0 THEN 'marginal'
           ELSE 'use a' END AS verdict
    FROM pair""",
)
def run_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = comparison_of(spark, sf_dir).verdicts()
    return verdicts.select(
        "page_id", "a_populated_pct", "b_populated_pct", "quality_gain",
        F.round("cost_difference", 9).alias("cost_difference"),
        F.round("cost_increase_pct", 6).alias("cost_increase_pct"),
        F.round("cost_per_extra_field", 14).alias("cost_per_extra_field"),
        F.round("a_cost_many_pages", 7).alias("a_cost_many_pages"),
        F.round("b_cost_many_pages", 7).alias("b_cost_many_pages"),
        "verdict",
    )


_DIFF_SQL = f"""{_RUNS_SQL},
side_a AS (SELECT page_id, pos, field, value, true AS here FROM run_fields WHERE run = 'a'),
side_b AS (SELECT page_id, pos, field, value, true AS here FROM run_fields WHERE run = 'b'),
diff AS (
  SELECT page_id, pos, field, a.value AS a_value, b.value AS b_value,
    CASE WHEN a.here IS NULL THEN 'MISSING' WHEN length(a.value) > 50 THEN left(a.value, 50) || '...'
         ELSE a.value END AS a_shown,
    CASE WHEN b.here IS NULL THEN 'MISSING' WHEN length(b.value) > 50 THEN left(b.value, 50) || '...'
         ELSE b.value END AS b_shown,
    coalesce(a.value = b.value, false) AS match
  FROM side_a a FULL JOIN side_b b USING (page_id, pos, field))"""


@query("item_field_diff", f"WITH {_DIFF_SQL} SELECT * FROM diff")
def item_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison_of(spark, sf_dir).diff()


@query(
    "first_item_diff",
    f"""WITH {_DIFF_SQL} SELECT page_id, field, a_shown, b_shown, match FROM diff WHERE pos = 0
    ORDER BY page_id, field""",
)
def first_item_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = C.first_item(comparison_of(spark, sf_dir).diff())
    return shown.select("page_id", "field", "a_shown", "b_shown", "match").orderBy("page_id", "field")


@query("field_name_union", f"WITH {_RUNS_SQL} SELECT DISTINCT page_id, field FROM run_fields")
def field_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison_of(spark, sf_dir).field_names()


@query(
    "comparison_summaries",
    f"""WITH {_DIFF_SQL},
    shown AS (SELECT page_id, count(*) AS n FROM diff WHERE pos = 0 GROUP BY page_id)
    SELECT page_id, CASE WHEN a_items > 0 AND b_items > 0 THEN coalesce(n, 0) ELSE 0 END AS sample_rows,
      CASE WHEN a_items = b_items THEN 'Tie' WHEN b_items > a_items THEN '{MODEL_B}' ELSE '{MODEL_A}' END AS items_line,
      a_items || ' | ' || b_items AS items_counts
    FROM pair LEFT JOIN shown USING (page_id)""",
)
def comparison_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key lines read back out of the comparison reports."""
    reports = comparison_of(spark, sf_dir).reports()
    md = F.col("comparison_markdown")
    line = r"\*\*Items Extracted\*\* \| ([0-9]+ \| [0-9]+) \| ([^|]+) \|"
    return reports.select(
        "page_id",
        F.regexp_count(md, F.lit("(?m) [✅❌] [|]$")).cast("bigint").alias("sample_rows"),
        F.regexp_extract(md, line, 2).alias("items_line"),
        F.regexp_extract(md, line, 1).alias("items_counts"),
    )


@query(
    "comparison_files",
    f"""WITH {_RUNS_SQL},
    folders AS (
      SELECT p.*, '20250102-030405_' || p.page_id AS folder, u.tokens_out AS a_tokens, v.tokens_out AS b_tokens FROM pair p
      JOIN usage u ON u.page_id = p.page_id AND u.run = 'a' JOIN usage v ON v.page_id = p.page_id AND v.run = 'b')
    SELECT folder || '/{MODEL_A}_extraction.json' AS file_name, a_items AS items, a_tokens AS tokens FROM folders
    UNION ALL SELECT folder || '/{MODEL_B}_extraction.json', b_items, b_tokens FROM folders
    UNION ALL SELECT folder || '/comparison_report.md', a_items + b_items, NULL FROM folders""",
)
def comparison_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both extractions and the report of each comparison as files in a folder of their own, written and read back."""
    path = fresh_folder(spark, "comparisons")
    reports = comparison_of(spark, sf_dir).reports()
    folder = F.concat(F.lit("20250102-030405_"), F.col("page_id").cast("string"))
    write_named_files(comparison_files(reports, folder, MODEL_A, MODEL_B), path)
    read, report = read_named_files(spark, path), F.col("name").endswith(".md")
    counts = [F.regexp_extract("text", r"Items Extracted\*\* \| ([0-9]+) \| ([0-9]+) ", g).try_cast("bigint") for g in (1, 2)]
    listed = F.size(F.from_json(F.get_json_object("text", "$.items"), "array<string>")).cast("bigint")
    return read.select(
        F.col("name").alias("file_name"),
        F.when(report, counts[0] + counts[1]).otherwise(listed).alias("items"),
        F.when(~report, text.tokens(F.col("text"))).alias("tokens"),
    )
