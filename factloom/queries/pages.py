"""Queries over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import (
    TASK_EXTRACT,
    TASK_PROFILE,
    TASK_RENDER,
    TASK_VALIDATE,
    EngineConfig,
)
from factloom.functions import html as H
from factloom.functions import jsontext, text
from factloom.operators.admit import admit
from factloom.operators.clean import cleaning_totals
from factloom.operators.extract import long_fields
from factloom.operators.fields import count_fields, field_coverage, first_value
from factloom.operators.ledger import price_usage, spend_by, stage_usage
from factloom.operators.naming import disposition
from factloom.operators.render import validator_summary
from factloom.operators.report import run_log, stage_log
from factloom.plans.page_flow import PageFlow
from factloom.queries import page_sql as S
from factloom.queries.registry import query, table
from factloom.session import fresh_folder
from factloom.sinks.files import read_named_files, report_files, write_named_files
from factloom.sources.pages import from_table
from factloom.sources.prices import price_list

PROCESSED_AT = "2025-01-02 03:04:05"
STAMP = "20250102-0304"

# Prices the stages of the page flow as if these models ran them.
PRICED_FLOW = EngineConfig(
    stage_models={
        TASK_PROFILE: "gpt-4o-mini",
        TASK_EXTRACT: "gemini-2.0-flash",
        TASK_RENDER: "gpt-4o-mini",
        TASK_VALIDATE: "gpt-4o",
    }
)


#: Session setting: to how many tasks the page queries deal their pages; unset, the table's own splits are the tasks.
PAGE_TASKS = "spark.factloom.page.tasks"


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = spark.conf.get(PAGE_TASKS, None)
    return from_table(table(spark, sf_dir, "pages"), int(tasks) if tasks else None)


def reports_of(spark: SparkSession, sf_dir: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    return PageFlow(cfg).reports(pages_of(spark, sf_dir), F.lit(PROCESSED_AT).cast("timestamp"))


def named_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PageFlow().named(pages_of(spark, sf_dir), F.lit(PROCESSED_AT).cast("timestamp"))


@query(
    "host_cleaning_totals",
    f"""WITH {S.CLEANED}
    SELECT {S.HOST} AS host, count(*) AS pages, sum(removed_tags)::BIGINT AS removed_tags,
      sum(removed_comments)::BIGINT AS removed_comments, sum(base64_images_removed)::BIGINT AS images_removed,
      sum(original_chars)::BIGINT AS chars_before, sum(length(clean_html))::BIGINT AS chars_after,
      sum(length(clean_html) // 4)::BIGINT AS estimated_tokens,
      sum(original_chars)::BIGINT / 1024.0::DOUBLE AS kb_before,
      sum(length(clean_html))::BIGINT / 1024.0::DOUBLE AS kb_after,
      (sum(original_chars)::BIGINT - sum(length(clean_html))::BIGINT) / sum(original_chars)::DOUBLE * 100.0::DOUBLE
        AS reduction_pct,
      sum(length(clean_html) // 4)::BIGINT / count(*)::DOUBLE AS avg_tokens
    FROM cleaned WHERE reason IS NULL GROUP BY ALL""",
)
def host_cleaning_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = PageFlow().clean(pages_of(spark, sf_dir))
    return cleaning_totals(cleaned.withColumn("host", H.host(F.col("url"))), "host")


@query(
    "page_admission",
    """SELECT page_id, strlen(html) AS size_bytes, length(html) AS chars,
         CASE WHEN html IS NULL THEN 'no_content' WHEN strlen(html) < 1000 THEN 'too_small'
              WHEN length(html) < 100 THEN 'short_raw' END AS reason
       FROM pages""",
)
def page_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = from_table(table(spark, sf_dir, "pages"))
    return admit(pages).select(
        "page_id", "size_bytes", F.length("html").cast("bigint").alias("chars"), "reason"
    )


@query(
    "page_cleaning",
    f"""WITH {S.CLEANED}
    SELECT page_id, reason, md5(clean_html) AS clean_md5, original_chars, length(clean_html) AS clean_chars,
      original_chars / 1024.0::DOUBLE AS original_size_kb, length(clean_html) / 1024.0::DOUBLE AS cleaned_size_kb,
      (original_chars - length(clean_html)) / original_chars::DOUBLE * 100.0::DOUBLE AS reduction_pct,
      length(clean_html) // 4 AS estimated_tokens, removed_tags, removed_comments, base64_images_removed
    FROM cleaned WHERE reason IS NULL""",
)
def page_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = PageFlow().clean(pages_of(spark, sf_dir)).where(F.col("reason").isNull())
    return cleaned.select(
        "page_id", "reason", F.md5("clean_html").alias("clean_md5"), "original_chars", "clean_chars",
        "original_size_kb", "cleaned_size_kb", "reduction_pct", "estimated_tokens",
        "removed_tags", "removed_comments", "base64_images_removed",
    )


@query(
    "page_sources",
    f"""SELECT page_id, {S.HOST} AS host, regexp_extract(url, '([^/]*)$', 1) AS base_name,
         regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages""",
)
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        H.host(url).alias("host"),
        text.basename(url).alias("base_name"),
        text.stem(url).alias("stem"),
    )


@query(
    "page_profile",
    f"""WITH {S.PROFILED}
    SELECT page_id, page_type, source, category, item_count, expected_fields, confidence, notes FROM profiled""",
)
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PageFlow().profiled(pages_of(spark, sf_dir)).where(F.col("reason").isNull()).select(
        "page_id", "hypothesis.page_type", "hypothesis.source", "hypothesis.category", "hypothesis.item_count",
        F.array_join("hypothesis.expected_fields", ",").alias("expected_fields"),
        "hypothesis.confidence", "hypothesis.notes",
    )


@query(
    "page_items",
    f"WITH {S.FIELDS} SELECT page_id, pos, field_pos, field, value, value_type FROM fields",
)
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_fields(PageFlow().extracted(pages_of(spark, sf_dir)), "page_id")


@query(
    "items_per_page",
    f"""WITH {S.RENDERED}
    SELECT page_id, n_items, total_fields, total_fields - missing AS populated, missing,
      CASE WHEN n_items > 0 THEN total_fields::DOUBLE / n_items ELSE 0.0::DOUBLE END AS avg_fields_per_item,
      first_title FROM rendered""",
)
def items_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PageFlow().extracted(pages_of(spark, sf_dir)).where(F.col("reason").isNull())
    counts = count_fields(F.col("items"))
    return found.select(
        "page_id", *[c.alias(n) for n, c in counts.items()], first_value(F.col("items"), "title").alias("first_title")
    )


@query(
    "page_field_coverage",
    f"""WITH {S.FIELDS},
    tagged AS (SELECT {S.HOST} AS host, f.* FROM fields f JOIN pages USING (page_id)),
    totals AS (SELECT host, count(*) AS items FROM (SELECT DISTINCT host, page_id, pos FROM tagged) GROUP BY host)
    SELECT host, field, count(*) AS with_field, count_if(value NOT IN ('', 'N/A')) AS with_value, items,
      count(*)::DOUBLE / items AS field_share, count_if(value NOT IN ('', 'N/A'))::DOUBLE / items AS value_share
    FROM tagged JOIN totals USING (host) GROUP BY host, field, items""",
)
def page_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PageFlow().extracted(pages_of(spark, sf_dir)).withColumn("host", H.host(F.col("url")))
    return field_coverage(long_fields(found, "host", "page_id"), ["host"], ["page_id", "pos"])


@query(
    "page_markdown",
    f"""WITH {S.RENDERED}
    SELECT page_id, formatted_markdown, length(formatted_markdown) AS markdown_chars,
      len(regexp_extract_all(formatted_markdown, '### ')) AS headings FROM rendered""",
)
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = PageFlow()
    rendered = flow.render(flow.extracted(pages_of(spark, sf_dir)), flow.cfg)
    return rendered.where(F.col("reason").isNull()).select(
        "page_id",
        "formatted_markdown",
        F.length("formatted_markdown").cast("bigint").alias("markdown_chars"),
        F.regexp_count("formatted_markdown", F.lit("### ")).cast("bigint").alias("headings"),
    )


@query(
    "validator_input",
    f"""WITH {S.RENDERED}
    SELECT page_id, left(formatted_markdown, 3000)
        || CASE WHEN length(formatted_markdown) > 3000 THEN '...' ELSE '' END AS formatted_data_preview,
      CASE WHEN shape = 'items' THEN n_items ELSE 1 END AS items_count, shape = 'items' AS has_items,
      shape AS top_level_keys FROM rendered""",
)
def validator_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = PageFlow()
    rendered = flow.render(flow.extracted(pages_of(spark, sf_dir)), flow.cfg)
    seen = validator_summary(rendered.where(F.col("reason").isNull()), flow.cfg)
    return seen.withColumn("top_level_keys", F.array_join("top_level_keys", ","))


@query(
    "page_validation",
    f"""WITH {S.VALIDATED}
    SELECT page_id, status, status = 'success' AS hypothesis_match, item_count AS expected_items,
      n_items AS actual_items, data_quality,
      CASE WHEN status = 'success' THEN 'all items formatted' END AS completeness,
      CASE WHEN status = 'success' THEN NULL WHEN n_items = 0 THEN 'no items were extracted'
           ELSE n_items || ' items were extracted, expected ' || item_count END AS problem,
      CASE WHEN status = 'success' THEN nullif(gaps, '') END AS notes
    FROM validated""",
)
def page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = PageFlow().validated(pages_of(spark, sf_dir)).where(F.col("reason").isNull())
    return validated.select("page_id", "status", "validation.*")


@query(
    "page_insights",
    f"""WITH {S.VALIDATED},
    texts AS (
      SELECT *, 'Fields: ' || (total_fields - missing) || ' of ' || total_fields || ' filled' AS filled,
        CASE WHEN n_items = 0 THEN 'no items were extracted'
             ELSE n_items || ' items were extracted, expected ' || item_count END AS problem
      FROM validated)
    SELECT page_id,
      CASE WHEN status = 'success' THEN n_items || ' items from ' || source || ' (' || page_type || ').' END
        AS executive_summary,
      CASE WHEN status = 'success' THEN filled END AS key_findings,
      CASE WHEN status = 'success' THEN 'Complete before comparing: ' || gaps || '.' END AS recommendation,
      CASE WHEN status = 'success' THEN n_items::VARCHAR END AS total_items,
      CASE WHEN status = 'success' THEN filled END AS key_metrics,
      CASE WHEN status <> 'success' THEN 'The extraction is not complete: ' || problem || '.' END AS user_message,
      CASE WHEN status <> 'success' AND n_items > 0
           THEN n_items || ' items were extracted. ' || filled || '.' END AS partial_summary
    FROM texts""",
)
def page_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = PageFlow().validated(pages_of(spark, sf_dir)).where(F.col("reason").isNull())
    return validated.select("page_id", "insights.*", "statistics.*", "user_message", "partial_summary")


_NAME = f"""'{STAMP}-' || {S.source_part("source")} || '-'
      || coalesce(nullif({S.sanitized("category", "-")}, ''), 'Unknown') || '-'
      || CASE WHEN page_type LIKE '%auction%' THEN 'auction' WHEN item_count = 'single' THEN 'single'
              ELSE 'list' END"""


@query(
    "page_report_names",
    f"""WITH {S.ALL_VALIDATED}
    SELECT page_id, {_NAME} AS base_name,
      {_NAME} || CASE status WHEN 'success' THEN '' WHEN 'extraction_incomplete' THEN '_INCOMPLETE'
                             ELSE '_FAILED' END AS report_name,
      {_NAME} || '_DEBUG' AS debug_name
    FROM every_page WHERE reason IS NULL""",
)
def page_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        named_of(spark, sf_dir)
        .where(F.col("reason").isNull())
        .select("page_id", "base_name", "report_name", "debug_name")
    )


@query(
    "report_envelope",
    f"""WITH {S.ALL_VALIDATED}
    SELECT page_id, '{STAMP}' AS stamp, coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), url) AS original_file, status, page_type,
      source, category, md5(extracted_data) AS data_md5, length(formatted_markdown) AS markdown_chars,
      status = 'success' AS has_insights, status <> 'success' AS has_issue
    FROM every_page WHERE reason IS NULL""",
)
def report_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope read back out of the report texts."""
    reports = reports_of(spark, sf_dir).where(F.col("reason").isNull())
    meta = F.from_json(F.get_json_object("report_json", "$.meta"), "map<string,string>")
    keys = F.json_object_keys("report_json")
    length = F.get_json_object("debug_json", "$.formatted_markdown_length").cast("bigint")
    parsed = reports.select("page_id", "report_json", "debug_json", meta.alias("m"), keys.alias("k"))
    return parsed.select(
        "page_id",
        F.col("m")["timestamp"].alias("stamp"),
        *[F.col("m")[f].alias(f) for f in ("original_file", "status", "page_type", "source", "category")],
        F.md5(F.get_json_object("report_json", "$.extracted_data")).alias("data_md5"),
        length.alias("markdown_chars"),
        F.array_contains("k", "insights").alias("has_insights"),
        F.array_contains("k", "issue").alias("has_issue"),
    )


@query(
    "report_markdown",
    f"""WITH {S.ALL_VALIDATED}, named AS (
      SELECT *, {_NAME} AS base_name,
        'Fields: ' || (total_fields - missing) || ' of ' || total_fields || ' filled' AS filled,
        coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), url) AS original_file
      FROM every_page WHERE reason IS NULL)
    SELECT page_id, array_to_string([
      '# 📊 Extraction Report: ' || original_file, '**Processed:** {STAMP}', '', '## ✅ Status: SUCCESS', '',
      '### 🔍 Page Analysis', '**Type:** ' || page_type || '  ', '**Source:** ' || source || '  ',
      '**Category:** ' || category || '  ', '**Items Found:** ' || n_items, '', '### 💡 Executive Summary',
      n_items || ' items from ' || source || ' (' || page_type || ').', '', '### 🎯 Key Findings', filled, '',
      '### 📈 Statistics', filled, '', '---', '', formatted_markdown, '', '---', '', '### 💭 Recommendation',
      'Complete before comparing: ' || gaps || '.', '', '### ✅ Validation',
      '**Data Quality:** ' || data_quality || '  ', '**Completeness:** all items formatted', '', '---',
      '*Full JSON data: `' || base_name || '.json`*  ', '*Debug info: `' || base_name || '_DEBUG.json`*', ''
      ], chr(10)) AS report_markdown
    FROM named""",
)
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_of(spark, sf_dir).where(F.col("reason").isNull()).select("page_id", "report_markdown")


@query(
    "report_files",
    f"""WITH {S.ALL_VALIDATED}, named AS (
      SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), url) AS original_file, status, {_NAME} AS base_name,
        {_NAME} || CASE status WHEN 'success' THEN '' WHEN 'extraction_incomplete' THEN '_INCOMPLETE' ELSE '_FAILED' END AS report_name
      FROM every_page WHERE reason IS NULL),
    again AS (
      SELECT *, row_number() OVER (PARTITION BY report_name ORDER BY page_id % 64, page_id) AS n FROM named),
    own AS (SELECT *, CASE WHEN n > 1 THEN '-' || n ELSE '' END AS mark FROM again)
    SELECT report_name || mark || '.md' AS file_name, 'report' AS kind, original_file, report_name || mark AS said FROM own
    UNION ALL SELECT report_name || mark || '.json', status, original_file, NULL FROM own
    UNION ALL SELECT base_name || '_DEBUG' || mark || '.json', 'debug', original_file, NULL FROM own""",
)
def report_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as files by name, written, listed, and read back."""
    path = fresh_folder(spark, "reports")
    write_named_files(report_files(reports_of(spark, sf_dir)), path)
    read = read_named_files(spark, path)
    body = F.col("text")
    markdown, debug = F.col("name").endswith(".md"), F.col("name").contains("_DEBUG")
    return read.select(
        F.col("name").alias("file_name"),
        F.when(markdown, F.lit("report")).when(debug, F.lit("debug")).otherwise(F.get_json_object(body, "$.meta.status")).alias("kind"),
        F.when(markdown, F.regexp_extract(body, "Extraction Report: ([^\\n]*)", 1))
        .when(debug, F.get_json_object(body, "$.original_file"))
        .otherwise(F.get_json_object(body, "$.meta.original_file"))
        .alias("original_file"),
        F.when(markdown, F.regexp_extract(body, "data: `([^`]*)[.]json`", 1)).alias("said"),
    )


@query(
    "page_routing",
    f"""WITH {S.ALL_VALIDATED}
    SELECT status, reason, disposition, count(*) AS pages FROM every_page GROUP BY ALL""",
)
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = PageFlow().validated(pages_of(spark, sf_dir)).select(
        "status", "reason", disposition(F.col("status")).alias("disposition")
    )
    return routed.groupBy("status", "reason", "disposition").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "run_log",
    f"""WITH {S.ALL_VALIDATED}
    SELECT page_id, CASE WHEN status = 'success' THEN 'info'
        WHEN status = 'extraction_incomplete' OR reason IS NOT NULL THEN 'warning' ELSE 'error' END AS level,
      CASE WHEN reason IS NOT NULL THEN 'quarantined: ' || reason
        ELSE status || ' ' || {_NAME} || CASE status WHEN 'success' THEN ''
             WHEN 'extraction_incomplete' THEN '_INCOMPLETE' ELSE '_FAILED' END END AS message
    FROM every_page""",
)
def run_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(named_of(spark, sf_dir)).select("page_id", "level", "message")


@query(
    "stage_log",
    f"""WITH {S.ALL_VALIDATED}, named AS (
      SELECT *, {_NAME} || CASE status WHEN 'success' THEN '' WHEN 'extraction_incomplete' THEN '_INCOMPLETE' ELSE '_FAILED' END
        AS report_name, CASE status WHEN 'success' THEN 'info' WHEN 'extraction_incomplete' THEN 'warning' ELSE 'error' END AS grade,
        CASE WHEN status = 'success' THEN NULL WHEN n_items = 0 THEN 'no items were extracted'
           ELSE n_items || ' items were extracted, expected ' || item_count END AS problem
      FROM every_page),
    sized AS (SELECT c.page_id, size_bytes, c.original_chars, c.removed_tags, c.removed_comments, c.base64_images_removed FROM cleaned c),
    pages AS (SELECT n.* EXCLUDE (size_bytes, original_chars, removed_tags, removed_comments, base64_images_removed), s.* EXCLUDE (page_id)
      FROM named n JOIN sized s USING (page_id))
    SELECT page_id, 1 AS step, 'admission' AS stage, CASE WHEN reason IS NULL THEN 'info' ELSE 'warning' END AS level,
      CASE WHEN reason IS NULL THEN size_bytes || ' bytes' ELSE 'quarantined: ' || reason END AS message FROM pages
    UNION ALL SELECT page_id, 2, 'cleaning', 'info', original_chars || ' -> ' || length(clean_html) || ' characters; removed ' || removed_tags
      || ' tags, ' || removed_comments || ' comments, ' || base64_images_removed || ' images' FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 3, 'profile', 'info', page_type || ', ' || item_count || ', ' || confidence || ' confidence'
      FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 4, 'extraction', CASE WHEN n_items > 0 THEN 'info' ELSE 'warning' END, n_items || ' ' || shape
      FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 5, 'rendering', 'info', length(formatted_markdown) || ' characters' FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 6, 'validation', grade, concat_ws('; ', 'quality ' || data_quality, problem) FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 7, 'routing', CASE disposition WHEN 'archive' THEN 'info' ELSE 'warning' END, disposition
      FROM pages WHERE reason IS NULL
    UNION ALL SELECT page_id, 8, 'outcome', grade, status || ' ' || report_name FROM pages WHERE reason IS NULL""",
)
def stage_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every stage did with every page."""
    return stage_log(named_of(spark, sf_dir)).drop("ts")


@query(
    "page_dossier",
    f"""WITH {S.VALIDATED}
    SELECT page_id, page_type, source, n_items, total_fields, length(formatted_markdown) AS markdown_chars, status
    FROM validated""",
)
def page_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage found, by page: one flow, in which a page's results lie in its row."""
    counts = count_fields(F.col("items"))
    return (
        PageFlow()
        .validated(pages_of(spark, sf_dir))
        .where(F.col("reason").isNull())
        .select(
            "page_id",
            "hypothesis.page_type",
            "hypothesis.source",
            counts["n_items"].alias("n_items"),
            counts["total_fields"].alias("total_fields"),
            F.length("formatted_markdown").cast("bigint").alias("markdown_chars"),
            "status",
        )
    )


_USAGE_SQL = f"""WITH {S.VALIDATED},
    texts AS (
      SELECT *, '{{"page_type":' || to_json(page_type)::VARCHAR || ',"source":' || to_json(source)::VARCHAR
        || ',"category":' || to_json(category)::VARCHAR || ',"item_count":' || to_json(item_count)::VARCHAR
        || ',"expected_fields":' || to_json(string_split(expected_fields, ','))::VARCHAR
        || ',"confidence":' || to_json(confidence)::VARCHAR || ',"notes":' || to_json(notes)::VARCHAR || '}}' AS hyp
      FROM validated),
    usage AS (
      SELECT page_id, 'Hypothesis' AS task, 'gpt-4o-mini' AS model, length(clean_html) // 4 AS in_tok,
        length(hyp) // 4 AS out_tok, 0.15 AS pin, 0.60 AS pout FROM texts
      UNION ALL SELECT page_id, 'Extraction', 'gemini-2.0-flash', length(clean_html) // 4,
        length(extracted_data) // 4, 0.075, 0.30 FROM texts
      UNION ALL SELECT page_id, 'Formatting', 'gpt-4o-mini', length(extracted_data) // 4,
        length(formatted_markdown) // 4, 0.15, 0.60 FROM texts
      UNION ALL SELECT page_id, 'Validation & Insights', 'gpt-4o', length(formatted_markdown) // 4,
        length('{{"hypothesis_match":' || (status = 'success')::VARCHAR || ',"expected_items":' || to_json(item_count)::VARCHAR
          || ',"actual_items":' || n_items || ',"data_quality":"' || data_quality || '"'
          || CASE WHEN status = 'success' THEN ',"completeness":"all items formatted"'
               || CASE WHEN gaps <> '' THEN ',"notes":"' || gaps || '"' ELSE '' END
             WHEN n_items = 0 THEN ',"problem":"no items were extracted"'
             ELSE ',"problem":"' || n_items || ' items were extracted, expected ' || item_count || '"' END || '}}') // 4,
        2.50, 10.00 FROM texts)
    SELECT task, model, count(*) AS calls, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok,
      round(sum(in_tok * pin + out_tok * pout)::DOUBLE / 1000000, 9) AS cost_usd
    FROM usage GROUP BY ALL"""


@query("page_stage_spend", _USAGE_SQL)
def page_stage_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of all four stages, at the prices of the named models."""
    priced = price_usage(stage_usage(reports_of(spark, sf_dir, PRICED_FLOW), PRICED_FLOW), price_list(spark))
    return spend_by(priced, "task", "model").withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 9))


# ---- pages derived from other tables ------------------------------------------------------------

_IMAGE_PAGE_SQL = """SELECT doc_id AS page_id, 'http://' || source || '.example.com/' || lang AS url,
    '<html><body><p>' || text || '</p><img alt="' || lang || '" src="'
    || CASE WHEN lang IN ('en', 'de') THEN 'data:image/png;base64,' || md5(text) ELSE '/img/' || doc_id || '.png' END
    || '" width=1><IMG SRC=''data:image/gif;base64,R0' || n_chars || '''></body></html>' AS html FROM documents"""


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with inline and linked images."""
    inline = F.concat(F.lit("data:image/png;base64,"), F.md5("text"))
    linked = F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".png"))
    html = F.concat(
        F.lit("<html><body><p>"), F.col("text"), F.lit('</p><img alt="'), F.col("lang"), F.lit('" src="'),
        F.when(F.col("lang").isin("en", "de"), inline).otherwise(linked),
        F.lit("\" width=1><IMG SRC='data:image/gif;base64,R0"), F.col("n_chars").cast("string"),
        F.lit("'></body></html>"),
    )
    url = F.concat(F.lit("http://"), F.col("source"), F.lit(".example.com/"), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html")
    )


@query(
    "inline_images",
    f"""WITH derived AS ({_IMAGE_PAGE_SQL}), {S.cleaned_cte("derived")}
    SELECT page_id, reason, base64_images_removed, md5(clean_html) AS clean_md5, length(clean_html) AS clean_chars,
      contains(clean_html, 'data:image') AS still_inline
    FROM cleaned""",
)
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = PageFlow().clean(from_table(image_pages(spark, sf_dir)))
    return cleaned.select(
        "page_id", "reason", "base64_images_removed", F.md5("clean_html").alias("clean_md5"), "clean_chars",
        F.col("clean_html").contains("data:image").alias("still_inline"),
    )


PRODUCT_FLOW = PageFlow(EngineConfig(min_file_bytes=100))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as product pages with structured data; every ECONOMY part has a broken block."""
    node = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"),
            F.col("p_name").alias("name"),
            F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").alias("size"),
            F.struct(
                F.lit("Offer").alias("@type"),
                F.col("p_retailprice").cast("string").alias("price"),
                F.lit("USD").alias("priceCurrency"),
            ).alias("offers"),
        )
    )
    crumbs = F.concat(
        F.lit('{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"name":"'), F.col("p_type"), F.lit('"}]}')
    )
    block = F.when(F.col("p_type") == "ECONOMY", F.lit("{broken")).otherwise(node)
    html = F.concat(
        F.lit('<html><head><title>Shop</title><script type="application/ld+json">'), block,
        F.lit('</script><script type="application/ld+json">'), crumbs,
        F.lit("</script></head><body><h1>"), F.col("p_name"), F.lit("</h1><p>Only $"),
        F.col("p_retailprice").cast("string"), F.lit(" while in stock at our shop</p></body></html>"),
    )
    url = F.concat(F.lit("https://www.shop.example.com/p/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html")
    )


@query(
    "product_page_profile",
    """SELECT p_partkey AS page_id, 2 - (p_type = 'ECONOMY')::INT AS json_ld_blocks, 'single product' AS page_type,
      'shop.example.com' AS source, p_type AS category, 'single' AS item_count,
      CASE WHEN p_type = 'ECONOMY' THEN 'title,link,price'
           ELSE 'name,brand,category,size,price,currency' END AS expected_fields,
      CASE WHEN p_type = 'ECONOMY' THEN 'low' ELSE 'medium' END AS confidence
    FROM part""",
)
def product_page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PRODUCT_FLOW.profiled(from_table(product_pages(spark, sf_dir))).select(
        "page_id", F.size("json_ld").alias("json_ld_blocks"), "hypothesis.page_type", "hypothesis.source",
        "hypothesis.category", "hypothesis.item_count",
        F.array_join("hypothesis.expected_fields", ",").alias("expected_fields"), "hypothesis.confidence",
    )


@query(
    "product_page_items",
    """SELECT p_partkey AS page_id, 0 AS pos, field_pos, field, value, value_type FROM (
      SELECT p_partkey, p_type, unnest([
        {'field_pos': 0, 'field': 'name', 'value': p_name, 'value_type': 'string'},
        {'field_pos': 1, 'field': 'brand', 'value': p_brand, 'value_type': 'string'},
        {'field_pos': 2, 'field': 'category', 'value': p_type, 'value_type': 'string'},
        {'field_pos': 3, 'field': 'size', 'value': p_size::VARCHAR, 'value_type': 'long'},
        {'field_pos': 4, 'field': 'price', 'value': p_retailprice::VARCHAR, 'value_type': 'string'},
        {'field_pos': 5, 'field': 'currency', 'value': 'USD', 'value_type': 'string'}], recursive := true)
      FROM part WHERE p_type <> 'ECONOMY'
      UNION ALL
      SELECT p_partkey, p_type, unnest([
        {'field_pos': 0, 'field': 'title', 'value': p_name, 'value_type': 'string'},
        {'field_pos': 1, 'field': 'link', 'value': 'https://www.shop.example.com/p/' || p_partkey, 'value_type': 'string'},
        {'field_pos': 2, 'field': 'price', 'value': '$' || p_retailprice, 'value_type': 'string'}], recursive := true)
      FROM part WHERE p_type = 'ECONOMY')""",
)
def product_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_fields(PRODUCT_FLOW.extracted(from_table(product_pages(spark, sf_dir))), "page_id")


@query(
    "product_page_prices",
    """SELECT p_type AS category, count(*) AS pages, min(p_retailprice) AS price_min, max(p_retailprice) AS price_max,
      count(*) AS successes
    FROM part GROUP BY p_type""",
)
def product_page_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as the validated product pages state them."""
    done = PRODUCT_FLOW.validated(from_table(product_pages(spark, sf_dir)))
    stated = text.price(jsontext.field_value(F.get(F.col("items"), F.lit(0)), "price"))
    return done.groupBy(F.col("hypothesis.category").alias("category")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.min(stated).alias("price_min"),
        F.max(stated).alias("price_max"),
        F.count_if(F.col("status") == "success").alias("successes"),
    )
