"""Reports of a page: Markdown, JSON envelope, debug record, and where the page goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext, text
from factloom.operators.naming import status_suffix
from factloom.operators.validate import INCOMPLETE, SUCCESS

# The headings of the two report layouts.
SUCCESS_TITLE = "# 📊 Extraction Report: "
SUCCESS_STATUS = "## ✅ Status: SUCCESS"
ANALYSIS = "### 🔍 Page Analysis"
SUMMARY = "### 💡 Executive Summary"
FINDINGS = "### 🎯 Key Findings"
STATISTICS = "### 📈 Statistics"
RECOMMENDATION = "### 💭 Recommendation"
VALIDATION = "### ✅ Validation"
FAILURE_TITLE = "# ⚠️ Extraction Report: "
FAILURE_STATUS = "## ❌ Status: EXTRACTION ISSUE"
FAILURE_ANALYSIS = "### 🔍 Page Analysis (Hypothesis)"
WENT_WRONG = "### ⚠️ What Went Wrong"
PARTIAL_RESULTS = "### 📦 Partial Results"
PARTIAL_DATA = "### 📋 Partial Data Extracted"
NEXT_STEPS = (
    "### 🔧 Next Steps\n"
    "1. Review the DEBUG file to see what was extracted\n"
    "2. Check if the HTML file is complete and well-formed\n"
    "3. Try re-processing the file\n"
    "4. If issue persists, this page type may need special handling"
)
RULE = "---"
# Fixed value: partial data of no more characters is not shown.
PARTIAL_LEAST = 50


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def _line(label: str, value: Column, more: bool) -> Column:
    return F.concat(F.lit(f"**{label}:** "), value, F.lit("  " if more else ""))


def _block(*lines: Column | str) -> Column:
    return F.array_join(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]), "\n")


def _optional(heading: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", _block(heading, value))


def success_markdown(
    original: Column, stamp: Column, hypothesis: Column, validation: Column, insights: Column,
    statistics: Column, formatted: Column, name: Column,
) -> Column:
    parts = [
        _block(F.concat(F.lit(SUCCESS_TITLE), original), _line("Processed", stamp, False)),
        F.lit(SUCCESS_STATUS),
        _block(
            ANALYSIS,
            _line("Type", or_default(hypothesis["page_type"], "Unknown"), True),
            _line("Source", or_default(hypothesis["source"], "Unknown"), True),
            _line("Category", or_default(hypothesis["category"], "Unknown"), True),
            _line("Items Found", or_default(statistics["total_items"], "Unknown"), False),
        ),
        _block(SUMMARY, or_default(insights["executive_summary"], "Data extracted successfully.")),
        _optional(FINDINGS, insights["key_findings"]),
        _optional(STATISTICS, statistics["key_metrics"]),
        F.lit(RULE),
        F.coalesce(formatted, F.lit("")),
        F.lit(RULE),
        _optional(RECOMMENDATION, insights["recommendation"]),
        _block(
            VALIDATION,
            _line("Data Quality", or_default(validation["data_quality"], "Unknown"), True),
            _line("Completeness", or_default(validation["completeness"], "Complete"), False),
        ),
        _block(
            RULE,
            F.concat(F.lit("*Full JSON data: `"), name, F.lit(".json`*  ")),
            F.concat(F.lit("*Debug info: `"), name, F.lit("_DEBUG.json`*")),
            "",
        ),
    ]
    return F.concat_ws("\n\n", *parts)


def failure_markdown(
    original: Column, stamp: Column, hypothesis: Column, validation: Column, user_message: Column,
    partial_summary: Column, formatted: Column, name: Column, status: Column, cfg: EngineConfig,
) -> Column:
    expected = or_default(validation["expected_items"], "Unknown")
    parts = [
        _block(F.concat(F.lit(FAILURE_TITLE), original), _line("Processed", stamp, False)),
        F.lit(FAILURE_STATUS),
        _block(
            FAILURE_ANALYSIS,
            _line("Type", or_default(hypothesis["page_type"], "Unknown"), True),
            _line("Source", or_default(hypothesis["source"], "Unknown"), True),
            _line("Category", or_default(hypothesis["category"], "Unknown"), True),
            _line("Expected Items", expected, False),
        ),
        _block(WENT_WRONG, or_default(user_message, "Extraction failed.")),
        _block(
            _line("Problem", or_default(validation["problem"], "Unknown issue"), True),
            F.concat(F.lit("**Expected:** "), expected, F.lit(" items  ")),
            F.concat(
                F.lit("**Actually Got:** "), or_default(validation["actual_items"], "Unknown"), F.lit(" items")
            ),
        ),
        _optional(PARTIAL_RESULTS, partial_summary),
        F.when(F.length(formatted) > PARTIAL_LEAST, _block(PARTIAL_DATA, formatted)),
        F.lit(NEXT_STEPS),
        _block(
            RULE,
            F.concat(F.lit("*Partial data: `"), name, status_suffix(status), F.lit(".json`*  ")),
            F.concat(F.lit("*Debug info: `"), name, F.lit("_DEBUG.json`*")),
            "",
        ),
    ]
    return F.concat_ws("\n\n", *parts)


def report_json() -> Column:
    """The report as JSON text: nulls and non-ASCII kept, key order of the items kept, and only the
    members of its outcome."""
    hypothesis, status = F.col("hypothesis"), F.col("status")
    keep = {"ignoreNullFields": "false"}

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))

    meta = F.to_json(
        F.struct(
            text.minute_stamp(F.col("processed_at")).alias("timestamp"),
            F.col("original_file"),
            status.alias("status"),
            *[or_default(hypothesis[f], "Unknown").alias(f) for f in ("page_type", "source", "category")],
        ),
        keep,
    )
    always = [
        member("meta", meta),
        member("hypothesis", F.to_json(hypothesis, keep)),
        member("extracted_data", F.col("extracted_data")),
        member("validation", F.to_json(F.col("validation"), keep)),
    ]
    success = [
        member("insights", F.to_json(F.col("insights"), keep)),
        member("statistics", F.to_json(F.col("statistics"), keep)),
    ]
    issue = F.to_json(F.array(or_default(F.col("user_message"), "Extraction failed")))
    other = [
        member("issue", F.substring(issue, F.lit(2), F.length(issue) - 2)),
        member("partial_insights", F.to_json(F.struct(F.col("partial_summary").alias("summary")), keep)),
    ]
    return F.concat(
        F.lit("{"),
        F.when(status == SUCCESS, F.concat_ws(",", *always, *success)).otherwise(
            F.concat_ws(",", *always, *other)
        ),
        F.lit("}"),
    )


def debug_json() -> Column:
    """The debug record: profile, extraction, length of the rendering, validation; always whole."""
    keep = {"ignoreNullFields": "false"}
    validation = F.struct(
        F.col("status"), F.col("validation"), F.col("insights"), F.col("statistics"),
        F.col("user_message"), F.struct(F.col("partial_summary").alias("summary")).alias("partial_insights"),
    )
    head = F.to_json(
        F.struct(
            text.minute_stamp(F.col("processed_at")).alias("timestamp"),
            F.col("original_file"),
            F.col("hypothesis"),
        ),
        keep,
    )
    length = F.coalesce(F.length("formatted_markdown"), F.lit(0)).cast("string")
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"extracted_data":'), F.coalesce(F.col("extracted_data"), F.lit("null")),
        F.lit(',"formatted_markdown_length":'), length,
        F.lit(',"validation_result":'), F.to_json(validation, keep),
        F.lit("}"),
    )


def make_reports(validated: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add extracted_data, report_markdown, report_json and debug_json to named page rows."""
    base = validated.withColumn("extracted_data", jsontext.items_json(F.col("items"), F.col("shape")))
    stamp = text.minute_stamp(F.col("processed_at"))
    original, hypothesis, validation = F.col("original_file"), F.col("hypothesis"), F.col("validation")
    good = success_markdown(
        original, stamp, hypothesis, validation, F.col("insights"), F.col("statistics"),
        F.col("formatted_markdown"), F.col("base_name"),
    )
    bad = failure_markdown(
        original, stamp, hypothesis, validation, F.col("user_message"), F.col("partial_summary"),
        F.col("formatted_markdown"), F.col("base_name"), F.col("status"), cfg,
    )
    return base.withColumns(
        {
            "report_markdown": F.when(F.col("status") == SUCCESS, good).otherwise(bad),
            "report_json": report_json(),
            "debug_json": debug_json(),
        }
    )


def run_log(reports: DataFrame) -> DataFrame:
    """One row per page and outcome: ts, level, page_id, message."""
    level = (
        F.when(F.col("status") == SUCCESS, F.lit("info"))
        .when((F.col("status") == INCOMPLETE) | F.col("reason").isNotNull(), F.lit("warning"))
        .otherwise(F.lit("error"))
    )
    message = F.when(
        F.col("reason").isNotNull(), F.concat(F.lit("quarantined: "), F.col("reason"))
    ).otherwise(F.concat_ws(" ", F.col("status"), F.col("report_name")))
    return reports.select(
        F.col("processed_at").alias("ts"), level.alias("level"), "page_id", message.alias("message")
    )


def stage_log(reports: DataFrame) -> DataFrame:
    """One row per page and stage that it went through: ts, step, stage, level, page_id, message.

    The outcomes lie in the page's row, so they are put into an array there and taken apart once; a quarantined page
    stops after its admission. The last row is that of `run_log`.
    """
    admitted = F.col("reason").isNull()
    text_of = lambda c: F.col(c).cast("string")
    n = F.size("items")

    def event(step: int, stage: str, level: Column, message: Column) -> Column:
        told = F.struct(F.lit(step).alias("step"), F.lit(stage).alias("stage"), level.alias("level"), message.alias("message"))
        return F.when(admitted, told)

    info = F.lit("info")
    outcome = F.concat_ws(" ", F.col("status"), F.col("report_name"))
    level = F.when(F.col("status") == SUCCESS, info).when(F.col("status") == INCOMPLETE, F.lit("warning")).otherwise(F.lit("error"))
    quarantined = F.struct(
        F.lit(1).alias("step"), F.lit("admission").alias("stage"), F.lit("warning").alias("level"),
        F.concat(F.lit("quarantined: "), F.col("reason")).alias("message"),
    )
    events = F.array(
        F.coalesce(
            event(1, "admission", info, F.concat(text_of("size_bytes"), F.lit(" bytes"))),
            quarantined,
        ),
        event(
            2,
            "cleaning",
            info,
            F.concat(
                text_of("original_chars"), F.lit(" -> "), text_of("clean_chars"), F.lit(" characters; removed "),
                text_of("removed_tags"), F.lit(" tags, "), text_of("removed_comments"), F.lit(" comments, "),
                text_of("base64_images_removed"), F.lit(" images"),
            ),
        ),
        event(
            3,
            "profile",
            info,
            F.concat_ws(", ", "hypothesis.page_type", "hypothesis.item_count", F.concat(F.col("hypothesis.confidence"), F.lit(" confidence"))),
        ),
        event(
            4, "extraction", F.when(n > 0, info).otherwise(F.lit("warning")), F.concat(n.cast("string"), F.lit(" "), F.col("shape"))
        ),
        event(5, "rendering", info, F.concat(F.length("formatted_markdown").cast("string"), F.lit(" characters"))),
        event(
            6, "validation", level, F.concat_ws("; ", F.concat(F.lit("quality "), F.col("validation.data_quality")), "validation.problem")
        ),
        event(7, "routing", F.when(F.col("disposition") == "archive", info).otherwise(F.lit("warning")), F.col("disposition")),
        event(8, "outcome", level, outcome),
    )
    told = reports.select("processed_at", "page_id", F.inline(F.filter(events, lambda e: e.isNotNull())))
    return told.select(F.col("processed_at").alias("ts"), "step", "stage", "level", "page_id", "message")
