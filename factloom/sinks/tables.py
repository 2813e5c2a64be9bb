"""Writers of reports, source pages, ledger rows, log rows and comparison results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.ledger import ledger_rows
from factloom.operators.report import stage_log

REPORTS = "reports"
DEBUG = "debug"
#: The finished pages, HTML included, in folders by where they go: archive or errors.
PAGES = "pages"
LEDGER = "ledger"
LOG = "run_log"
FINISHED = PAGES


def batch_folder(root: str, table: str, batch_id: int | str) -> str:
    return os.path.join(root, table, f"batch_id={batch_id}")


def write_finished(reports: DataFrame, root: str, batch_id: int | str) -> str:
    """The finished page rows of one batch, the only copy of their HTML; the other tables are derived from it."""
    path = batch_folder(root, FINISHED, batch_id)
    reports.write.mode("overwrite").partitionBy("disposition").parquet(path)
    return path


def write_reports(finished: DataFrame, root: str, batch_id: int | str) -> None:
    """Reports by status: name, Markdown, JSON text, and the extracted data as a variant."""
    data = F.try_parse_json(F.col("extracted_data")).alias("extracted_data")
    (
        finished.where(F.col("reason").isNull())
        .select("page_id", "report_name", "report_markdown", "report_json", data, "status")
        .write.mode("overwrite")
        .partitionBy("status")
        .parquet(batch_folder(root, REPORTS, batch_id))
    )


def write_debug(finished: DataFrame, root: str, batch_id: int | str) -> None:
    """Debug records, whatever the status; the name never carries it."""
    (
        finished.where(F.col("reason").isNull())
        .select("debug_name", F.col("debug_json").alias("record"))
        .write.mode("overwrite")
        .parquet(batch_folder(root, DEBUG, batch_id))
    )


def write_ledger(priced: DataFrame, root: str, batch_id: int | str) -> None:
    """Ledger rows as CSV with a header, in the published layout."""
    (
        ledger_rows(priced)
        .write.mode("overwrite")
        .option("header", True)
        .csv(batch_folder(root, LEDGER, batch_id))
    )


def write_log(finished: DataFrame, root: str, batch_id: int | str) -> None:
    """Every stage of every page; the rows of stage `outcome` and `admission` say how it ended."""
    stage_log(finished).write.mode("overwrite").parquet(batch_folder(root, LOG, batch_id))


def write_report_lines(finished: DataFrame, path: str) -> None:
    """Reports as JSON lines in plain text files."""
    finished.where(F.col("reason").isNull()).select("report_json").write.mode("overwrite").text(path)


def write_comparison(a: DataFrame, b: DataFrame, reports: DataFrame, root: str) -> None:
    """Both extractions and the comparison reports."""
    a.write.mode("overwrite").parquet(os.path.join(root, "extraction_a"))
    b.write.mode("overwrite").parquet(os.path.join(root, "extraction_b"))
    reports.write.mode("overwrite").parquet(os.path.join(root, "comparison"))
