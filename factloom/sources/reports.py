"""Stored report JSON, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import jsontext, text
from factloom.schemas import REPORT


def read_report_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One report per file, however it is laid out over lines."""
    files = spark.read.text(paths, wholetext=True)
    return parse_reports(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("report_json")))


def read_report_table(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by the engine: one JSON text per row."""
    return parse_reports(spark.read.parquet(path).select(F.col("report_name").alias("path"), "report_json"))


def parse_reports(reports: DataFrame) -> DataFrame:
    """(path, report_json) -> envelope columns plus `shape` and `items` of the extracted data.

    Pages with the single `item` and with listed `items` come out alike. A text that is no report
    keeps its row with null members.
    """
    parsed = reports.withColumn("_r", F.from_json("report_json", REPORT))
    data = F.col("_r.extracted_data")
    return parsed.select(
        "path",
        F.regexp_replace(text.stem(F.col("path")), "_(?:INCOMPLETE|FAILED|DEBUG)$", "").alias("base_name"),
        "_r.meta",
        "_r.hypothesis",
        "_r.validation",
        "_r.insights",
        "_r.statistics",
        F.col("_r.issue").alias("user_message"),
        F.col("_r.partial_insights.summary").alias("partial_summary"),
        data.alias("extracted_data"),
        jsontext.extraction_shape(data).alias("shape"),
        jsontext.extraction_items(data).alias("items"),
    )
