"""Stored ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import LEDGER_CSV


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV -> ts, task, model, in_tok, out_tok, cost_usd. Unreadable cells become null."""
    rows = spark.read.schema(LEDGER_CSV).csv(path, header=True)
    return rows.select(
        F.col("Timestamp").try_cast("timestamp").alias("ts"),
        F.col("Task").alias("task"),
        F.col("Model").alias("model"),
        F.col("Input_Tokens").alias("in_tok"),
        F.col("Output_Tokens").alias("out_tok"),
        F.regexp_replace("Cost_USD", "[$]", "").try_cast("decimal(20,12)").alias("cost_usd"),
    )
