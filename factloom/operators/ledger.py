"""What processing costs: usage rows priced, and spend by task, model, page and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import (
    TASK_EXTRACT,
    TASK_PROFILE,
    TASK_RENDER,
    TASK_VALIDATE,
    EngineConfig,
)
from factloom.functions import text

PRICE = "decimal(10,6)"
TOKENS = "decimal(15,0)"
COST = "decimal(20,12)"


def call_cost(in_tok: Column, out_tok: Column, price_in: Column, price_out: Column) -> Column:
    """Exact cost in USD of one call: tokens per million times the price, as a decimal.

    Exact for up to 10^15 tokens and prices below 10,000 with six decimals; twelve decimals remain.
    Decimals make sums independent of the order in which partial results meet.
    """
    micro = (
        in_tok.cast(TOKENS) * price_in.cast(PRICE)
        + out_tok.cast(TOKENS) * price_out.cast(PRICE)
    )
    return (micro * F.lit("0.000001").cast("decimal(7,6)")).cast(COST)


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, in_tok, out_tok, ...) -> the same rows with `cost_usd`; an unknown model costs 0.

    The join is broadcast where Spark knows the price list to be small.
    """
    none = F.lit(0).cast(PRICE)
    return (
        usage.join(prices, "model", "left")
        .withColumn(
            "cost_usd",
            call_cost(
                F.col("in_tok"), F.col("out_tok"),
                F.coalesce(F.col("price_in"), none), F.coalesce(F.col("price_out"), none),
            ),
        )
        .drop("price_in", "price_out")
    )


def ledger_rows(priced: DataFrame) -> DataFrame:
    """The ledger layout, cost as text with six decimals."""
    cost = F.concat(F.lit("$"), F.bround("cost_usd", 6).cast("decimal(20,6)").cast("string"))
    return priced.select(
        text.iso_stamp(F.col("ts")).alias("Timestamp"),
        F.col("task").alias("Task"),
        F.col("model").alias("Model"),
        F.col("in_tok").alias("Input_Tokens"),
        F.col("out_tok").alias("Output_Tokens"),
        cost.alias("Cost_USD"),
    )


def _spend() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.sum("cost_usd").alias("cost_usd"),
    ]


def spend_by(priced: DataFrame, *keys: str | Column) -> DataFrame:
    return priced.groupBy(*keys).agg(*_spend())


def spend_rollup(priced: DataFrame, *keys: str) -> DataFrame:
    """Spend with subtotals; `level` is 0 for full detail and grows towards the grand total.

    Detail is aggregated first, so the subtotals expand the few aggregated rows and not the usage.
    """
    detail = spend_by(priced, *keys)
    return detail.rollup(*keys).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("calls").alias("calls"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def spend_per_day(priced: DataFrame, *keys: str) -> DataFrame:
    return priced.groupBy(F.date_trunc("day", F.col("ts")).alias("day"), *keys).agg(*_spend())


def project_spend(priced: DataFrame, site: str, page: str, pages: int) -> DataFrame:
    """Average cost of a site's pages, scaled to a number of pages."""
    per_page = priced.groupBy(site, page).agg(F.sum("cost_usd").alias("_cost"))
    by_site = per_page.groupBy(site).agg(
        F.count(F.lit(1)).alias("pages_seen"), F.sum("_cost").alias("cost_usd")
    )
    average = F.col("cost_usd").cast("double") / F.col("pages_seen")
    return by_site.withColumns(
        {"avg_cost_usd": average, "projected_cost_usd": average * F.lit(float(pages))}
    )


def stage_usage(pages: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Usage rows of the processed pages: one per page and stage.

    Tokens reported by a swapped-in stage (`<task>_in_tok`, `<task>_out_tok`) are taken as they
    are; else they are estimated from the characters the stage reads and writes.
    """
    per = cfg.chars_per_token
    estimated = {
        TASK_PROFILE: ("profile", F.length("clean_html"), F.length(F.to_json("hypothesis"))),
        TASK_EXTRACT: ("extract", F.length("clean_html"), F.length("extracted_data")),
        TASK_RENDER: ("render", F.length("extracted_data"), F.length("formatted_markdown")),
        TASK_VALIDATE: (
            "validate",
            F.length("formatted_markdown"),
            F.length(F.to_json("validation")),
        ),
    }
    rows = []
    for task, (stage, read, written) in estimated.items():
        reported = {c: F.col(c) if c in pages.columns else F.lit(None).cast("bigint")
                    for c in (f"{stage}_in_tok", f"{stage}_out_tok")}
        in_tok, out_tok = reported.values()
        rows.append(
            F.struct(
                F.lit(task).alias("task"),
                F.lit(cfg.stage_models[task]).alias("model"),
                F.coalesce(in_tok, F.floor(read / F.lit(per)).cast("bigint")).alias("in_tok"),
                F.coalesce(out_tok, F.floor(written / F.lit(per)).cast("bigint")).alias("out_tok"),
            )
        )
    return (
        pages.where(F.col("reason").isNull())
        .select("page_id", F.col("processed_at").alias("ts"), F.explode(F.array(*rows)).alias("_u"))
        .select("page_id", "ts", "_u.task", "_u.model", "_u.in_tok", "_u.out_tok")
    )
