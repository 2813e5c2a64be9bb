"""Price lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators.ledger import PRICE


def price_list(spark: SparkSession, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """model, price_in, price_out: USD per one million tokens."""
    rows = [(m, str(i), str(o)) for m, (i, o) in cfg.prices.items()]
    return spark.createDataFrame(rows, "model string, i string, o string").select(
        "model", F.col("i").cast(PRICE).alias("price_in"), F.col("o").cast(PRICE).alias("price_out")
    )


def read_price_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the header model,input,output."""
    return spark.read.schema("model string, input string, output string").csv(path, header=True).select(
        "model",
        F.col("input").try_cast(PRICE).alias("price_in"),
        F.col("output").try_cast(PRICE).alias("price_out"),
    )


def prices_of(prices: DataFrame, models: tuple[str, ...]) -> tuple[tuple, ...]:
    """(input, output) price of each model, zero for one that is not listed; one row per model is read."""
    listed = prices.where(F.col("model").isin(*models)).groupBy("model").agg(F.max("price_in"), F.max("price_out"))
    found = {r[0]: (r[1] or 0, r[2] or 0) for r in listed.collect()}
    return tuple(found.get(m, (0, 0)) for m in models)
