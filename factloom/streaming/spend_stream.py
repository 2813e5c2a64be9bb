"""Spend over time while ledger rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_spend(priced: DataFrame, window: str = "1 day", late: str = "1 hour", *keys: str) -> DataFrame:
    """Spend per time window and keys, over a table or a stream. In a stream a window is final once the watermark has passed it,
    and rows later than `late` count nowhere: it is for live figures. `start_spend_stream` loses no row."""
    return (
        priced.withWatermark("ts", late)
        .groupBy(F.window("ts", window), *keys)
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("in_tok").alias("in_tok"),
            F.sum("out_tok").alias("out_tok"),
            F.sum("cost_usd").alias("cost_usd"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "calls", "in_tok", "out_tok", "cost_usd")
    )


LEDGER, SPEND = "ledger", "spend"
_SUMS = ("calls", "in_tok", "out_tok", "cost_usd")


def correct_spend(priced: DataFrame, batch_id: int, root: str, window: str, keys: tuple[str, ...]) -> None:
    """Keep the rows of one batch, and add up anew the windows that it touched, from all rows ever kept.

    The ledger lies in folders by day and batch, so only the days of touched windows are listed and read, and a batch that
    runs again replaces its own folders. Results are written by version; earlier versions of a window stay until they are
    read over. Rows without a time are kept and belong to no window.
    """
    spark = priced.sparkSession
    timed = priced.where("ts IS NOT NULL").withColumn("window_start", F.window("ts", window)["start"])
    rows = timed.unionByName(priced.where("ts IS NULL").withColumn("window_start", F.lit(None).cast("timestamp")))
    rows = rows.withColumns({"day": F.to_date("window_start"), "batch_id": F.lit(batch_id)})
    keep = rows.write.partitionBy("day", "batch_id").option("partitionOverwriteMode", "dynamic")
    keep.mode("overwrite").parquet(f"{root}/{LEDGER}")
    # One row a day of the batch.
    days = [str(r.day) for r in rows.select("day").where("day IS NOT NULL").distinct().collect()]
    if not days:
        return
    kept = spark.read.schema(rows.schema).option("basePath", f"{root}/{LEDGER}").parquet(*(f"{root}/{LEDGER}/day={d}" for d in days))
    touched = kept.where(F.col("batch_id") == batch_id).select("window_start").distinct()
    again = kept.join(touched, "window_start", "left_semi").groupBy("day", "window_start", *keys)
    sums = again.agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in _SUMS[1:]))
    done = sums.withColumn("version", F.lit(batch_id)).write.partitionBy("day", "version")
    done.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/{SPEND}")


def read_spend(spark: SparkSession, root: str) -> DataFrame:
    """Spend per window and keys as the latest version of each window states it."""
    every = spark.read.parquet(f"{root}/{SPEND}")
    latest = every.groupBy("window_start").agg(F.max("version").alias("version"))
    return every.join(latest, ["window_start", "version"]).drop("day", "version")


def start_spend_stream(
    priced: DataFrame,
    root: str,
    window: str = "1 day",
    keys: tuple[str, ...] = (),
    checkpoint: str | None = None,
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Keep a ledger and its spend up to date while rows arrive in any order: no row is too late, and there is no watermark and no
    state. A window is read again only when rows of it arrive."""
    writer = priced.writeStream.queryName("spend_stream").option("checkpointLocation", checkpoint or f"{root}/_spend_stream")
    writer = writer.foreachBatch(lambda batch, batch_id: correct_spend(batch, batch_id, root, window, keys))
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
