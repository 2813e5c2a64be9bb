"""Queries over the events as usage of hosted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ledger import (
    ledger_rows,
    price_usage,
    project_spend,
    spend_by,
    spend_per_day,
    spend_rollup,
)
from factloom.queries.registry import query, table
from factloom.session import fresh_folder
from factloom.sources.prices import price_list
from factloom.streaming.spend_stream import read_spend, start_spend_stream, windowed_spend

# The k of an event's properties picks the model; the last one is on no price list.
_USAGE_SQL = """
prices(model, price_in, price_out) AS (VALUES
  ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('gemini-1.5-flash', 0.075, 0.3), ('gemini-1.5-pro', 1.25, 5.0),
  ('gemini-2.5-flash', 0.3, 2.5), ('gemini-2.5-pro', 1.25, 5.0), ('gemini-2.0-flash', 0.075, 0.3),
  ('gemini-flash-latest', 0.075, 0.3)),
usage AS (
  SELECT event_id, ts, user_id, event_type AS task,
    CASE WHEN k < 30 THEN 'gpt-4o' WHEN k < 60 THEN 'gpt-4o-mini' WHEN k < 90 THEN 'gemini-2.5-flash'
         ELSE 'unlisted-model' END AS model,
    floor(value * 1000)::BIGINT AS in_tok, floor(value * 100)::BIGINT AS out_tok
  FROM (SELECT *, (props::JSON->>'k')::INT AS k FROM events)),
priced AS (
  SELECT u.*, (u.in_tok * coalesce(p.price_in, 0) + u.out_tok * coalesce(p.price_out, 0))::DECIMAL(28, 6) AS micro
  FROM usage u LEFT JOIN prices p USING (model))"""
# A cost has at most nine decimals, so a whole number of thousandths of a micro-dollar is exact.
_COST = "sum(micro * 1000)::BIGINT / 1000000000.0::DOUBLE AS cost_usd"
_SUMS = f"count(*) AS calls, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok, {_COST}"


def priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_events(table(spark, sf_dir, "events"))


def priced_events(events: DataFrame) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    usage = events.select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("task"),
        F.when(k < 30, F.lit("gpt-4o"))
        .when(k < 60, F.lit("gpt-4o-mini"))
        .when(k < 90, F.lit("gemini-2.5-flash"))
        .otherwise(F.lit("unlisted-model"))
        .alias("model"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("in_tok"),
        F.floor(F.col("value") * 100).cast("bigint").alias("out_tok"),
    )
    return price_usage(usage, price_list(events.sparkSession))


def as_number(spend: DataFrame) -> DataFrame:
    return spend.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query(
    "ledger_rows",
    f"""WITH {_USAGE_SQL}
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "Timestamp", task AS "Task", model AS "Model",
      in_tok AS "Input_Tokens", out_tok AS "Output_Tokens",
      '$' || (roundbankers(micro::DOUBLE, 0)::DECIMAL(18, 0) * 0.000001)::DECIMAL(20, 6)::VARCHAR AS "Cost_USD"
    FROM priced""",
)
def ledger_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_rows(priced_usage(spark, sf_dir))


@query(
    "spend_by_task_and_model",
    f"""WITH {_USAGE_SQL}
    SELECT task, model, GROUPING(task, model)::BIGINT AS level, {_SUMS} FROM priced GROUP BY ROLLUP (task, model)""",
)
def spend_by_task_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(spend_rollup(priced_usage(spark, sf_dir), "task", "model"))


@query("spend_by_user", f"WITH {_USAGE_SQL} SELECT user_id, {_SUMS} FROM priced GROUP BY user_id")
def spend_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(spend_by(priced_usage(spark, sf_dir), "user_id"))


@query(
    "spend_per_day",
    f"""WITH {_USAGE_SQL}
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, model, {_SUMS} FROM priced GROUP BY ALL""",
)
def spend_per_day_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spend_per_day(priced_usage(spark, sf_dir), "model")
    return as_number(days.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query(
    "windowed_spend",
    f"""WITH {_USAGE_SQL}
    SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS window_start, task, {_SUMS}
    FROM priced GROUP BY ALL""",
)
def windowed_spend_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the live spend stream."""
    spend = windowed_spend(priced_usage(spark, sf_dir), "6 hours", "1 hour", "task")
    return as_number(spend.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))


@query(
    "spend_projection",
    f"""WITH {_USAGE_SQL},
    per_page AS (SELECT task, user_id, sum(micro) AS micro FROM priced GROUP BY ALL)
    SELECT task, count(*) AS pages_seen, {_COST},
      sum(micro * 1000)::BIGINT / 1000000000.0::DOUBLE / count(*) AS avg_cost_usd,
      sum(micro * 1000)::BIGINT / 1000000000.0::DOUBLE / count(*) * 100 AS projected_cost_usd
    FROM per_page GROUP BY task""",
)
def spend_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task as a site, each user as one of its pages, scaled to 100 pages."""
    projected = project_spend(priced_usage(spark, sf_dir), "task", "user_id", 100)
    return as_number(projected)


@query(
    "spend_stream_corrected",
    f"""WITH {_USAGE_SQL}
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, model, {_SUMS} FROM priced GROUP BY ALL""",
)
def spend_stream_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per day of a stream whose files arrive in no order of time: every row is weeks late for most windows."""
    folder = fresh_folder(spark, "spend")
    events = table(spark, sf_dir, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/arrived")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived")
    start_spend_stream(priced_events(arriving), folder, "1 day", ("model",), available_now=True).awaitTermination()
    spend = read_spend(spark, folder).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    return as_number(spend.drop("window_start"))
