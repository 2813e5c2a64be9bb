"""Queries that apply the text, number and date functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.queries import page_sql as S
from factloom.queries.registry import query, table


@query(
    "text_previews",
    """SELECT doc_id, md5(left(text, 50000)) AS sample_md5,
      md5(CASE WHEN length(text) > 3000 THEN left(text, 3000) || '...' ELSE text END) AS preview_md5,
      md5(left(text, 500)) AS head_md5,
      CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS shown
    FROM documents""",
)
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cuts: page sample, validator preview, raw head, and shown value."""
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.prefix(whole, 50_000)).alias("sample_md5"),
        F.md5(text.preview(whole, 3_000)).alias("preview_md5"),
        F.md5(text.prefix(whole, 500)).alias("head_md5"),
        text.preview(whole, 50).alias("shown"),
    )


@query(
    "text_sizes",
    """SELECT doc_id, length(text) // 4 AS tokens, length(text) / 1024.0::DOUBLE AS kb,
      CASE WHEN n_chars <> 0 THEN length(text)::DOUBLE / n_chars END AS stated_ratio,
      strlen(text) AS bytes FROM documents""",
)
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.tokens(whole).alias("tokens"),
        text.kilobytes(whole).alias("kb"),
        text.ratio(F.length(whole), F.col("n_chars")).alias("stated_ratio"),
        F.octet_length(whole).cast("bigint").alias("bytes"),
    )


@query(
    "name_texts",
    f"""WITH titled AS (SELECT *, p_brand || ' ' || p_name || ' (' || p_type || ', ' || p_size || ')' AS title FROM part)
    SELECT p_partkey, regexp_replace(title, '[^a-zA-Z0-9]', '', 'g') AS alphanumeric,
      regexp_replace(title, '[^a-zA-Z0-9\\s]', '', 'g') AS alphanumeric_words,
      {S.sanitized("title", "-")} AS hyphenated, {S.sanitized("title", "")} AS compacted,
      upper(left(left(p_type, 20), 1)) || lower(substr(left(p_type, 20), 2)) AS capitalized,
      array_to_string(string_split(title, ' ')[:3], ' ') AS three_words,
      array_to_string(list_filter(string_split_regex(trim(replace(title, p_brand, '')), '\\s+'),
                                  lambda w: length(w) > 1)[:2], ' ') AS model_words,
      coalesce(nullif(CASE WHEN p_size < 25 THEN '' ELSE p_name END, ''), nullif(p_type, ''), 'Unknown') AS first_filled
    FROM titled""",
)
def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(
        "", "p_brand", F.lit(" "), "p_name", F.lit(" ("), "p_type", F.lit(", "), F.col("p_size").cast("string"), F.lit(")")
    )
    t = F.col("title")
    sometimes = F.when(F.col("p_size") < 25, F.lit("")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("title", title).select(
        "p_partkey",
        text.alphanumeric(t).alias("alphanumeric"),
        text.alphanumeric_words(t).alias("alphanumeric_words"),
        text.hyphenated(t).alias("hyphenated"),
        text.compacted(t).alias("compacted"),
        text.capitalized(text.prefix(F.col("p_type"), 20)).alias("capitalized"),
        text.first_words(t, 3).alias("three_words"),
        text.first_words(F.trim(text.without(t, F.col("p_brand"))), 2, min_chars=2).alias("model_words"),
        F.coalesce(text.first_filled(sometimes, F.col("p_type")), F.lit("Unknown")).alias("first_filled"),
    )


@query(
    "number_texts",
    """SELECT o_orderkey,
      CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice END AS price,
      CASE o_orderstatus WHEN 'F' THEN (o_custkey * 1000)::DOUBLE WHEN 'O' THEN o_custkey::DOUBLE
        ELSE (o_custkey % 100)::DOUBLE END AS magnitude,
      CASE o_orderstatus WHEN 'P' THEN 0 ELSE floor(o_totalprice)::BIGINT END AS first_integer
    FROM orders""",
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from the texts that listings state them in."""
    status, customer = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    price_text = F.when(status == "P", F.lit("Free")).otherwise(
        F.concat(F.lit("US $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" incl. tax"))
    )
    count_text = (
        F.when(status == "F", F.concat(F.lit("("), customer, F.lit("K)")))
        .when(status == "O", F.concat(customer, F.lit(" Reviews")))
        .otherwise(F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("% positive")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.price(price_text).alias("price"),
        text.magnitude(count_text).alias("magnitude"),
        text.first_integer(price_text).alias("first_integer"),
    )


@query(
    "time_texts",
    """SELECT event_id, strftime(ts, '%Y%m%d-%H%M') AS minute_stamp, strftime(ts, '%Y%m%d-%H%M%S') AS second_stamp,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_stamp,
      strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS listed_minute,
      strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS listed_day
    FROM events""",
)
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the reports and ledger, and dates read back from two listing styles."""
    ts = F.col("ts")
    year = F.date_format(ts, "yyyy")
    by_name = text.listing_date(F.date_format(ts, "MMM-d HH:mm"), year)
    by_number = text.listing_date(F.date_format(ts, "MM/dd"), year)
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.minute_stamp(ts).alias("minute_stamp"),
        text.second_stamp(ts).alias("second_stamp"),
        text.iso_stamp(ts).alias("iso_stamp"),
        F.date_format(by_name, "yyyy-MM-dd HH:mm:ss").alias("listed_minute"),
        F.date_format(by_number, "yyyy-MM-dd HH:mm:ss").alias("listed_day"),
    )
