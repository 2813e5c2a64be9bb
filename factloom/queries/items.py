"""Queries over item tables: completeness, coverage, gaps, dominance, names, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import dominance as D
from factloom.operators.admit import unprocessed
from factloom.operators.fields import completeness, field_coverage, gaps
from factloom.operators.naming import base_name, product_part, source_part
from factloom.operators.profile import page_class
from factloom.operators.stats import (
    breakdown,
    concentration,
    counts,
    merged_price_statistics,
    price_statistics,
)
from factloom.queries import page_sql as S
from factloom.queries.registry import query, table

# Documents as items with fields. Labels cover a part of the documents, so quality and toxic hold
# real nulls; short documents say N/A for them.
_DOCUMENT_FIELDS_SQL = """
doc_items AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text,
    CASE WHEN l.quality IS NULL AND d.n_chars < 500 THEN 'N/A' ELSE l.quality::VARCHAR END AS quality,
    CASE WHEN l.toxic IS NULL AND d.lang = 'fr' THEN '' ELSE l.toxic::VARCHAR END AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
doc_fields AS (
  SELECT doc_id, source, 'lang' AS field, lang AS value FROM doc_items
  UNION ALL SELECT doc_id, source, 'n_chars', n_chars::VARCHAR FROM doc_items
  UNION ALL SELECT doc_id, source, 'quality', quality FROM doc_items
  UNION ALL SELECT doc_id, source, 'toxic', toxic FROM doc_items
  UNION ALL SELECT doc_id, source, 'text', text FROM doc_items)"""


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long field table of the documents: source, doc_id, field, value."""
    items = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality").isNull() & (F.col("n_chars") < 500), F.lit("N/A")).otherwise(
        F.col("quality").cast("string")
    )
    toxic = F.when(F.col("toxic").isNull() & (F.col("lang") == "fr"), F.lit("")).otherwise(
        F.col("toxic").cast("string")
    )

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    always = [
        pair("lang", F.col("lang")),
        pair("n_chars", F.col("n_chars").cast("string")),
        pair("quality", quality),
        pair("toxic", toxic),
    ]
    fields = F.array(*always, pair("text", F.col("text")))
    return items.select("source", "doc_id", F.explode(fields).alias("_f")).select("source", "doc_id", "_f.*")


@query(
    "document_completeness",
    f"""WITH {_DOCUMENT_FIELDS_SQL}
    SELECT source, count(DISTINCT doc_id) AS items, count(*) AS total_fields,
      count_if(NOT (value IS NULL OR value IN ('', 'N/A'))) AS populated,
      count_if(value IS NULL OR value IN ('', 'N/A')) AS missing,
      count(*)::DOUBLE / count(DISTINCT doc_id) AS avg_fields_per_item
    FROM doc_fields GROUP BY source""",
)
def document_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(document_fields(spark, sf_dir), ["source"], ["doc_id"])


@query(
    "document_field_coverage",
    f"""WITH {_DOCUMENT_FIELDS_SQL},
    totals AS (SELECT source, count(DISTINCT doc_id) AS items FROM doc_fields GROUP BY source)
    SELECT source, field, items, count(*) AS with_field,
      count_if(value NOT IN ('', 'N/A')) AS with_value, count(*)::DOUBLE / items AS field_share,
      count_if(value NOT IN ('', 'N/A'))::DOUBLE / items AS value_share
    FROM doc_fields JOIN totals USING (source) GROUP BY source, field, items""",
)
def document_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_coverage(document_fields(spark, sf_dir), ["source"], ["doc_id"])


@query(
    "document_gaps",
    f"""WITH {_DOCUMENT_FIELDS_SQL},
    per_item AS (
      SELECT source, doc_id,
        count_if(field = 'quality' AND value NOT IN ('', 'N/A')) > 0 AS q,
        count_if(field = 'toxic' AND value NOT IN ('', 'N/A')) > 0 AS t,
        count_if(field = 'text' AND value NOT IN ('', 'N/A')) > 0 AS o
      FROM doc_fields GROUP BY ALL)
    SELECT source, count(*) AS items, count_if(NOT q) AS without_quality, count_if(NOT t) AS without_toxic,
      count_if(NOT o) AS without_text, count_if(q AND t AND o) AS comparable_items
    FROM per_item GROUP BY source""",
)
def document_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(document_fields(spark, sf_dir), ["source"], ["doc_id"], ["quality", "toxic", "text"])


@query(
    "unprocessed_documents",
    """SELECT doc_id, source, n_chars FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def unprocessed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not in the manifest of those already labelled."""
    arrived = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return unprocessed(arrived, table(spark, sf_dir, "labels"), "doc_id")


# ---- orders as list pages, order lines as their items -------------------------------------------

# (l_orderkey, l_linenumber) repeats, so the order of the lines takes the remaining columns in.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
ORDER_KINDS = {"brand_model": 0.5, "brand": 0.5, "returnflag": 0.3, "linestatus": 0.3}


def order_dominance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *LINE_ORDER)
    lines = lines.join(parts, "l_partkey")
    kinds = {
        "brand_model": D.brand_model(F.col("brand"), F.col("name")),
        "brand": F.col("brand"),
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
    }
    return D.dominant_values(lines, ["l_orderkey"], LINE_ORDER, kinds, ORDER_KINDS)


_DOMINANCE_SQL = """
lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice, l_shipdate) AS pos,
    l_returnflag, l_linestatus, p_brand AS brand,
    array_to_string(list_filter(string_split_regex(replace(p_name, p_brand, ''), '\\s+'),
                                lambda w: length(w) >= 2)[:2], ' ') AS words
  FROM lineitem JOIN part ON p_partkey = l_partkey),
kinds AS (
  SELECT l_orderkey, pos, 'brand_model' AS kind, CASE WHEN words <> '' THEN brand || ' ' || words END AS value,
    0.5 AS threshold FROM lines
  UNION ALL SELECT l_orderkey, pos, 'brand', brand, 0.5 FROM lines
  UNION ALL SELECT l_orderkey, pos, 'returnflag', l_returnflag, 0.3 FROM lines
  UNION ALL SELECT l_orderkey, pos, 'linestatus', l_linestatus, 0.3 FROM lines),
counted AS (
  SELECT l_orderkey, kind, value, threshold, count(*) AS n, min(pos) AS seen FROM kinds
  WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY n DESC, seen) AS rk,
    min(seen) OVER (PARTITION BY l_orderkey, kind) AS kind_seen FROM counted),
sizes AS (SELECT l_orderkey, count(*) AS items FROM lines GROUP BY l_orderkey),
best AS (
  SELECT r.l_orderkey, items, kind, value, n, kind_seen, n::DOUBLE / items AS share,
    items >= 2 AND n::DOUBLE / items >= threshold AS dominant
  FROM ranked r JOIN sizes USING (l_orderkey) WHERE rk = 1),
wide AS (
  SELECT l_orderkey, items,
    max(value) FILTER (kind = 'brand_model') AS brand_model_value, max(n) FILTER (kind = 'brand_model') AS brand_model_n,
    max(share) FILTER (kind = 'brand_model') AS brand_model_share,
    coalesce(bool_or(dominant) FILTER (kind = 'brand_model'), false) AS brand_model_dominant,
    max(value) FILTER (kind = 'brand') AS brand_value, max(n) FILTER (kind = 'brand') AS brand_n,
    max(share) FILTER (kind = 'brand') AS brand_share,
    coalesce(bool_or(dominant) FILTER (kind = 'brand'), false) AS brand_dominant,
    max(value) FILTER (kind = 'returnflag') AS returnflag_value, max(n) FILTER (kind = 'returnflag') AS returnflag_n,
    max(share) FILTER (kind = 'returnflag') AS returnflag_share,
    coalesce(bool_or(dominant) FILTER (kind = 'returnflag'), false) AS returnflag_dominant,
    max(value) FILTER (kind = 'linestatus') AS linestatus_value, max(n) FILTER (kind = 'linestatus') AS linestatus_n,
    max(share) FILTER (kind = 'linestatus') AS linestatus_share,
    coalesce(bool_or(dominant) FILTER (kind = 'linestatus'), false) AS linestatus_dominant,
    arg_min(value, kind_seen * 2 + (kind = 'linestatus')::INT)
      FILTER (dominant AND kind IN ('returnflag', 'linestatus')) AS first_attribute
  FROM best GROUP BY ALL)"""


@query("order_dominance", f"WITH {_DOMINANCE_SQL} SELECT * FROM wide")
def order_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_dominance_of(spark, sf_dir).withColumn(
        "first_attribute", D.first_dominant(["returnflag", "linestatus"])
    )
    return found.drop("first_item", *[f"{k}_first" for k in ORDER_KINDS])


# Profiles of the orders: status and priority say what kind of page and how many items to expect.
_ORDER_PROFILE_SQL = """
profiles AS (
  SELECT o_orderkey AS l_orderkey, o_orderdate, o_orderpriority AS category,
    'Customer #' || o_custkey || ' store' AS source,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'live auction' WHEN '2-HIGH' THEN 'product listing'
      WHEN '3-MEDIUM' THEN 'Search Results' WHEN '5-LOW' THEN 'plain page' ELSE 'catalog page' END AS page_type,
    CASE o_orderstatus WHEN 'O' THEN 'multiple (estimate ' || (o_custkey % 9) || ')' WHEN 'F' THEN (o_custkey % 4)::VARCHAR
      ELSE '' END AS item_count
  FROM orders)"""

_CLASS_SQL = """CASE WHEN lower(page_type) LIKE '%auction%' OR lower(page_type) LIKE '%bid%' THEN 'auction'
    WHEN stated = 1 OR lower(page_type) LIKE '%single%' OR (lower(page_type) LIKE '%product%' AND NOT multiple)
      THEN 'single'
    WHEN multiple OR stated > 1 OR lower(page_type) LIKE '%list%' OR lower(page_type) LIKE '%catalog%'
      OR lower(page_type) LIKE '%search%' OR lower(page_type) LIKE '%results%' THEN 'list'
    ELSE 'unknown' END"""


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_orderdate",
        priority.alias("category"),
        F.concat(F.lit("Customer #"), F.col("o_custkey").cast("string"), F.lit(" store")).alias("source"),
        F.when(priority == "1-URGENT", F.lit("live auction"))
        .when(priority == "2-HIGH", F.lit("product listing"))
        .when(priority == "3-MEDIUM", F.lit("Search Results"))
        .when(priority == "5-LOW", F.lit("plain page"))
        .otherwise(F.lit("catalog page"))
        .alias("page_type"),
        F.when(
            status == "O",
            F.concat(F.lit("multiple (estimate "), (F.col("o_custkey") % 9).cast("string"), F.lit(")")),
        )
        .when(status == "F", (F.col("o_custkey") % 4).cast("string"))
        .otherwise(F.lit(""))
        .alias("item_count"),
    )


@query(
    "order_page_classes",
    f"""WITH {_ORDER_PROFILE_SQL},
    counted AS (
      SELECT *, item_count LIKE '%multiple%' OR item_count LIKE '%many%' AS multiple,
        CASE WHEN item_count LIKE '%multiple%' THEN 0
             ELSE coalesce(TRY_CAST(nullif(regexp_extract(item_count, '([0-9]+)', 1), '') AS BIGINT), 0) END AS stated
      FROM profiles)
    SELECT l_orderkey, page_type, item_count, {_CLASS_SQL} AS page_kind FROM counted""",
)
def order_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_profiles(spark, sf_dir).select(
        "l_orderkey", "page_type", "item_count",
        page_class(F.col("page_type"), F.col("item_count")).alias("page_kind"),
    )


@query(
    "order_report_names",
    f"""WITH {_DOMINANCE_SQL}, {_ORDER_PROFILE_SQL},
    first_lines AS (
      SELECT l_orderkey, arg_min(name, pos) AS first_title FROM (
        SELECT l_orderkey, p_name AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
          l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos
        FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY l_orderkey),
    expected AS (
      SELECT p.*, w.* EXCLUDE (l_orderkey), f.first_title, item_count LIKE '%multiple%' AS multiple,
        CASE WHEN item_count LIKE '%multiple%' THEN 0
             ELSE coalesce(TRY_CAST(nullif(regexp_extract(item_count, '([0-9]+)', 1), '') AS BIGINT), 0) END AS stated
      FROM profiles p LEFT JOIN wide w USING (l_orderkey) LEFT JOIN first_lines f USING (l_orderkey)),
    classed AS (SELECT *, {_CLASS_SQL} AS page_kind FROM expected),
    named AS (
      SELECT *, CASE
        WHEN page_kind = 'single' THEN left(replace(regexp_replace(array_to_string(
            string_split(first_title, ' ')[:3], ' '), '[^a-zA-Z0-9\\s]', '', 'g'), ' ', '-'), 30)
        WHEN page_kind IN ('list', 'auction') AND items >= 2 THEN
          CASE WHEN brand_model_dominant THEN {S.sanitized("brand_model_value", "")}
               WHEN brand_dominant AND first_attribute IS NOT NULL
                 THEN {S.sanitized("brand_value || first_attribute", "")}
               WHEN first_attribute IS NOT NULL
                 THEN {S.sanitized("first_attribute || string_split(category, ' ')[1]", "")} END
        END AS product FROM classed)
    SELECT l_orderkey, page_kind,
      strftime(o_orderdate, '%Y%m%d-%H%M') || '-' || {S.source_part("source")} || '-'
        || coalesce(nullif(product, ''), nullif({S.sanitized("category", "-")}, ''), 'Unknown') || '-' || page_kind
        AS base_name
    FROM named""",
)
def order_report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for reports on orders: every branch of the naming rule, over the whole item table."""
    titles = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("first_title"))
    rows = (
        order_profiles(spark, sf_dir)
        .join(order_dominance_of(spark, sf_dir), "l_orderkey", "left")
        .withColumn("p_partkey", F.col("first_item.l_partkey"))
        .join(titles, "p_partkey", "left")
        .withColumn("page_kind", page_class(F.col("page_type"), F.col("item_count")))
    )
    product = product_part(
        F.col("page_kind"),
        F.col("category"),
        F.col("first_title"),
        F.coalesce(F.col("items"), F.lit(0)),
        F.when(F.col("brand_model_dominant"), F.col("brand_model_value")),
        F.when(F.col("brand_dominant"), F.col("brand_value")),
        D.first_dominant(["returnflag", "linestatus"]),
    )
    name = base_name(
        text.minute_stamp(F.col("o_orderdate")), source_part(F.col("source")), product, F.col("page_kind")
    )
    return rows.select("l_orderkey", "page_kind", name.alias("base_name"))


# ---- statistics over order lines as listed items -------------------------------------------------


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("place")
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return suppliers.join(nations, "s_nationkey").drop("s_nationkey")


@query(
    "price_statistics",
    """SELECT n_name AS place, count(*) AS items, count(*) AS priced, min(l_extendedprice) AS price_min,
      max(l_extendedprice) AS price_max,
      sum(l_extendedprice::DECIMAL(18, 4))::DOUBLE / count(*) AS price_mean,
      strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""",
)
def price_statistics_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and date range of listed items, from price texts such as `US $1234.5`."""
    price_text = F.concat(F.lit("US $"), F.col("l_extendedprice").cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    by_seller = price_statistics(lines, ["l_suppkey"], price_text, F.col("l_shipdate"))
    result = merged_price_statistics(by_seller.join(supplier_nations(spark, sf_dir), "l_suppkey"), ["place"])
    return result.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")}
    )


@query(
    "condition_breakdown",
    """WITH counted AS (
      SELECT n_name AS place, l_returnflag AS condition, count(*) AS items
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
    SELECT place, condition, items, items::DOUBLE / sum(items) OVER (PARTITION BY place) AS share FROM counted""",
)
def condition_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("condition"))
    by_seller = counts(lines, ["l_suppkey", "condition"])
    return breakdown(by_seller.join(supplier_nations(spark, sf_dir), "l_suppkey"), ["place"], "condition")


@query(
    "place_concentration",
    """WITH counted AS (
      SELECT p_brand AS brand, n_name AS place, count(*) AS n
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
      JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, place) AS rk,
        count(*) OVER (PARTITION BY brand) AS values, (sum(n) OVER (PARTITION BY brand))::BIGINT AS items
      FROM counted)
    SELECT brand, values, items, place AS top_value, n AS top_items, n::DOUBLE / items AS top_share
    FROM ranked WHERE rk = 1""",
)
def place_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")
    )
    by_offer = counts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])
    placed = by_offer.join(supplier_nations(spark, sf_dir), "l_suppkey").join(brands, "l_partkey")
    return concentration(placed, ["brand"], "place")
