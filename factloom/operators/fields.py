"""Measures over item fields: per page in the row, and over the long field table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import MISSING_TEXTS
from factloom.functions import jsontext, text


def is_missing(value: Column) -> Column:
    """Null, empty, or N/A. An absent field has no row and counts as nothing."""
    return value.isNull() | value.isin(*MISSING_TEXTS)


def count_fields(items: Column) -> dict[str, Column]:
    """Completeness of one page's items, from its own row."""
    every = F.flatten(F.filter(items, lambda i: i.isNotNull()))
    total = F.size(every).cast("bigint")
    missing = F.size(F.filter(every, lambda f: is_missing(f["value"]))).cast("bigint")
    n = F.size(items).cast("bigint")
    return {
        "n_items": n,
        "total_fields": total,
        "populated": total - missing,
        "missing": missing,
        "avg_fields_per_item": F.coalesce(text.ratio(total, n), F.lit(0.0)),
    }


def first_value(items: Column, name: str) -> Column:
    """A field of the first item."""
    return jsontext.field_value(F.get(items, F.lit(0)), name)


def completeness(fields: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Items, fields, populated, missing and average fields by `keys`.

    Aggregated first by item and then by key: both steps combine map-side, so a key that owns a
    third of the rows is spread over all tasks by its items, without a distinct count.
    """
    per_item = fields.groupBy(*keys, *item).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_missing(F.col("value"))).alias("_m")
    )
    return per_item.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("_n").alias("total_fields"),
        (F.sum("_n") - F.sum("_m")).alias("populated"),
        F.sum("_m").alias("missing"),
        (F.sum("_n") / F.count(F.lit(1))).alias("avg_fields_per_item"),
    )


def field_coverage(fields: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Share of a key's items that carry each field, and that carry it filled.

    A field occurs at most once per item, so rows count items. The input is read once: rows meet by item, and an
    item adds a row of its own, without a field, to the counts.
    """
    filled = F.struct(F.col("field"), (~is_missing(F.col("value"))).alias("filled"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(False).alias("filled")))
    per_item = fields.where(F.col("field").isNotNull()).groupBy(*keys, *item).agg(F.collect_list(filled).alias("_f"))
    counted = (
        per_item.select(*keys, F.inline(F.concat(own, "_f")))
        .groupBy(*keys, "field")
        .agg(F.count(F.lit(1)).alias("with_field"), F.count_if("filled").alias("with_value"))
    )
    items = F.max(F.when(F.col("field").isNull(), F.col("with_field"))).over(Window.partitionBy(*keys))
    carried = counted.withColumn("items", items).where(F.col("field").isNotNull())
    return carried.withColumns(
        {
            "field_share": text.ratio(F.col("with_field"), F.col("items")),
            "value_share": text.ratio(F.col("with_value"), F.col("items")),
        }
    )


def gaps(fields: DataFrame, keys: list[str], item: list[str], required: list[str]) -> DataFrame:
    """By key: how many items lack a filled value for each required field."""
    per_item = fields.groupBy(*keys, *item).agg(
        *[
            F.max((F.col("field") == r) & ~is_missing(F.col("value"))).alias(f"_has_{r}")
            for r in required
        ]
    )
    complete = F.lit(True)
    for r in required:
        complete = complete & F.col(f"_has_{r}")
    return per_item.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        *[F.count_if(~F.col(f"_has_{r}")).alias(f"without_{r}") for r in required],
        F.count_if(complete).alias("comparable_items"),
    )
