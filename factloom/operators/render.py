"""Items as Markdown: every item, every field, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext, text

# Fields that may head an item, best first.
TITLE_FIELDS = ("title", "product_name", "name", "item_title", "product_title")


def label(field: Column) -> Column:
    """`shipping_cost` -> `Shipping Cost`."""
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def title_field(fields: Column) -> Column:
    """Name of the field that heads the item; null where no such field is filled."""
    filled = F.transform(
        F.filter(fields, lambda f: F.coalesce(f["value"] != "", F.lit(False))), lambda f: f["field"]
    )
    known = F.array(*[F.lit(f) for f in TITLE_FIELDS])
    return F.get(F.filter(known, lambda t: F.array_contains(filled, t)), F.lit(0))


def _value(fields: Column, name: Column) -> Column:
    return F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))["value"]


def field_lines(fields: Column, heading: Column) -> Column:
    shown = F.filter(fields, lambda f: F.coalesce(f["field"] != heading, F.lit(True)))
    return F.transform(
        shown,
        lambda f: F.concat(F.lit("- **"), label(f["field"]), F.lit(":** "), F.coalesce(f["value"], F.lit("N/A"))),
    )


def item_block(fields: Column, number: Column) -> Column:
    heading = title_field(fields)
    title = F.coalesce(_value(fields, heading), F.lit("Untitled"))
    first = F.concat(F.lit("### Item "), number.cast("string"), F.lit(": "), title)
    return F.array_join(F.concat(F.array(first), field_lines(fields, heading)), "\n")


def markdown(items: Column, shape: Column) -> Column:
    """The rendered items; empty where there are none."""
    blocks = F.transform(
        items, lambda it, i: item_block(F.coalesce(it, jsontext.no_fields()), i + 1)
    )
    listed = F.concat(F.lit("## All Items Found\n\n"), F.array_join(blocks, "\n\n"))
    only = F.get(items, F.lit(0))
    single = F.concat(
        F.lit("## Product Details\n\n### "),
        F.coalesce(_value(only, title_field(only)), F.lit("Untitled")),
        F.lit("\n"),
        F.array_join(field_lines(only, title_field(only)), "\n"),
    )
    return F.when(F.size(items) == 0, F.lit("")).when(shape == "item", single).otherwise(listed)


def render_items(extracted: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add `formatted_markdown`. An item's text is bounded by its page, so it is built in its row."""
    return extracted.withColumn(
        "formatted_markdown", F.when(F.col("items").isNotNull(), markdown(F.col("items"), F.col("shape")))
    )


def validator_summary(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """What a validator sees of a page: a preview of the rendering and the shape of the data."""
    has_items = F.col("shape") == "items"
    return df.select(
        "page_id",
        text.preview(F.col("formatted_markdown"), cfg.preview_chars).alias("formatted_data_preview"),
        F.when(has_items, F.size("items")).otherwise(F.lit(1)).cast("bigint").alias("items_count"),
        has_items.alias("has_items"),
        F.array(F.col("shape")).alias("top_level_keys"),
    )
