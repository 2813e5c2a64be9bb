"""Report names: time, source, product, kind of page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext, text
from factloom.operators import dominance as D
from factloom.operators.profile import page_class
from factloom.operators.validate import INCOMPLETE, SUCCESS

UNKNOWN = "Unknown"
ARCHIVE = "archive"
ERRORS = "errors"


def source_part(source: Column) -> Column:
    kept = text.first_filled(text.alphanumeric(F.coalesce(source, F.lit(UNKNOWN))), F.lit(UNKNOWN))
    return text.capitalized(text.prefix(kept, 20))


def category_part(category: Column) -> Column:
    return text.first_filled(text.hyphenated(F.coalesce(category, F.lit(""))), F.lit(UNKNOWN))


def product_part(
    page_kind: Column,
    category: Column,
    first_title: Column,
    n_items: Column,
    model: Column,
    brand: Column,
    attribute: Column,
) -> Column:
    """What the report is about; falls back to the category, then to `Unknown`."""
    category_word = F.coalesce(F.get(text.words(F.coalesce(category, F.lit(""))), F.lit(0)), F.lit(""))
    from_title = text.hyphenated(text.first_words(first_title, 3))
    from_items = (
        F.when(model.isNotNull(), text.compacted(model))
        .when(brand.isNotNull() & attribute.isNotNull(), text.compacted(F.concat(brand, attribute)))
        .when(attribute.isNotNull(), text.compacted(F.concat(attribute, category_word)))
    )
    listed = page_kind.isin("list", "auction") & (n_items >= 2)
    product = F.when(page_kind == "single", from_title).when(listed, from_items)
    usable = F.when(product != UNKNOWN, text.filled(product))
    return F.coalesce(usable, category_part(category))


def base_name(
    stamp: Column, source: Column, product: Column, page_kind: Column, max_chars: int = 100
) -> Column:
    """stamp-source-product-kind; an overlong name loses the end of its product, or all of it."""
    dash = F.lit("-")
    whole = F.concat(stamp, dash, source, dash, product, dash, page_kind)
    room = F.lit(max_chars - 3 - 2) - F.length(stamp) - F.length(source) - F.length(page_kind)
    cut = F.concat(stamp, dash, source, dash, F.substring(product, F.lit(1), room), dash, page_kind)
    return (
        F.when(F.length(whole) <= max_chars, whole)
        .when(room > 0, cut)
        .otherwise(F.concat(stamp, dash, source, dash, page_kind))
    )


def status_suffix(status: Column) -> Column:
    return (
        F.when(status == SUCCESS, F.lit(""))
        .when(status == INCOMPLETE, F.lit("_INCOMPLETE"))
        .otherwise(F.lit("_FAILED"))
    )


def disposition(status: Column) -> Column:
    """Success and partial results are archived; everything else goes to errors."""
    kept = F.coalesce(status.isin(SUCCESS, INCOMPLETE), F.lit(False))
    return F.when(kept, F.lit(ARCHIVE)).otherwise(F.lit(ERRORS))


def name_reports(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add page_kind, base_name, report_name, debug_name, disposition. Needs hypothesis, items, shape, status and `processed_at`.

    The title of a single page is taken only from listed items; one that was extracted as `item` is
    named by its category.
    """
    hypothesis = F.col("hypothesis")
    first = F.get(F.col("items"), F.lit(0))
    title = F.when(
        F.col("shape") == "items",
        text.first_filled(*[jsontext.text_value(first, f) for f in ("title", "name", "product_name")]),
    )
    n_items = F.when(F.col("shape") == "items", F.size("items")).otherwise(F.lit(0))
    dominance = F.col("dominance")
    named = (
        D.page_dominance(df, cfg)
        .withColumn("page_kind", page_class(hypothesis["page_type"], hypothesis["item_count"]))
        .withColumns(
            {
                "_source": source_part(hypothesis["source"]),
                "_product": product_part(
                    F.col("page_kind"),
                    hypothesis["category"],
                    title,
                    n_items,
                    D.dominant(dominance, D.BRAND_MODEL),
                    D.dominant(dominance, D.BRAND),
                    D.first_attribute(dominance, cfg),
                ),
                "_stamp": text.minute_stamp(F.col("processed_at")),
            }
        )
    )
    name = base_name(
        F.col("_stamp"), F.col("_source"), F.col("_product"), F.col("page_kind"), cfg.max_name_chars
    )
    return (
        named.withColumn("base_name", name)
        .withColumns(
            {
                "report_name": F.concat(F.col("base_name"), status_suffix(F.col("status"))),
                "debug_name": F.concat(F.col("base_name"), F.lit("_DEBUG")),
                "disposition": disposition(F.col("status")),
            }
        )
        .drop("_source", "_product", "_stamp")
    )
