"""Item extraction: every item of a list page, or the one item of a single page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext
from factloom.operators.profile import read_blocks
from factloom.operators.structured import read_structured
from factloom.schemas import ITEMS


def extract_items(profiled: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add `items` (ordered fields per item), `shape` (`items` or `item`) and `more_blocks`: blocks left out were more."""
    found = read_blocks(read_structured(profiled))
    main = F.filter(
        F.array(
            jsontext.text_pair("title", F.coalesce(F.col("blocks.heading"), F.col("title"))),
            jsontext.text_pair("link", F.col("url")),
            jsontext.text_pair("price", F.col("blocks.price")),
        ),
        lambda f: f["value"].isNotNull(),
    )
    single = F.col("hypothesis.item_count") == "single"
    # A page read as single, or one without blocks, is its own item if it has a heading or title.
    itself = F.when(F.exists(main, lambda f: f["field"] == "title"), F.array(main)).otherwise(
        F.array().cast(ITEMS)
    )
    items = (
        F.when(F.size("structured.items") > 0, F.col("structured.items"))
        .when(~single & (F.size("blocks.items") > 0), F.col("blocks.items"))
        .otherwise(itself)
    )
    by_blocks = ~single & (F.coalesce(F.size("structured.items"), F.lit(0)) <= 0)
    known = F.col("reason").isNull()
    return (
        found.withColumn("items", F.when(known, items.cast(ITEMS)))
        .withColumn(
            "shape",
            F.when(known, F.when(single & (F.size("items") == 1), F.lit("item")).otherwise(F.lit("items"))),
        )
        .withColumn("more_blocks", F.coalesce(known & by_blocks & F.col("blocks.more_blocks"), F.lit(False)))
        .drop("blocks", "structured")
    )


def long_fields(df: DataFrame, *keys: str) -> DataFrame:
    """Items -> the long field table: keys, pos, field_pos, field, value, value_type."""
    return df.select(*keys, F.posexplode("items").alias("pos", "_fields")).select(
        *keys,
        "pos",
        F.posexplode("_fields").alias("field_pos", "_f"),
    ).select(*keys, "pos", "field_pos", "_f.field", "_f.value", "_f.value_type")
