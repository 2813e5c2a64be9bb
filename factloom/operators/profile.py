"""Page profile: what kind of page this is, from what source, with how many items expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import html as H
from factloom.functions import text
from factloom.operators.clean import computed_once
from factloom.operators.scan import blocks_of
from factloom.operators.structured import read_structured

PRICED = r"[$€£]\s?[0-9]"
AUCTION = r"auction|\bbids?\b"
SEARCH_URL = r"[?&](?:q|s|query|search)="
PAGED_URL = r"[?&]page=[0-9]"
FIRST_SEGMENT = r"^https?://[^/?#]+/([^/?#]+)"


def page_class(page_type: Column, item_count: Column) -> Column:
    """auction, single, list or unknown, from the texts of a profile."""
    kind = F.lower(F.coalesce(page_type, F.lit("")))
    multiple = says_multiple(item_count)
    count = stated_count(item_count)
    return (
        F.when(kind.contains("auction") | kind.contains("bid"), F.lit("auction"))
        .when(
            (count == 1) | kind.contains("single") | (kind.contains("product") & ~multiple),
            F.lit("single"),
        )
        .when(
            multiple
            | (count > 1)
            | kind.contains("list")
            | kind.contains("catalog")
            | kind.contains("search")
            | kind.contains("results"),
            F.lit("list"),
        )
        .otherwise(F.lit("unknown"))
    )


def says_multiple(item_count: Column) -> Column:
    said = F.lower(F.coalesce(item_count, F.lit("")))
    return said.contains("multiple") | said.contains("many")


def stated_count(item_count: Column) -> Column:
    """First integer of an item count text; 0 for none, and for texts that say multiple or many."""
    return F.when(says_multiple(item_count), F.lit(0)).otherwise(text.first_integer(item_count))


def read_blocks(cleaned: DataFrame) -> DataFrame:
    """Add `blocks` and `title`, unless the cleaning left them."""
    if "title" not in cleaned.columns:
        cleaned = cleaned.withColumn("title", H.title(F.col("html")))
    if "blocks" in cleaned.columns:
        return cleaned
    found = computed_once(cleaned, {"_blocks": blocks_of(F.col("clean_html"))})
    return found.withColumn("blocks", F.when(F.col("clean_html").isNotNull(), F.col("_blocks"))).drop("_blocks")


def profile_pages(cleaned: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add the `hypothesis` struct. Looks at the address, the title, JSON-LD and what the whole page repeats."""
    features = read_blocks(read_structured(cleaned)).withColumns(
        {
            "_url": F.coalesce(F.col("url"), H.declared_url(F.col("html"))),
            "_priced": F.col("clean_html").rlike(PRICED),
            "_ld_count": F.coalesce(F.size("structured.items"), F.lit(0)).cast("bigint"),
        }
    )
    ld_count = F.col("_ld_count")
    li, h1, expected = F.col("blocks.list_entries"), F.col("blocks.main_headings"), F.col("blocks.expected")
    # All blocks of the runs that hold the items, also those without a usable link.
    entries_seen = F.when(expected >= 2, expected).otherwise(F.greatest(li, expected))
    seen = F.lower(F.concat_ws(" ", F.col("_url"), F.col("title")))
    page_type = (
        F.when(F.col("structured.is_search"), F.lit("search results"))
        .when(F.col("structured.is_list") | (ld_count > 1), F.lit("category listing"))
        .when(ld_count == 1, F.lit("single product"))
        .when(seen.rlike(AUCTION), F.lit("auction"))
        .when(F.lower("_url").rlike(SEARCH_URL), F.lit("search results"))
        .when((entries_seen >= 2) | F.lower("_url").rlike(PAGED_URL), F.lit("category listing"))
        .when((li == 1) | (h1 == 1), F.lit("single product"))
        .otherwise(F.lit("unknown"))
    )
    entries = F.when(ld_count > 0, ld_count).otherwise(entries_seen)
    ld_keys = F.transform(F.get(F.col("structured.items"), F.lit(0)), lambda f: f["field"])
    rule_fields = F.when(F.col("_priced"), F.array(*map(F.lit, ("title", "link", "price")))).otherwise(
        F.array(*map(F.lit, ("title", "link")))
    )
    # Fields that the blocks turn out to have, beyond those of every list.
    named = F.flatten(F.transform("blocks.items", lambda i: F.transform(i, lambda f: f["field"])))
    rule_fields = F.when(expected >= 2, F.array_union(rule_fields, named)).otherwise(rule_fields)
    hypothesis = F.struct(
        page_type.alias("page_type"),
        F.coalesce(H.host(F.col("_url")), F.lit("Unknown")).alias("source"),
        F.coalesce(
            F.col("structured.breadcrumb"), text.filled(F.regexp_extract("_url", FIRST_SEGMENT, 1)), F.lit("")
        ).alias("category"),
        F.when(entries >= 2, F.format_string("multiple (estimate %d)", entries))
        .otherwise(F.lit("single"))
        .alias("item_count"),
        F.when(ld_count > 0, ld_keys).otherwise(rule_fields).alias("expected_fields"),
        F.when(entries >= 3, F.lit("high"))
        .when(entries >= 1, F.lit("medium"))
        .otherwise(F.lit("low"))
        .alias("confidence"),
        F.format_string(
            "%d list entries, %d main headings, %d structured items", li, h1, ld_count
        ).alias("notes"),
    )
    known = F.col("reason").isNull()
    return features.withColumn("hypothesis", F.when(known, hypothesis)).drop("_url", "_priced", "_ld_count")
