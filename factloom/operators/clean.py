"""Cleaning: noise out, body kept, sizes and counts taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import text
from factloom.operators.admit import SHORT_CLEAN, admit
from factloom.operators.scan import scanned


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read by value.

    Catalyst pushes a filter on a projected column below the projection and so evaluates the column
    twice; it does not push one below a generator. A one-row `inline` therefore keeps the regular
    expressions of the cleaning to one evaluation per page.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))


def clean_pages(pages: DataFrame, cfg: EngineConfig = EngineConfig(), mined: bool = False) -> DataFrame:
    """Admit and clean. Quarantined pages keep their row, with null cleaning results.

    Adds: clean_html, title, json_ld (well-formed texts), original_chars, clean_chars, original_size_kb,
    cleaned_size_kb, reduction_pct, estimated_tokens, removed_tags, removed_comments,
    base64_images_removed; `reason` also covers pages with too little left. With `mined`, also `blocks`, what the
    page repeats, from the same pass.
    """
    admitted = admit(pages, cfg)
    known = F.col("reason").isNull()
    scan = computed_once(admitted, {"_page": scanned(F.when(known, F.col("html")), mined)})
    page = F.when(known, F.col("_page"))
    short = F.length(page["clean_html"]) < cfg.min_clean_chars
    counts = ("removed_tags", "removed_comments", "base64_images_removed")
    found = {
        "clean_html": F.when(~short, page["clean_html"]),
        "title": page["title"],
        "json_ld": F.filter(page["json_ld"], lambda t: F.try_parse_json(t).isNotNull()),
        **{c: page[c] for c in counts},
    }
    if mined:
        found["blocks"] = F.when(~short, page["blocks"])
    cleaned = scan.withColumns({**found, "reason": F.coalesce(F.col("reason"), F.when(short, F.lit(SHORT_CLEAN)))})
    return (
        cleaned.drop("_page")
        .withColumns(
            {
                "original_chars": F.length("html").cast("bigint"),
                "clean_chars": F.length("clean_html").cast("bigint"),
                "original_size_kb": text.kilobytes(F.col("html")),
                "cleaned_size_kb": text.kilobytes(F.col("clean_html")),
                "estimated_tokens": text.tokens(F.col("clean_html"), cfg.chars_per_token),
            }
        )
        .withColumn("reduction_pct", reduction_pct(F.col("original_chars"), F.col("clean_chars")))
    )


def reduction_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before * F.lit(100.0)).otherwise(F.lit(0.0))


def cleaning_totals(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Corpus totals of the cleaning, by any keys of the page (host, language, none).

    Counts and characters are summed as integers and combined map-side, so a host with a third of
    all pages costs one small partial row per task.
    """
    admitted = cleaned.where(F.col("reason").isNull())
    totals = admitted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("removed_tags").alias("removed_tags"),
        F.sum("removed_comments").alias("removed_comments"),
        F.sum("base64_images_removed").alias("images_removed"),
        F.sum("original_chars").alias("chars_before"),
        F.sum("clean_chars").alias("chars_after"),
        F.sum("estimated_tokens").alias("estimated_tokens"),
    )
    return totals.withColumns(
        {
            "kb_before": F.col("chars_before") / F.lit(1024.0),
            "kb_after": F.col("chars_after") / F.lit(1024.0),
            "reduction_pct": reduction_pct(F.col("chars_before"), F.col("chars_after")),
            "avg_tokens": F.col("estimated_tokens") / F.col("pages"),
        }
    )
