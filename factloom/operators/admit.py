"""Which pages enter the flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig

TOO_SMALL = "too_small"
NO_CONTENT = "no_content"
SHORT_RAW = "short_raw"
SHORT_CLEAN = "short_clean"


def admission_reason(html: Column, size_bytes: Column, cfg: EngineConfig) -> Column:
    """Null for an admitted page, else why it is quarantined."""
    return (
        F.when(html.isNull(), F.lit(NO_CONTENT))
        .when(size_bytes < cfg.min_file_bytes, F.lit(TOO_SMALL))
        .when(F.length(html) < cfg.min_raw_chars, F.lit(SHORT_RAW))
    )


def admit(pages: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add `size_bytes` (unless the source knows it) and `reason`. No page is dropped."""
    if "size_bytes" not in pages.columns:
        pages = pages.withColumn("size_bytes", F.octet_length("html").cast("bigint"))
    return pages.withColumn("reason", admission_reason(F.col("html"), F.col("size_bytes"), cfg))


def unprocessed(pages: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Pages whose key is not in the manifest of pages already taken up.

    Only the key column of the manifest is read, and repeated keys are merged before they meet. Spark
    broadcasts it while it is below `spark.sql.autoBroadcastJoinThreshold`; beyond that the join uses
    the partitioning that the merging made.
    """
    return pages.join(manifest.select(key).distinct(), key, "left_anti")
