"""What a page states about itself in JSON-LD, read once for the stages that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsonld
from factloom.schemas import ITEMS


def read_structured(cleaned: DataFrame) -> DataFrame:
    """Add `structured`: items (fields per item), is_search, is_list, breadcrumb.

    Null for pages without JSON-LD, which skip all of it.
    """
    if "structured" in cleaned.columns:
        return cleaned
    nodes = F.col("_nodes")
    found = F.struct(
        F.transform(jsonld.items(nodes), jsonld.item_fields).cast(ITEMS).alias("items"),
        jsonld.has_type(nodes, "SearchResultsPage").alias("is_search"),
        jsonld.has_type(nodes, "ItemList").alias("is_list"),
        jsonld.breadcrumb(nodes).alias("breadcrumb"),
    )
    stated = F.size("json_ld") > 0
    return (
        cleaned.withColumn("_nodes", F.when(stated, jsonld.nodes(F.col("json_ld"))))
        .withColumn("structured", F.when(stated, found))
        .drop("_nodes")
    )
