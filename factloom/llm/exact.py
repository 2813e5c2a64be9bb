"""Exact dedup: equal rows meet at their mapper, then by salted digest, then by digest; contents are compared each time.

Edge cases: a null text counts as empty, and empty texts equal each other. Of rows that also share the
largest id, all bear the id that stays, and `kept` is true for each of them. A null id is smaller than
any other. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import salt, written


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize=lambda text: text,
    digest=sha256_text,
) -> DataFrame:
    """One row per document: id, `digest`, `keep_id`, `group_size`, `kept`.

    Whole texts move twice: once by (salt, digest) after each mapper has merged its own equal rows,
    and once more as one winner per salt. A group of any size thus reaches its last merge as no more
    than one row per salt. Both merges group by the text beside its digest, so two texts with one digest
    stay apart. Documents learn their group by (digest, salt) alone, and by the text as well only where one
    digest has several texts.
    """
    spark = docs.sparkSession
    text = F.coalesce(normalize(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", "_text", digest(F.col("_text")).alias("_digest"), salt(spark, "_id").alias("_salt")
    )
    # The aggregates hold numbers only, so equal rows of one mapper meet in its hash table.
    salted = rows.groupBy("_salt", "_digest", "_text").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    # Texts of a digest: nearly always one, whose text then need not be compared again.
    texts = written(
        merged.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact-digests",
    )
    found = rows.select("_id", "_digest").join(texts.where("_texts = 1"), "_digest")
    found = found.select("_id", "_digest", "keep_id", "group_size")
    shared = texts.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        several = merged.join(shared, "_digest", "left_semi")
        collided = rows.join(shared, "_digest", "left_semi").join(several, ["_digest", "_text"])
        found = found.unionByName(collided.select("_id", "_digest", "keep_id", "group_size"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_digest").alias("digest"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def kept_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_text
) -> DataFrame:
    """One whole row of each group of equal texts: the largest by id, then by the other columns.

    As above, texts move twice; the rest of the row moves with them, so every type must have an order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.struct(docs[id_col].alias("_id"), *(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col))
    rows = docs.select(
        whole.alias("_row"),
        docs[text_col].isNull().alias("_null"),
        text.alias("_text"),
        salt(docs.sparkSession, docs[id_col]).alias("_salt"),
    )
    winner = F.max(F.struct("_row", "_null")).alias("_top")
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    salted = rows.groupBy("_salt", "_digest", "_text").agg(winner).select("_digest", "_text", "_top.*")
    merged = salted.groupBy("_digest", "_text").agg(winner)
    own = F.when(~F.col("_top._null"), F.col("_text"))
    return merged.select(
        *(own.alias(c) if c == text_col else F.col(f"_top._row.c{i}").alias(c) for i, c in enumerate(docs.columns))
    )
