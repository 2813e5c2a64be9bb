"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir), works on all rows the one before kept, and all but the last return the columns of
documents. Stages before the last only drop rows; what they keep is unchanged. Rows with null or repeated ids
stay or go with their group: of equal texts the row with the largest id stays, of near duplicates that with the smallest.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact, nearcopies, queries, shared, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The share of tokens that mixing keeps.
BUDGET = 0.9


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS, "text").where("score < 0.5").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.kept_rows(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a five-word Jaccard similarity of at least 0.8."""
    return nearcopies.kept_rows(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and form margins are raked."""
    return queries.mixed(docs, BUDGET).where("mix.kept").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces, and whether these read back as the text."""
    rows = queries.in_pieces(docs, ["doc_id", "lang", "source", "text"])
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return rows.select("doc_id", "lang", "source", "ids", same)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("pieces", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
