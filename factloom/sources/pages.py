"""Pages as files or tables, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.schemas import PAGE_FILE

FILE_GLOB = "*.[hH][tT][mM]*"
FILE_SUFFIX = r"(?i)\.html?$"


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def as_pages(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(FILE_SUFFIX)).select(
        F.xxhash64("path").alias("page_id"),
        "path",
        F.col("modificationTime").alias("arrived_at"),
        text.basename(F.col("path")).alias("original_file"),
        F.lit(None).cast("string").alias("url"),
        F.col("length").alias("size_bytes"),
        decoded(F.col("content")).alias("html"),
    )


def read_page_files(spark: SparkSession, directory: str) -> DataFrame:
    """HTML files of one directory. Names starting with a dot or an underscore stay hidden, and a
    file that is gone before it is read is passed over."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", FILE_GLOB)
        .option("ignoreMissingFiles", True)
        .load(directory)
    )
    return as_pages(files)


def stream_page_files(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """HTML files as they arrive; each path is taken up once per checkpoint."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(PAGE_FILE)
        .option("pathGlobFilter", FILE_GLOB)
        .option("maxFilesPerTrigger", max_files)
        # A page that arrives with an old time stamp is taken up like any other.
        .option("maxFileAge", "36500d")
        .option("ignoreMissingFiles", True)
        .load(directory)
    )
    return as_pages(files)


def from_table(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """A page table (page_id, url, html) in the layout of the flow.

    A table is read in as many tasks as it has splits. Where those are fewer than the cores, as with a few large row groups,
    the caller may name a number of `tasks` to deal the raw pages to, once and before anything is done to them.
    """
    if tasks:
        pages = pages.select("page_id", "url", "html").repartition(tasks)
    return pages.select(
        "page_id",
        F.col("url").alias("path"),
        F.coalesce(text.filled(text.basename(F.col("url"))), F.col("url")).alias("original_file"),
        "url",
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        "html",
    )
