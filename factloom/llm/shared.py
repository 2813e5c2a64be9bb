"""What several operators share: written intermediate tables and salts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a local session that names no checkpoint folder keeps its tables.
OWN_FOLDER = "spark.factloom.shared.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the session's `OWN_FOLDER`.

    A local session without either gets a temporary folder; elsewhere no folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir or {OWN_FOLDER} to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set(OWN_FOLDER, root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: a lost executor costs no recomputation.

    Shuffle files of the plan that wrote it go when it ends.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of `written` tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salts(spark: SparkSession) -> int:
    """How many ways a hot key is split: as many as there are shuffle partitions."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(spark: SparkSession, *ids: Column | str) -> Column:
    """A number from the row's id: a rerun of a task gives its rows the same one."""
    return F.pmod(F.xxhash64(*ids), F.lit(salts(spark))).cast("int")
