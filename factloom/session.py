"""Session settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Set only where the caller's session left them alone.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small files are split for all cores by the scan itself.
    "spark.sql.files.openCostInBytes": "65536",
    "spark.ui.enabled": "false",
    # Call sites noted for every column take as long as building the plan itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The checksumming local file system refuses names with a colon; saved pages often have one.
    "spark.hadoop.fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
}


def local_session(app: str, cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, or None where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; in a local session that names none, below a temporary folder."""
    root = shared_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
