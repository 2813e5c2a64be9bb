"""Pages made of parts are dealt to all tasks, however few row groups the table has."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.queries.stored import failing_pages


def test_one_small_file_makes_many_tasks(spark, tmp_path):
    rows = [(i, f"part {i}", i % 7) for i in range(300)] + [(None, "nameless", 1), (None, None, 2), (7, "part 7", 0)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    pages = failing_pages(spark, str(tmp_path))
    dealt = pages.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 100
    assert sum(r["count"] for r in dealt) == len(rows)
