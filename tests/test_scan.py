"""Pages are read in portions: the same results, with the Python objects of one portion at a time."""

from __future__ import annotations

import tracemalloc
from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.operators import scan

ENTRY = '<li class="e"><a href="/{0}">Part {0}</a> <b>$7</b></li>'
LIST = "<html><body><ul>" + "".join(ENTRY.format(i) for i in range(60)) + "</ul></body></html>"


def test_portions_keep_every_page_in_order():
    third = "x" * (scan.PORTION // 3)
    pages = ["a", None, "", "y" * (2 * scan.PORTION), third, third, third, third, "b"]
    batch = pa.array(["left out", *pages], pa.string()).slice(1)
    got = list(scan.portions(batch))
    assert [page for portion in got for page in portion] == [page or "" for page in pages]
    assert [len(portion) for portion in got] == [3, 1, 3, 2]
    assert [list(p) for p in scan.portions(pa.array([], pa.string()))] == [[]]


def test_a_batch_takes_no_more_than_a_portion():
    read = partial(scan._scanned_columns, True)

    def peak(n: int) -> float:
        batch = pa.array([LIST] * n, pa.string())
        tracemalloc.start()
        rows = sum(len(part) for part in scan.read_in_portions(read, [batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most

    one = scan.PORTION // len(LIST)
    assert peak(6 * one) < 1.5 * peak(one)


def test_a_task_of_many_portions(spark):
    n = 3 * scan.PORTION // len(LIST)
    pages = spark.range(n, numPartitions=1).select("id", F.concat(F.lit(LIST), F.col("id").cast("string")).alias("html"))
    found = pages.select("id", scan.scanned(F.when(F.col("id") % 10 != 3, F.col("html")), True).alias("p"))
    rows = found.select("id", F.size("p.blocks.items").alias("n"), F.length("p.clean_html").alias("chars")).collect()
    assert len(rows) == n
    assert all((r.n, r.chars > 0) == ((0, False) if r.id % 10 == 3 else (60, True)) for r in rows)
