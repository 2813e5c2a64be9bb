"""Announced pages, late ledger rows, and what both cost as they grow."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from factloom.operators.ledger import price_usage
from factloom.sources import arrivals as A
from factloom.sources.prices import price_list
from factloom.streaming.spend_stream import read_spend, start_spend_stream, windowed_spend


def put(folder, names):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
            out.write(f"<p>{name} é</p>")


def run(spark, folder, out):
    stream = A.stream_announced_pages(spark, folder).select("page_id", "path", "original_file", "size_bytes", "html")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_c").trigger(availableNow=True).start(f"{out}/t")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/t").collect()


def test_announced_pages_are_taken_up_once(spark, tmp_path):
    folder, out = str(tmp_path / "queue"), str(tmp_path / "out")
    put(folder, ["a.html", "b.HTM", "c.txt", "d.html"])
    A.announce(folder, ["a.html", "c.txt", "gone.html"])
    assert sorted(r.original_file for r in run(spark, folder, out)) == ["a.html"]
    A.announce(folder, ["b.HTM"])
    A.announce(folder, [])
    rows = {r.original_file: r for r in run(spark, folder, out)}
    assert set(rows) == {"a.html", "b.HTM"} and rows["b.HTM"].html == "<p>b.HTM é</p>" and rows["b.HTM"].size_bytes == 15
    assert A.manifest_size(folder) == 3
    assert len(run(spark, folder, out)) == 2
    put(folder, [f"{i}.html" for i in range(5)])
    for i in range(5):
        A.announce(folder, [f"{i}.html"])
    assert len(run(spark, folder, out)) == 7 and len(run(spark, folder, out)) == 7
    assert len(run(spark, folder, str(tmp_path / "again"))) == 7


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_the_end_of_the_manifest_is_found(tmp_path, n):
    folder = str(tmp_path)
    for i in range(n):
        A.announce(folder, [f"{i}"], i)
    files, root = A.file_system(folder)
    for start in {0, n // 2, n}:
        assert A._first_free(files, root, start) == n


def test_a_trigger_costs_what_is_new(spark, tmp_path, monkeypatch):
    """10,000 files in 20 triggers: looks at the manifest do not grow, and no folder is listed."""
    folder = str(tmp_path)
    looks = []
    plain = A._exists
    monkeypatch.setattr(A, "_exists", lambda files, path: looks.append(path) or plain(files, path))
    reader, costs = A.AnnouncedReader(folder), []
    offset = reader.initialOffset()
    for trigger in range(20):
        for chunk in range(5):
            A.announce(folder, [f"{trigger}-{chunk}-{i}.html" for i in range(100)], trigger * 5 + chunk)
        looks.clear()
        end = reader.latestOffset()
        costs.append(len(looks))
        assert len(reader.partitions(offset, end)) == 5
        offset = end
    assert offset == {"chunks": 100} and max(costs[1:]) <= max(costs[:2]) <= 10


USAGE = "ts timestamp, task string, model string, in_tok bigint, out_tok bigint"


def usage(day, hour, tokens):
    return (datetime.datetime(2025, 1, day, hour), "Extraction", "gpt-4o", tokens, 10)


def test_late_ledger_rows_correct_their_windows(spark, tmp_path):
    """A file two days late, one with rows of all days, one without times: the stream says what the batch says."""
    batches = [
        [usage(5, 1, 100), usage(5, 2, 200)],
        [usage(3, 1, 1000), usage(5, 3, 7)],
        [usage(d, 4, d) for d in range(1, 8)],
        [(None, "Extraction", "gpt-4o", 5, 5)],
    ]
    source, root, whole = str(tmp_path / "in"), str(tmp_path / "out"), []
    for i, rows in enumerate(batches):
        whole += rows
        spark.createDataFrame(rows, USAGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(source)
        start_spend_stream(price_usage(stream, price_list(spark)), root, "1 day", ("model",), available_now=True).awaitTermination()
        batch = price_usage(spark.createDataFrame([r for r in whole if r[0]], USAGE), price_list(spark))
        expected = windowed_spend(batch, "1 day", "1 hour", "model")
        got = read_spend(spark, root).select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())), i
    # The second batch read its own two days again and no others.
    versions = spark.read.parquet(f"{root}/spend").where("version = 1").select(F.dayofmonth("window_start")).distinct().collect()
    assert sorted(r[0] for r in versions) == [3, 5]
    assert spark.read.parquet(f"{root}/ledger").count() == len(whole)
