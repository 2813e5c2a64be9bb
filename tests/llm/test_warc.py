from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc

PAGES = "page_id long, url string, html string, key string, first int"
ROWS = [
    (1, "http://a/1", "same"),
    (2, "http://a/2", "same"),
    (3, None, None),
    (4, "", ""),
    (5, "http://a/ü\r\nX: y%41", "é" * 100_000),
    (6, "http://a/6", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
    (2, "http://a/2", "same"),
    (None, "http://a/n", "same"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], PAGES)


def test_round_trip(spark):
    path = warc.archive(warc.page_records(pages(spark)), roll_bytes="300")
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["target_uri"], r["payload_bytes"], r["payload"]) for r in warc.read_archive(spark, path).collect()), key=str)
    top = {"same": 2, "": 4}
    expected = []
    for i, url, html in ROWS:
        first = top.get(html or "", i)
        data = (html or "").encode()
        name = f"urn:page:{'null' if i is None else i}"
        kind = ("response", None) if i == first else ("revisit", f"urn:page:{first}")
        payload = bytearray(data) if i == first else None
        expected.append((name, *kind, url or "", len(data), payload))
    assert got == sorted(expected, key=str)


def test_filters_and_payloads(spark):
    path = warc.archive(warc.page_records(pages(spark)))
    read = warc.read_archive(spark, path).where(F.col("record_type") == "revisit")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan
    assert read.count() == 3
    by_uri = warc.read_archive(spark, path, payload="false").where(F.col("target_uri").isin("http://a/6", "http://a/1"))
    assert sorted((r["target_uri"], r["payload"]) for r in by_uri.collect()) == [("http://a/1", None), ("http://a/6", None)]
    assert warc.read_archive(spark, path).where("payload_bytes > 100000").count() == 1


def test_short_payloads_stay_responses(spark):
    kinds = {r["record_type"] for r in warc.page_records(pages(spark), min_bytes=10).collect()}
    assert kinds == {"response"}


def test_files_of_lost_attempts_are_not_read(spark):
    path = warc.archive(warc.page_records(pages(spark)))
    folder = path.removeprefix("file://")
    stray = warc.record_bytes("response", "urn:page:99", "u", "2000-01-01T00:00:00Z", b"x", None)
    with open(f"{folder}/part-stray.warc.gz", "wb") as out:
        out.write(gzip.compress(stray))
    assert warc.read_archive(spark, path).count() == len(ROWS)
    lists = [f for f in os.listdir(folder) if f.startswith("_files-")]
    assert sum(len(json.load(open(f"{folder}/{f}"))) for f in lists) == len(os.listdir(folder)) - 1 - len(lists)


def test_a_record_that_is_cut_off_is_an_error(spark, tmp_path):
    data = gzip.compress(warc.record_bytes("response", "urn:page:1", "u", "2000-01-01T00:00:00Z", b"x" * 500, None))
    (tmp_path / "a.warc.gz").write_bytes(data * 2 + data[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archive(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.warc.gz").write_bytes(data * 3)
    assert warc.read_archive(spark, str(tmp_path)).count() == 3


def test_digests():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_empty(spark):
    path = warc.archive(warc.page_records(pages(spark, [])))
    assert warc.read_archive(spark, path).count() == 0
