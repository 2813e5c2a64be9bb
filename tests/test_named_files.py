"""Files by name: commit lists, clashing names, failed jobs; and the one-row comparison plan."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.queries import QUERIES
from factloom.sinks import files as N


def named(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def read(spark, path):
    return {r.name: r.text for r in N.read_named_files(spark, path).collect()}


def test_files_are_written_whole_and_read_by_their_lists(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a.md", "ä\n"), ("b/c.json", "{}"), ("empty.txt", None), ("odd name [1].md", "x")]
    N.write_named_files(named(spark, rows).repartition(3), path)
    assert read(spark, path) == {"a.md": "ä\n", "b/c.json": "{}", "empty.txt": "", "odd name [1].md": "x"}
    assert open(f"{path}/a.md", encoding="utf-8").read() == "ä\n"
    N.write_named_files(named(spark, [("d.md", "later")]), path)
    assert set(read(spark, path)) == {"a.md", "b/c.json", "empty.txt", "odd name [1].md", "d.md"}
    N.write_named_files(named(spark, [("a.md", "new")]), path, "overwrite")
    assert read(spark, path) == {"a.md": "new"}


def test_a_failed_job_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    N.write_named_files(named(spark, [("a.md", "one")]), path)
    rows = spark.range(0, 4, 1, 4).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("text"),
    )
    with pytest.raises(Exception, match="broken"):
        N.write_named_files(rows, path)
    assert read(spark, path) == {"a.md": "one"}
    # A file that does not hold what its list says is not taken for it.
    with open(f"{path}/a.md", "w") as out:
        out.write("tampered")
    assert read(spark, path) == {}
    assert N.read_named_files(spark, str(tmp_path)).count() == 0


def test_files_are_read_by_tasks_and_not_listed_by_the_driver(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"{i % 3}/f {i}:%41.md", f"text {i}\n" * (i % 5)) for i in range(200)]
    N.write_named_files(named(spark, rows).coalesce(1), path)
    files = N.read_named_files(spark, path)
    known = files.inputFiles()
    assert known and all(f"/{N.LISTS}/" in f or f"/{N.COMMITS}/" in f for f in known)
    dealt = files.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 100
    assert sorted(map(tuple, files.collect())) == sorted(rows)


def test_a_file_counts_by_what_it_holds_now(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    N.write_named_files(named(spark, [("a.md", "one"), ("b.md", "two"), ("c.md", "ä" * 9), ("d.md", "four")]), path)
    N.write_named_files(named(spark, [("a.md", "other"), ("b.md", "two")]), path)
    os.remove(f"{path}/d.md")
    found = sorted(map(tuple, N.read_named_files(spark, path).collect()))
    assert found == [("a.md", "other"), ("b.md", "two"), ("c.md", "ä" * 9)]
    # A task holds a portion of the contents at a time.
    monkeypatch.setattr(N, "_HELD", 6)
    portions = N._contents(path, iter([N.committed_files(spark, path).orderBy("name").toArrow().to_batches()[0]]))
    assert [[(r["name"], r["content"].decode()) for r in p.to_pylist()] for p in portions] == [found[:2], found[2:]]


@pytest.mark.parametrize("name", ["../x", "/x", "a//b", ".hidden", "_lists/x", "", None])
def test_names_that_point_elsewhere_are_refused(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a file name"):
        N.write_named_files(named(spark, [(name, "x")]), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "x")


def test_clashing_names_are_numbered(spark):
    rows = spark.range(300).select(
        F.col("id").alias("page_id"), F.when(F.col("id") < 200, F.lit("same")).otherwise(F.lit("other")).alias("report_name")
    )
    found = N.with_numbers(rows, "report_name", "page_id").collect()
    for name, n in (("same", 200), ("other", 100)):
        assert sorted(r.number for r in found if r.report_name == name) == list(range(1, n + 1))
    again = N.with_numbers(rows.repartition(7), "report_name", "page_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_reports_say_their_own_names(spark):
    row = ("r_FAILED", "r_DEBUG", "*Partial data: `r_FAILED.json`*  \n*Debug info: `r_DEBUG.json`*", "{}", "{}", None)
    rows = spark.createDataFrame(
        [(i, *row) for i in (1, 2)],
        "page_id long, report_name string, debug_name string, report_markdown string, report_json string, debug_json string, reason string",
    )
    texts = {r.name: r.text for r in N.report_files(rows).collect()}
    assert set(texts) == {f"{n}{k}{e}" for k in ("", "-2") for n, e in (("r_FAILED", ".md"), ("r_FAILED", ".json"), ("r_DEBUG", ".json"))}
    assert texts["r_FAILED-2.md"] == "*Partial data: `r_FAILED-2.json`*  \n*Debug info: `r_DEBUG-2.json`*"


@pytest.mark.parametrize("name", ["run_metrics", "run_winners", "run_recommendation", "item_field_diff", "field_name_union", "comparison_summaries"])
def test_comparisons_read_pages_once_and_shuffle_nothing(spark, tmp_path, name):
    path = str(tmp_path)
    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("http://x.y/z").alias("url"), F.lit("<p>").alias("html"))
    rows.write.parquet(f"{path}/pages.parquet")
    plan = QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1
    assert not any(word in plan for word in ("Exchange", "NestedLoop", "Join"))


def test_commit_mark(spark, tmp_path):
    path = str(tmp_path / "out")
    N.write_named_files(spark.range(10).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("xyz").alias("text")), path)
    (mark,) = os.listdir(f"{path}/{N.COMMITS}")
    told = json.loads(open(f"{path}/{N.COMMITS}/{mark}").read())
    assert (told["files"], told["bytes"]) == (10, 30)
