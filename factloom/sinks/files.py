"""One file per row, under the name the row gives: a data source writer with its own commit list.

Tasks write their files themselves; a file appears whole under its name (it is written beside and moved), so a task that runs twice
leaves one copy. Each task then lists what it wrote, and a job counts once its commit mark is there: readers take the names of
committed lists, never a directory listing of a job that failed halfway. The driver sees one number pair per task, and no name: tasks
read the lists, and then the files that these name.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from factloom.sources.arrivals import file_system

FORMAT = "named_files"
LISTS, COMMITS = "_lists", "_commits"
_LIST = "name string, bytes long, sha256 string"
_WAYS = 64
#: Bytes of content that a reading task holds at a time.
_HELD = 8 << 20


@dataclass
class TaskFiles(WriterCommitMessage):
    """What one task wrote."""

    files: int
    bytes: int


class NamedFiles(DataSource):
    """Writer for rows (name, text). Names may hold folders; parts that point elsewhere are refused."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], uuid.uuid4().hex, overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, overwrite: bool):
        self.path, self.job, self.overwrite = path.rstrip("/"), job, overwrite

    def _put(self, files, name: str, content: bytes) -> None:
        files.create_dir(os.path.dirname(name), recursive=True)
        beside = os.path.join(os.path.dirname(name), f"_{uuid.uuid4().hex}")
        with files.open_output_stream(beside) as out:
            out.write(content)
        files.move(beside, name)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        files, root = file_system(self.path)
        listed, total = [], 0
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text")):
                parts = (name or "").split("/")
                if not all(parts) or any(p.startswith((".", "_")) for p in parts):
                    raise ValueError(f"not a file name: {name!r}")
                content = (text.as_py() or "").encode()
                self._put(files, f"{root}/{name}", content)
                listed.append({"name": name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
                total += len(content)
        if listed:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            lines = "".join(json.dumps(line) + "\n" for line in listed)
            self._put(files, f"{root}/{LISTS}/job={self.job}/part-{part:06}.json", lines.encode())
        return TaskFiles(len(listed), total)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        files, root = file_system(self.path)
        done = [m for m in messages if m is not None]
        mark = {"job": self.job, "tasks": len(done), "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for old in files.get_file_info(FileSelector(f"{root}/{COMMITS}", allow_not_found=True)):
                files.delete_file(old.path)
        self._put(files, f"{root}/{COMMITS}/{self.job}.json", json.dumps(mark).encode())

    def abort(self, messages: list[TaskFiles | None]) -> None:
        """Nothing counts without a commit mark; files of the same names were moved in whole."""


def write_named_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, text), one file each."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "text").write.format(FORMAT).mode(mode).option("path", path).save()


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files that committed jobs list."""
    from pyarrow.fs import FileType

    files, root = file_system(path.rstrip("/"))
    if any(files.get_file_info(f"{root}/{d}").type == FileType.NotFound for d in (LISTS, COMMITS)):
        return spark.createDataFrame([], _LIST)
    jobs = spark.read.schema("job string").json(f"{path}/{COMMITS}")
    lists = spark.read.schema(f"{_LIST}, job string").option("basePath", f"{path}/{LISTS}").json(f"{path}/{LISTS}")
    # Lists are short next to the files they name: by their bytes, adaptive execution would leave all files to a few tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lists.join(jobs, "job").select("name", "bytes", "sha256").repartition(tasks, "name", "bytes", "sha256").distinct()


def _contents(path: str, listed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, content) of the listed files (name, bytes, sha256) that hold what their list says."""
    files, root = file_system(path)
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])
    names, contents, held = [], [], 0
    for batch in listed:
        for name, length, digest in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "sha256"))):
            content = b""  # of empty files the list says all
            if length != 0:
                info = files.get_file_info(f"{root}/{name}")
                if not info.is_file:
                    continue
                with files.open_input_stream(info.path) as file:
                    content = file.read()
            if hashlib.sha256(content).hexdigest() != digest:
                continue
            names.append(name)
            contents.append(content)
            held += len(content)
            if held > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                names, contents, held = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)


def read_named_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all committed files, read back whole and held against their list.

    Tasks read the files of their share of the lists; no folder of them is listed, so the driver holds none of their names.
    """
    base = path.rstrip("/")
    found = committed_files(spark, path).mapInArrow(lambda listed: _contents(base, listed), "name string, content binary")
    return found.select("name", F.col("content").cast("string").alias("text"))


def with_numbers(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Add `number`: 1, 2, .. among the rows of a name, by `order` (a long) within 64 ways.

    A name that very many rows share is ranked in its ways, and the ways are put one after another by their counts.
    """
    way = F.pmod(F.coalesce(F.col(order), F.lit(0)), F.lit(_WAYS))
    dealt = rows.withColumn("_way", way)
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(name, "_way").orderBy(order)))
    before = Window.partitionBy(name).orderBy("_way").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(name, "_way").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(name, "_way", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranked.join(offsets, [name, "_way"]).withColumn("number", F.col("_before") + F.col("_rank")).drop("_way", "_rank", "_before")


def report_files(reports: DataFrame) -> DataFrame:
    """(name, text) of the files of each report: Markdown, JSON and the debug record, under names that no two reports share.

    The second report of a name is `name-2`, and says so where it names its files.
    """
    done = with_numbers(reports.where("reason IS NULL"), "report_name", "page_id")
    again = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    own, debug = F.concat("report_name", again), F.concat("debug_name", again)
    markdown = F.replace(F.col("report_markdown"), F.concat("report_name", F.lit(".json`")), F.concat(own, F.lit(".json`")))
    markdown = F.replace(markdown, F.concat("debug_name", F.lit(".json`")), F.concat(debug, F.lit(".json`")))
    files = F.array(
        F.struct(F.concat(own, F.lit(".md")).alias("name"), markdown.alias("text")),
        F.struct(F.concat(own, F.lit(".json")).alias("name"), F.col("report_json").alias("text")),
        F.struct(F.concat(debug, F.lit(".json")).alias("name"), F.col("debug_json").alias("text")),
    )
    return done.select(F.inline(files))


def comparison_files(compared: DataFrame, folder: Column, a_name: str, b_name: str) -> DataFrame:
    """(name, text) of the files of each comparison: both extractions as JSON and the report as Markdown, in a folder of its own."""
    files = F.array(
        F.struct(F.concat(folder, F.lit(f"/{a_name}_extraction.json")).alias("name"), F.col("a_data").alias("text")),
        F.struct(F.concat(folder, F.lit(f"/{b_name}_extraction.json")).alias("name"), F.col("b_data").alias("text")),
        F.struct(F.concat(folder, F.lit("/comparison_report.md")).alias("name"), F.col("comparison_markdown").alias("text")),
    )
    return compared.select(F.inline(files))
