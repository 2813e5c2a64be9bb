"""Pages that producers announce: a streaming source whose offset is a place in a manifest.

A producer puts its files anywhere below the folder and then announces them in chunks, `_arrivals/00000000.txt` and so on, one path a line
(`announce` does both checks and numbers). An offset is the number of chunks taken up. To find new ones the source looks for the
next chunk and those after it, so a trigger costs what has arrived since, however many files there ever were: no folder is
listed and no map of seen files is kept. Each chunk is read by a task of its own; a chunk that is read again gives the same rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from factloom.schemas import PAGE_FILE
from factloom.sources.pages import as_pages

FORMAT = "announced_files"
CHUNKS = "_arrivals"
#: Bytes of content that a task holds at a time.
_HELD = 32 << 20


def file_system(path: str):
    """The file system of a path and the path in it; a bare path is local."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _chunk(root: str, number: int) -> str:
    return f"{root}/{CHUNKS}/{number:08}.txt"


def _exists(files, path: str) -> bool:
    from pyarrow.fs import FileType

    return files.get_file_info(path).type == FileType.File


def _first_free(files, root: str, number: int) -> int:
    """The first number from `number` on without a chunk: steps double until one is free, and halve back."""
    step = 1
    while _exists(files, _chunk(root, number + step - 1)):
        number, step = number + step, step * 2
    while step > 1:
        step //= 2
        if _exists(files, _chunk(root, number + step - 1)):
            number += step
    return number


def announce(directory: str, names: list[str], start: int = 0) -> int:
    """Write one chunk that announces files below `directory` by their relative names; returns the number after it.

    A chunk appears whole, and never over another one of the same producer.
    """
    files, root = file_system(directory.rstrip("/"))
    number = _first_free(files, root, start)
    files.create_dir(f"{root}/{CHUNKS}", recursive=True)
    beside = f"{root}/{CHUNKS}/_{number}.tmp"
    with files.open_output_stream(beside) as out:
        out.write("".join(f"{n}\n" for n in names).encode())
    files.move(beside, _chunk(root, number))
    return number + 1


class AnnouncedFiles(DataSource):
    """Reads (path, modificationTime, length, content) of announced files; a file that is gone by then is passed over."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGE_FILE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  (the name Spark calls)
        return AnnouncedReader(self.options["path"].rstrip("/"))


class Chunk(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class AnnouncedReader(DataSourceStreamReader):
    """A trigger takes all chunks there are, each in a task of its own; a stream that runs again goes on from its checkpoint."""

    def __init__(self, path: str):
        self.path, self.known = path, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"chunks": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        # The manifest has no gaps: what is there is found from where the last trigger ended.
        self.known = _first_free(*file_system(self.path), self.known)
        return {"chunks": self.known}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        return [Chunk(n) for n in range(start["chunks"], end["chunks"])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        files, root = file_system(self.path)
        prefix = self.path if "://" in self.path or self.path.startswith("file:") else f"file:{self.path}"
        with files.open_input_stream(_chunk(root, partition.value)) as chunk:
            names = chunk.read().decode().splitlines()
        rows, held = [], 0
        for name in names:
            info = files.get_file_info(f"{root}/{name}")
            if not info.is_file:
                continue
            with files.open_input_stream(info.path) as content:
                data = content.read()
            rows.append((f"{prefix}/{name}", info.mtime or datetime.datetime.fromtimestamp(0, datetime.timezone.utc), len(data), data))
            held += len(data)
            if held > _HELD:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "modificationTime", "length", "content"])


def stream_announced_pages(spark: SparkSession, directory: str) -> DataFrame:
    """HTML files as they are announced; each announcement is taken up once per checkpoint."""
    spark.dataSource.register(AnnouncedFiles)
    files = spark.readStream.format(FORMAT).option("path", directory).load()
    return as_pages(files)


def manifest_size(directory: str) -> int:
    """How many chunks are announced."""
    files, root = file_system(directory.rstrip("/"))
    return _first_free(files, root, 0)
