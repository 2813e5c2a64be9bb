"""WARC files as a PySpark data source, and payload dedup into response and revisit records.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").option("path", folder).mode("append").save()
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Files are `.warc.gz`, one gzip member per record, rolled at `roll_bytes` of written bytes, so that a read
partition (a group of whole files) has a bounded size. A task writes files under names of its own attempt,
and the commit lists those of the attempts that won; a reader of a folder with such a list ignores other files, so a
task that is run again leaves no second copy. Folders may be any address that pyarrow's file systems open.

Reading plans partitions from file sizes. Filters on `record_type` and on headers that have a column are pushed
down: headers are parsed first, and a record that fails is inflated past, neither kept, hashed nor decoded.
Where no payload is asked for (option `payload` false), the payloads of wanted records are passed over as well.

Edge cases: a null payload or target counts as empty. A record cut off at the end of its file raises an error.
Header values have their control characters percent-encoded and read back. Rows that share the largest id of
their payload are all responses. A null id is smaller than any other. An empty table makes an empty archive,
and that gives no rows. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from factloom.llm.shared import fresh_path, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, payload_bytes long, http_headers string, payload binary"
)
# Column -> WARC header.
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CHUNK = 1 << 18


def files_of(path: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _plain(value: str | None) -> str:
    return "".join(c if c > " " and c not in "%\x7f" else urllib.parse.quote(c) for c in value or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP headers and no payload."""
    http = _HTTP % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {_plain(uri)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll = int(options.get("roll_bytes", 64 << 20))
        self.level = int(options.get("level", 1))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = files_of(self.path)
        system.create_dir(folder)
        names, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.roll:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
            payload = bytes(row["payload"] or b"")
            data = record_bytes(
                row["record_type"], row["record_id"], row["target_uri"], row["warc_date"], payload, row["refers_to"]
            )
            pack = zlib.compressobj(self.level, wbits=31)
            data = pack.compress(data) + pack.flush()
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        system, folder = files_of(self.path)
        system.create_dir(folder)
        with system.open_output_stream(f"{folder}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())


class _Headers:
    """Reads records one after another from a gzip file of one member per record."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""
        self.member, self.text, self.done = None, bytearray(), False

    def _more(self) -> bool:
        """Inflate a further piece of the member into `text`; False at its end."""
        while not self.member.eof:
            data = self.member.unconsumed_tail or self.rest or self.stream.read(_CHUNK)
            if not data:
                raise ValueError("a WARC record is cut off")
            self.rest = b""
            piece = self.member.decompress(data, _CHUNK)
            self.rest = self.member.unused_data
            if piece:
                self.text += piece
                return True
        return False

    def next(self) -> dict | None:
        """Skip what is left of a record and parse the next one's headers; None at the end of the file."""
        if self.member is not None:
            while self._more():
                self.text.clear()
        self.text.clear()
        self.rest = self.rest or self.stream.read(_CHUNK)
        if not self.rest:
            return None
        self.member = zlib.decompressobj(wbits=31)
        while (end := self.text.find(b"\r\n\r\n")) < 0 and self._more():
            pass
        if end < 0 or not self.text.startswith(b"WARC/1."):
            raise ValueError("a member does not begin with a WARC header")
        head = bytes(self.text[:end]).decode()
        del self.text[: end + 4]
        return dict(line.split(": ", 1) for line in head.split("\r\n")[1:])

    def block(self, length: int) -> bytes:
        while len(self.text) < length and self._more():
            pass
        if len(self.text) < length:
            raise ValueError("a WARC record is cut off")
        return bytes(self.text[:length])


class _Files(InputPartition):
    def __init__(self, files: list):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.target = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in _HEADERS and name != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name in ("record_id", "record_type", "payload_digest")):
                yield f  # Spark applies what is not taken here

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = files_of(self.path)
        found = {
            i.base_name: i.size
            for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            if i.type == fs.FileType.File
        }
        lists = [n for n in found if n.startswith("_files-")]
        names = sorted(n for n in found if n.endswith(".warc.gz"))
        if lists:
            names = []
            for one in sorted(lists):
                with system.open_input_stream(f"{folder}/{one}", compression=None) as stream:
                    names += json.loads(stream.read())
        groups, size = [[]], 0
        for name in names:
            if groups[-1] and size + found[name] > self.target:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += found[name]
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, folder = files_of(self.path)
        for name in partition.files:
            with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                records = _Headers(stream)
                while (head := records.next()) is not None:
                    row = {column: head.get(key) for column, key in _HEADERS.items()}
                    for key in ("record_id", "refers_to"):
                        row[key] = row[key] and row[key].strip("<>")
                    row["target_uri"] = urllib.parse.unquote(row["target_uri"] or "")
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:")
                    if any(row[column] not in values for column, values in self.wanted.items()):
                        continue
                    http = payload = None
                    if self.payload:
                        block = records.block(int(head["Content-Length"]))
                        http, _, body = block.partition(b"\r\n\r\n")
                        http, payload = http.decode(), body if row["record_type"] == "response" else None
                    yield (
                        row["record_id"],
                        row["record_type"],
                        row["target_uri"],
                        row["warc_date"],
                        row["refers_to"],
                        row["payload_digest"],
                        int(row["payload_bytes"]) if row["payload_bytes"] is not None else None,
                        http,
                        payload,
                    )


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def hex_of(digest: Column) -> Column:
    """A bare base32 digest in lowercase hex."""
    value = F.translate(digest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    # Four letters of base 32 are five hex digits.
    part = lambda i: F.lpad(F.conv(F.substring(value, 4 * i + 1, 4), 32, 16), 5, "0")
    return F.lower(F.concat(*(part(i) for i in range(8))))


def page_records(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Records to write: of equal payloads of `min_bytes` or more the row with the largest id is the response.

    Payloads are equal when their SHA-256 and length are; page texts stay in their rows until the one join
    by which a row learns its response, and groups are combined in their mappers first.
    """
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("key", F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("key")
    # Only groups of two and more are looked up: few rows, whatever the pages weigh.
    several = groups.agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    joined = rows.join(written(several, "warc-groups"), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce("uri", F.lit("")).alias("target_uri"),
        F.lit("2000-01-01T00:00:00Z").alias("warc_date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("http_headers"),
        "payload",
    )


def archive(records: DataFrame, **options: str) -> str:
    """Write records to a fresh folder of the shared one; returns its address."""
    spark = records.sparkSession
    register(spark)
    path = fresh_path(spark, "warc")
    records.write.format("warc").options(**options).mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
