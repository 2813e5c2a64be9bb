"""SimHash near-dedup: 64-bit fingerprints, linked within a radius by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree on one of `radius + 1` blocks of bits, so each
fingerprint goes to one bucket per block and is compared inside its buckets only. Within a bucket, 64 members
lie in one machine word per bit plane. A comparison adds the differing planes of 64 members at once in a
carry-save counter, and stops for a word as soon as all 64 are beyond the radius.

A bucket above `HOT` members is dealt out again by the blocks of its remaining bits, to any depth the bits allow,
and so no bucket is capped. A bucket of fingerprints that agree in all the bits it was dealt by is compared in
full, in words and chunks of bounded size.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and link with each other
and with whatever lies within the radius of it. Equal fingerprints are compared once. A null id never is the
smallest of a group that has another id. Repeated ids are rows of their own. Very long texts are counted in
slices. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import written

HOT = 16384
_SLICE = 1 << 16
_TASKS = 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the XXH64 values of the text's word shingles; unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(spans), _SLICE):
        values = np.array([hashed(flat[a:b], seed) for a, b in spans[i : i + _SLICE]], np.uint64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """`keep` columns and `fingerprint`, a long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(values.view(np.int64))], names=[*keep, "fingerprint"]
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(run, f"{kinds}fingerprint long")


def _planes(members: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: from (blocks, 64) to (64 planes, blocks)."""
    out = np.empty((64, len(members)), np.uint64)
    for i in range(0, len(members), 1024):
        part = members[i : i + 1024]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        out[:, i : i + 1024] = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    return out


def _beyond(planes: np.ndarray, block: np.ndarray, query: np.ndarray, out: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, block), a word that has a bit set for each member beyond the radius or set in `out`."""
    depth = max(1, radius.bit_length())
    live, beyond = np.arange(len(block)), out.copy()
    rows, words, over = block, query, out
    # The counter starts so that it overflows at radius + 1.
    start = (1 << depth) - 1 - radius
    counter = [np.full(len(rows), _FULL if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    for p in range(64):
        carry = planes[p, rows] ^ (np.uint64(0) - (words >> np.uint64(p) & np.uint64(1)))
        for k in range(depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry
        if p % 4 == 3:
            beyond[live] = over
            left = over != _FULL
            if not left.all():
                live, rows, words, over = live[left], rows[left], words[left], over[left]
                counter = [c[left] for c in counter]
            if not len(live):
                break
    return beyond


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows one label, that of the first row among them."""
    while len(a):
        x, y = labels[a], labels[b]
        left = x != y
        if not left.any():
            return
        a, b, x, y = a[left], b[left], x[left], y[left]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def linked(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the rows of equal key (adjacent rows) within the radius: as many as needed, not all pairs."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    first, sizes = first[sizes > 1], sizes[sizes > 1]
    if not len(first):
        return values[:0], values[:0]
    # Blocks of 64 members; the last of a bucket is padded.
    blocks = -(-sizes // 64)
    begin = np.cumsum(blocks) - blocks
    bucket = np.repeat(np.arange(len(sizes)), blocks)
    at = (np.arange(len(bucket)) - begin[bucket]) * 64
    start, fill = first[bucket] + at, np.minimum(64, sizes[bucket] - at)
    lane = np.arange(64)
    members = values[np.minimum(start[:, None] + lane, len(values) - 1)]
    pad = np.packbits(lane >= fill[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = _planes(members)
    # Each member meets its own block and the later ones of its bucket.
    rows = np.repeat(first, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    own = np.repeat(begin, sizes) + (rows - np.repeat(first, sizes)) // 64
    meets = np.repeat(begin + blocks, sizes) - own
    ends = np.cumsum(meets)
    labels, low = np.arange(len(values)), 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _TASKS, "right")))
        part = np.arange(low, high)
        row = np.repeat(rows[part], meets[part])
        step = np.arange(len(row)) - np.repeat(np.cumsum(meets[part]) - meets[part], meets[part])
        block = np.repeat(own[part], meets[part]) + step
        position = (row - start[block]).astype(np.uint64)
        upto = np.where(step == 0, _FULL >> (np.uint64(63) - np.where(step == 0, position, 0).astype(np.uint64)), 0)
        beyond = _beyond(planes, block, values[row], pad[block] | upto.astype(np.uint64), radius)
        hit = np.flatnonzero(beyond != _FULL)
        bits = np.unpackbits((~beyond[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        task, which = np.nonzero(bits)
        _join(labels, row[hit[task]], start[block[hit[task]]] + which)
        low = high
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return values[moved], values[labels[moved]]


def _blocks(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """One row for each block of the remaining bits: a key that also holds the earlier one, and what then remains."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]

    def part(low: int, high: int) -> Column:
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0)
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
        return F.struct(F.xxhash64("key", F.lit(low), value).alias("key"), rest.alias("rest"))

    parts = F.inline(F.array(*(part(a, b) for a, b in zip(edges, edges[1:]))))
    return rows.select("fingerprint", parts)


def links(values: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints within the radius of each other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            a, b = linked(keys, prints.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            prints = np.concatenate((prints, batch.column(1).to_numpy()))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole > _SLICE:
                yield found(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield found(keys, prints)

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", "fingerprint").repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(compare, "a long, b long")

    rows = values.select("fingerprint", F.lit(0).cast("long").alias("key"), F.col("fingerprint").alias("rest"))
    bits, out = 64, None
    while True:
        rows = written(_blocks(rows, bits, radius), "buckets")
        bits -= bits // (radius + 1)  # the widest remainder
        full = written(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-buckets")
        if bits <= radius + 1 or full.isEmpty():
            return compared(rows) if out is None else out.unionByName(compared(rows))
        cold = compared(rows.join(full, "key", "left_anti"))
        out = cold if out is None else out.unionByName(cold)
        rows = rows.join(full, "key", "left_semi")


def _groups(values: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, root, component_id) of distinct fingerprints and the least id of each."""
    roots = written(components(links(values.select("fingerprint"), radius)), "roots")
    rooted = values.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    several = roots.join(least, "root").select(F.col("node").alias("fingerprint"), "root", "component_id")
    several = written(several, "several")
    alone = values.join(several, "fingerprint", "left_anti").select(
        "fingerprint", F.col("fingerprint").alias("root"), F.col("least").alias("component_id")
    )
    return written(several.unionByName(alone), "groups")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """(id, `fingerprint` as a long, `component_id`): the smallest id reachable over links, the row's own included."""
    prints = written(fingerprints(docs.select(id_col, text_col), [id_col], text_col, width), "fingerprints")
    return grouped(prints, id_col, radius)


def grouped(prints: DataFrame, id_col: str, radius: int = 3) -> DataFrame:
    """`near_groups` of rows (id, fingerprint) of a written table."""
    values = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "values")
    return prints.join(_groups(values, radius), "fingerprint").select(id_col, "fingerprint", "component_id")


def kept_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """One whole row of each group: that with the smallest id; of several, that with the smallest digest of id and text.

    Rows of equal id and text are one row. Whole rows move once, by their digest.
    """
    key = f"_key_{len(docs.columns)}"
    given = F.concat_ws("|", F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.coalesce(docs[text_col], F.lit("")))
    keyed = docs.withColumn(key, F.sha2(given.cast("binary"), 256))
    prints = written(
        fingerprints(keyed.select(id_col, key, text_col), [id_col, key], text_col, width), "fingerprints"
    )
    values = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "values")
    rows = prints.join(_groups(values, radius), "fingerprint")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key")))
    winners = written(rows.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias(key)), "winners")
    return keyed.dropDuplicates([key]).join(winners, key, "left_semi").select(*docs.columns)
