"""Suffix-array dedup: bytes of every string of `length` bytes that starts at two places or more are removed.

Suffixes are only ordered among texts that can hold equal strings. A string of `length` bytes belongs to the least of its
grams of 32 bytes, by a hash (the leftmost of equal ones), and equal strings belong to equal grams at equal places. So:

1. neighbouring starts that belong to one gram are a block, and its text runs from the first start to the end of the last
   string; blocks are counted by gram and by a digest of their text. Equal blocks are repeats all over. Grams with one block
   are done with, and with them most of the text;
2. one text for each different block of a gram goes to the task that has the gram. The task orders the suffixes of its
   texts by a difference cover: it sorts and names the triples at places 1 and 2 modulo 3, recurses on the names where
   they are not all different, sorts the other suffixes by their first byte and the rank that follows, and merges the two;
3. neighbours in that order are compared over `length` bytes.

A gram with over `HOT` different blocks is not ordered in one task: its blocks are cut again by the next least gram of
each string, counted again, and so on; after `LEVELS` grams, digests of the strings that are left are counted one by one.
Texts above a segment's size are cut into segments that overlap by a string, for the first step alone.

Edge cases: a null text counts as empty; a text shorter than a string keeps all bytes. Equal rows, of one id or several,
repeat each other. A null id is an id like others. Kept bytes need not be valid UTF-8 and are binary. An empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.recompression import _mix, _powers
from factloom.llm.shared import written

GRAM = 32
HOT = 1024
LEVELS = 4
SEGMENT = 1 << 21
_BITS = 22
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ORDERED = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; `text` holds numbers from 1 up to 2^21 - 1."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.r_[text.astype(np.int64), 0, 0, 0]
    # A text of length 1 modulo 3 gets one more sampled place, so that the two halves below stay apart.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    names, name = np.unique(s[sample] << 42 | s[sample + 1] << 21 | s[sample + 2], return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    if len(names) < len(sample):
        order = suffix_array(name + 1)
        rank[sample[order]] = np.arange(1, len(sample) + 1)
    else:
        rank[sample] = name + 1
    sampled = np.empty(len(sample), np.int64)
    sampled[rank[sample] - 1] = sample
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] << 32 | rank[rest + 1], kind="stable")]
    # How many sampled suffixes of either kind come before each of the rest.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[ones] << 32 | rank[ones + 1], s[rest] << 32 | rank[rest + 1])
    triple = lambda at: s[at] << 42 | s[at + 1] << 21 | rank[at + 2]
    before = before + np.searchsorted(triple(twos), triple(rest))
    out = np.empty(n, np.int64)
    own = before + np.arange(len(rest))
    out[own] = rest
    free = np.ones(n, bool)
    free[own] = False
    out[free] = sampled
    return out


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    if len(raw) < GRAM:
        return np.empty(0, _U)
    sums = np.r_[_U(0), np.cumsum((raw.astype(_U) + _U(1)) * _powers(_BASE, len(raw)))]
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw))
    return _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(raw) - GRAM + 1])


def string_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Digests of the strings at `starts`, from the grams that cover them."""
    out = np.zeros(len(starts), _U)
    for at in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = _mix(out * _U(_BASE) + hashes[starts + at] + _U(1))
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from minima up to and from the edges of blocks."""
    pad = np.full(-len(values) % width, np.iinfo(_U).max, _U)
    parts = np.r_[values, pad].reshape(-1, width)
    upto = np.minimum.accumulate(parts, axis=1).ravel()
    since = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: len(values) - width + 1], upto[width - 1 : len(values)])


def _blocks(texts: list[bytes], length: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, gram hash, digest) of the blocks of texts of one segment at most each.

    `seen` holds for each text the hashes of grams that are left out. A string that has no others is a block by itself.
    """
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    begins = np.cumsum([0, *map(len, texts)])
    hashes = gram_hashes(raw)
    # The place is in the low bits: of grams with equal high bits the leftmost is the least.
    placed = hashes >> _U(_BITS) << _U(_BITS) | np.arange(len(hashes), dtype=_U)
    for j in range(0 if seen is None else seen.shape[1]):
        placed[hashes == np.repeat(seen[:, j], np.diff(begins))[: len(hashes)]] = np.iinfo(_U).max
    least = _least(placed, length - GRAM + 1)
    starts = np.arange(len(least))
    none_left = least == np.iinfo(_U).max
    anchor = np.where(none_left, starts, (least & _U((1 << _BITS) - 1)).astype(np.int64))
    doc = np.searchsorted(begins, starts, "right") - 1
    starts = starts[starts + length <= begins[doc + 1]]
    anchor, doc = anchor[starts], doc[starts]
    at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])][: len(starts)])
    first, size = starts[at], np.diff(np.r_[at, len(starts)])
    hashed = xxhash.xxh3_64_intdigest
    ends = first + size + length - 1
    digest = np.array([hashed(joined[a:b]) for a, b in zip(first.tolist(), ends.tolist())], _U)
    key = hashes[anchor[at]]
    alone = none_left[first]
    key[alone] = string_hashes(hashes, first[alone], length)
    return doc[at], first - begins[doc[at]], size, key, digest


def _segments(texts: list[str | None], length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Groups of segments of bounded size: bytes, number of the text, place in it."""
    group, numbers, places, size = [], [], [], 0
    for number, text in enumerate(texts):
        data = (text or "").encode()
        for place in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[place : place + SEGMENT + length - 1]
            if group and size + len(part) > SEGMENT + length:
                yield group, numbers, places
                group, numbers, places, size = [], [], [], 0
            group.append(part)
            numbers.append(number)
            places.append(place)
            size += len(part)
    if group:
        yield group, numbers, places


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """The blocks of (row, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            for texts, numbers, places in _segments(batch.column(1).to_pylist(), length):
                part, first, size, key, digest = _blocks(texts, length)
                first = first + np.array(places, np.int64)[part]
                yield pa.RecordBatch.from_arrays(
                    [_signed(key), _signed(digest), pa.array(row[np.array(numbers)[part]]), pa.array(first), pa.array(size)],
                    names=["key", "digest", "row", "first", "size"],
                )

    return rows.mapInArrow(run, "key long, digest long, row long, first long, size long")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """The texts of the `wanted` blocks of (text, wanted) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                for i in range(0, len(wanted), 4096):
                    part = wanted[i : i + 4096]
                    told = [pa.array([w[k] for w in part]) for k in ("key", "digest", "hot")]
                    cut = [data[w["first"] : w["first"] + w["size"] + length - 1] for w in part]
                    yield pa.RecordBatch.from_arrays(
                        [*told, pa.array(cut, pa.binary())], names=["key", "digest", "hot", "block"]
                    )

    return rows.mapInArrow(run, "key long, digest long, hot boolean, block binary")


_SPLIT = "key long, digest long, seen array<long>, own_key long, own_digest long, base long, block binary"


def _split(length: int):
    """Blocks cut again by their next least gram: rows (key, digest, seen, block) to rows of `_SPLIT`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                key, digest = (batch.column(i).to_numpy() for i in (0, 1))
                seen = np.array(batch.column(2).to_pylist(), np.int64).view(_U)
                texts = batch.column(3).to_pylist()
                part, first, size, gram, inner = _blocks(texts, length, seen)
                chained = _mix(key[part].view(_U) * _U(_BASE) + gram)
                passed = np.column_stack((seen[part], gram)).view(np.int64)
                cut = [texts[t][a : a + n + length - 1] for t, a, n in zip(part.tolist(), first.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(chained),
                        _signed(inner),
                        pa.array(passed.tolist(), pa.list_(pa.int64())),
                        pa.array(key[part]),
                        pa.array(digest[part]),
                        pa.array(first),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["key", "digest", "seen", "own_key", "own_digest", "base", "block"],
                )

    return run


def repeated_starts(texts: list[bytes], length: int) -> np.ndarray:
    """For the joined texts, whether the string at a place also starts elsewhere (in bounds of its text only)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    order = suffix_array(raw.astype(np.int64) + 1)
    order = order[order + length <= ends[order]]
    digest = string_hashes(gram_hashes(raw), order, length)
    same = digest[1:] == digest[:-1]
    out = np.zeros(len(raw), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


_GONE = "key long, digest long, gone array<struct<at:long,n:long>>"
_GONE_TYPE = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _ordered(length: int):
    """Compares blocks of equal grams, which come one after another."""

    def compare(keys: list, digests: list, texts: list) -> pa.RecordBatch:
        flags = repeated_starts(texts, length)
        ends = np.cumsum([len(t) for t in texts])
        gone = [_spans(flags[e - len(t) : e]) for e, t in zip(ends, texts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(digests, pa.int64()), pa.array(gone, _GONE_TYPE)],
            names=["key", "digest", "gone"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, texts, size = [], [], [], 0
        for batch in batches:
            for key, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size > _ORDERED and key != keys[-1]:
                    yield compare(keys, digests, texts)
                    keys, digests, texts, size = [], [], [], 0
                keys.append(key)
                digests.append(digest)
                texts.append(text)
                size += len(text)
        if keys:
            yield compare(keys, digests, texts)

    return run


def _strings(length: int):
    """A row for each string of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                starts = np.arange(len(text) - length + 1)
                found = string_hashes(gram_hashes(np.frombuffer(text, np.uint8)), starts, length)
                same = lambda v: pa.array(np.full(len(starts), v, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [same(key), same(digest), pa.array(starts), _signed(found)],
                    names=["key", "digest", "at", "string"],
                )

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                runs = []
                for a, n in sorted((g["at"], g["n"]) for g in gone or ()):
                    b = a + n + length - 1
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept = b"".join(data[b:a] for (_, b), (a, _) in zip([(0, 0), *runs], [*runs, (len(data), 0)]))
                out.append((len(data), len(data) - len(kept), len(runs), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else ((),) * 4, kinds)]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _repeats(cut: DataFrame, length: int, hot: int, levels: int) -> DataFrame:
    """(key, digest, gone): of different blocks (key, digest, hot, seen, block), the starts of strings that two of a key hold."""
    cold = cut.where(~F.col("hot")).select("key", "digest", "block").repartition("key").sortWithinPartitions("key")
    gone = cold.mapInArrow(_ordered(length), _GONE).where(F.size("gone") > 0)
    rest = cut.where("hot")
    if rest.isEmpty():
        return gone
    if not levels:
        kind = "key long, digest long, at long, string long"
        strings = written(rest.select("key", "digest", "block").mapInArrow(_strings(length), kind), "strings")
        twice = written(strings.groupBy("key", "string").count().where("count > 1").select("key", "string"), "twice")
        spans = F.collect_set(F.struct("at", F.lit(1).cast("long").alias("n")))
        ats = strings.join(twice, ["key", "string"], "left_semi").groupBy("key", "digest")
        return gone.unionByName(ats.agg(spans.alias("gone")))
    parts = written(rest.select("key", "digest", "seen", "block").mapInArrow(_split(length), _SPLIT), "parts")
    classes = written(parts.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")), "part-classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    several = written(several.select("key", (F.col("c") > hot).alias("hot")), "several")
    one = parts.dropDuplicates(["key", "digest"]).join(several, "key").select("key", "digest", "hot", "seen", "block")
    inner = written(_repeats(written(one, "block-texts"), length, hot, levels - 1), "repeats")
    told = classes.join(inner, ["key", "digest"], "left").where("n > 1 or gone is not null")
    hits = parts.join(written(told.select("key", "digest", "n", "gone"), "told"), ["key", "digest"])
    starts = (F.octet_length("block") - F.lit(length - 1)).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), starts.alias("n")))
    spans = F.inline(F.when(F.col("n") > 1, whole).otherwise(F.col("gone")))
    hits = hits.select("own_key", "own_digest", "base", spans)
    span = F.struct((F.col("base") + F.col("at")).alias("at"), "n")
    owned = hits.groupBy(F.col("own_key").alias("key"), F.col("own_digest").alias("digest"))
    return gone.unionByName(owned.agg(F.collect_set(span).alias("gone")))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT
) -> DataFrame:
    """(id, `n_bytes`, `n_removed`, `n_spans`, `kept`) for every row. `length` is 64 at least."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # Equal texts have equal results: they are one text that starts at as many places.
    row = F.xxhash64(F.col("text"), F.lit(1))
    rows = rows.select("id", row.alias("row"), "text")
    found = written(blocks(rows.select("row", "text"), length), "blocks")

    one = F.min(F.struct("row", "first", "size")).alias("one")
    classes = written(found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    several = written(several.select("key", (F.col("c") > hot).alias("hot")), "several")
    stands = classes.join(several, "key").select(
        F.col("one.row").alias("row"), F.struct("key", "digest", "hot", "one.first", "one.size").alias("wanted")
    )
    wanted = written(stands.groupBy("row").agg(F.collect_list("wanted").alias("wanted")), "wanted")
    texts = rows.select("row", "text").dropDuplicates(["row"]).join(wanted, "row").select("text", "wanted")
    cut = written(_cut(texts, length).withColumn("seen", F.array("key")), "block-texts")
    gone = written(_repeats(cut, length, hot, LEVELS), "repeats")

    told = classes.join(gone, ["key", "digest"], "left").where("n > 1 or gone is not null").select("key", "digest", "n", "gone")
    hits = found.join(written(told, "told"), ["key", "digest"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("size").alias("n")))
    spans = F.inline(F.when(F.col("n") > 1, whole).otherwise(F.col("gone")))
    hits = hits.select("row", "first", spans).select("row", F.struct((F.col("first") + F.col("at")).alias("at"), "n").alias("g"))
    removals = written(hits.distinct().groupBy("row").agg(F.collect_list("g").alias("gone")), "removals")
    kept = rows.join(removals, "row", "left").select("id", "text", "gone")
    kind = docs.schema[id_col].dataType.simpleString()
    out = kept.mapInArrow(_removed(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
