"""Substring dedup by recompression: equal word sequences get equal names inside, shared names reveal repeats.

A word's name is a 64-bit hash of it, and the name of a run or pair is a hash of its parts' names: the same everywhere,
so no round has to gather a table of names. Round one names runs of equal words, then pairs, where the first name hashes
to the left side and the second to the right side; round two names pairs of these symbols. Each symbol keeps the range of
words that decided it (its context, up to eight words or so), and is found wherever these words occur together.

A window of `width` words belongs to the least symbol, by a hash of its name, whose context lies in the window: equal windows
belong to equal symbols with equal contexts. A window without one (inside long runs) belongs to itself. Then, in Spark:

1. contexts are counted by document; those in one document only are done with, and with them most of the text;
2. neighbouring windows of one context are a block; equal blocks are one class, by a digest of all their words. Every
   block of a class but those of its first document goes;
3. where a context has several classes, their windows are compared one by one, one block for each class.

Names of 64 bits find candidates; what is removed also agrees in a second, independent hash of the words.

Edge cases: a null text has no words. A null id is larger than any other, and documents of one id never
remove from each other. Rows that repeat an id are looked at one by one; equal rows get equal results. Texts shorter than a
window keep all words. Texts are read whole, a batch of bounded size at a time. An empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written

_U = np.uint64
_LAST = np.iinfo(np.int64).max
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd multipliers
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _U(0x9E3779B97F4A7C15) + _mix(b) + _U(1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: where they lie in the joined bytes, whose they are, and two names of each."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode() for t in texts]
        self.bytes = b"\n".join(data) + b"\n"
        raw = np.frombuffer(self.bytes, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(d) + 1 for d in data[:-1]]) if data else np.empty(0, int)
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(data) + 1))
        self.names = [self._hashed(raw, base) for base in _BASES]

    def _hashed(self, raw: np.ndarray, base: int) -> np.ndarray:
        """A polynomial of the bytes of each word, by differences of running sums modulo 2^64."""
        power = _powers(base, len(raw))
        sums = np.r_[_U(0), np.cumsum((raw.astype(_U) + _U(1)) * power)]
        inverse = _powers(pow(base, -1, 1 << 64), len(raw))
        value = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return _mix(value + _mix((self.end - self.start).astype(_U)))


class Symbols:
    """Names of consecutive parts of a word sequence; the words [start, end) of each, and those that decided it."""

    def __init__(self, name, start, end, low, high, doc):
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc


def runs(names: np.ndarray, doc: np.ndarray) -> Symbols:
    """Maximal runs of equal words; decided by the words on either side."""
    first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])][: len(names)])
    end = np.r_[first[1:], len(names)] if len(names) else first
    size = end - first
    name = np.where(size > 1, _pair_name(names[first], size.astype(_U)), names[first])
    return Symbols(name, first, end, first - 1, end + 1, doc[first])


def pairs(s: Symbols, salt: int) -> Symbols:
    """Pairs of a left and a right name. A pair is decided by its own parts, a single one by its neighbour as well."""
    n = len(s.name)
    if not n:
        return s
    left = (_mix(s.name + _U(salt)) & _U(1)).astype(bool)
    together = left[:-1] & ~left[1:] & (s.doc[:-1] == s.doc[1:])
    opens, closes = np.r_[together, False], np.r_[False, together]
    low, high = s.low.copy(), s.high.copy()
    single = ~opens & ~closes
    # At the edge of a document there is no neighbour: such a symbol is undecided inside any window.
    after = np.r_[np.where(s.doc[1:] == s.doc[:-1], s.high[1:], s.end[:-1] + 1), s.end[-1] + 1]
    before = np.r_[s.start[0] - 1, np.where(s.doc[1:] == s.doc[:-1], s.low[:-1], s.start[1:] - 1)]
    high = np.where(single & left, np.maximum(high, after), high)
    low = np.where(single & ~left, np.minimum(low, before), low)
    at = np.flatnonzero(~closes)
    mate = np.minimum(at + 1, n - 1)
    paired = opens[at]
    return Symbols(
        np.where(paired, _pair_name(s.name[at], s.name[mate]), s.name[at]),
        s.start[at],
        np.where(paired, s.end[mate], s.end[at]),
        low[at],
        np.where(paired, high[mate], high[at]),
        s.doc[at],
    )


def _digest(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words [low, high) of each row."""
    key = _mix((high - low).astype(_U))
    for k in range(int((high - low).max()) if len(low) else 0):
        inside = np.flatnonzero(low + k < high)
        key[inside] = _mix(key[inside] * _U(0x9E3779B97F4A7C15) + names[low[inside] + k])
    return key


class Blocks:
    """Neighbouring windows that belong to one symbol: first window, number of windows, hash of context, of all words."""

    def __init__(self, words: Words, width: int):
        names, doc = words.names[0], words.doc
        n = len(names)
        first = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.empty(0, np.int64)
        s = pairs(pairs(runs(names, doc), 1), 2)
        rank = _mix(s.name + _U(3))
        a = np.searchsorted(s.low, first)
        b = np.searchsorted(s.high, first + width, "right")
        best, least = np.full(len(first), -1), np.full(len(first), _U(0))
        for t in range(int((b - a).max(initial=0))):
            at = a + t
            value = rank[np.minimum(at, len(rank) - 1)]
            better = (at < b) & ((best < 0) | (value < least))
            best, least = np.where(better, at, best), np.where(better, value, least)
        new = np.r_[True, (best[1:] != best[:-1]) | (best[1:] < 0) | (doc[first[1:]] != doc[first[:-1]])][: len(first)]
        at = np.flatnonzero(new)
        self.first, self.size = first[at], np.diff(np.r_[at, len(first)])
        symbol = best[at]
        named = symbol >= 0
        low = np.where(named, s.low[symbol] if len(s.low) else 0, self.first)
        high = np.where(named, s.high[symbol] if len(s.high) else 0, self.first + width)
        self.key = _digest(names, low, high)
        self.all = _digest(words.names[1], self.first, self.first + self.size + width - 1)
        self.doc = doc[self.first]


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of some MB of text, or of one row."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t or "") > _BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t or "")
        if start < len(texts):
            yield batch.slice(start), texts[start:]


_BLOCK = "key long, all long, id long, row long, first int, size int"


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """The blocks of (id, row, text) rows; `first` counts words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches, 2):
            words = Words(texts)
            found = Blocks(words, width)
            ids, row = (batch.column(i).to_numpy()[found.doc] for i in (0, 1))
            first = (found.first - words.first[found.doc]).astype(np.int32)
            columns = [_signed(found.key), _signed(found.all), ids, row, first, found.size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                names=["key", "all", "id", "row", "first", "size"],
            )

    return rows.mapInArrow(run, _BLOCK)


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """A row for each window of the blocks named in `wanted`: key, all, id, number in its block, hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches, 0):
            words = Words(texts)
            wanted = batch.column(1)
            flat = wanted.flatten()
            key, whole, ids, first, size = (flat.field(i).to_numpy() for i in range(5))
            doc = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
            number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            start = np.repeat(words.first[doc] + first, size) + number
            repeat = lambda c: pa.array(np.repeat(c, size))
            yield pa.RecordBatch.from_arrays(
                [
                    repeat(key),
                    repeat(whole),
                    repeat(ids),
                    pa.array(number.astype(np.int32)),
                    _signed(_digest(words.names[1], start, start + width)),
                ],
                names=["key", "all", "id", "number", "window"],
            )

    return rows.mapInArrow(run, "key long, all long, id long, number int, window long")


def _removed(width: int):
    """Applies the removals of each text: its windows as (first, size, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches, 1):
            out = []
            for text, gone in zip(texts, batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                if gone:
                    first, size, mask = (np.array([g[k] for g in gone], np.int64) for k in ("first", "size", "mask"))
                    number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    start = (np.repeat(first, size) + number)[(np.repeat(mask, size) >> number & 1).astype(bool)]
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + width, -1)
                    keep = np.cumsum(change)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                out.append((n, n - len(words), b" ".join(words).decode()))
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else ((), (), ()), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(id, `n_words`, `n_removed`, `kept`): each text without words of windows that a smaller id has.

    At most 63 windows belong to one symbol, so `width` is 63 at most.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("given"), text.alias("text"))
    rows = rows.select("given", F.coalesce("given", F.lit(_LAST)).alias("id"), "text")
    row = F.xxhash64("id", "text")
    found = blocks(rows.select("id", row.alias("row"), "text"), width)

    by_key = found.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = written(by_key.where("least < most").select("key"), "contexts")
    found = written(found.join(shared, "key", "left_semi"), "blocks")

    classes = written(found.groupBy("key", "all").agg(F.min("id").alias("least"), F.max("id").alias("most")), "classes")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("low"), F.max("least").alias("high"))
    several = written(several.where("n > 1 and low < high").select("key"), "several")
    # One block of the first document stands for its class.
    mixed = classes.join(several, "key", "left_semi").select("key", "all", F.col("least").alias("id"))
    one = F.min(F.struct("row", "first", "size")).alias("one")
    stands = found.join(mixed, ["key", "all", "id"]).groupBy("key", "all", "id").agg(one)
    wanted = stands.select(
        F.col("one.row").alias("row"), "id", F.struct("key", "all", "id", "one.first", "one.size").alias("wanted")
    )
    wanted = written(wanted.groupBy("row", "id").agg(F.collect_list("wanted").alias("wanted")), "wanted")
    texts = rows.withColumn("row", row).join(wanted, ["row", "id"]).groupBy("row", "id")
    texts = texts.agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    windows = written(_windows(texts.select("text", "wanted"), width), "windows")
    least = windows.groupBy("key", "window").agg(F.min("id").alias("least"))
    hits = windows.join(written(least, "least"), ["key", "window"]).where("least < id")
    masks = hits.groupBy("key", "all").agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("mask"))
    told = written(classes.join(masks, ["key", "all"], "left").where("least < most or mask is not null"), "told")

    mask = F.when(F.col("id") > F.col("least"), F.lit(-1).cast("long")).otherwise(F.coalesce("mask", F.lit(0)))
    gone = found.join(told, ["key", "all"]).select("row", "id", F.struct("first", "size", mask.alias("mask")).alias("gone"))
    gone = gone.where("gone.mask <> 0").distinct().groupBy("row", "id").agg(F.collect_list("gone").alias("gone"))
    gone = written(gone, "removals")
    whole = rows.withColumn("row", row).join(gone, ["row", "id"], "left").select("given", "text", "gone")
    kept = whole.mapInArrow(_removed(width), "id long, n_words long, n_removed long, kept string")
    return kept.withColumnRenamed("id", id_col)
