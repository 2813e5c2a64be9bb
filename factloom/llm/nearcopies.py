"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of at least `least`.

Groups of equal or close SimHash fingerprints (operator 5, over the same shingles) are compared first, each row with the smallest
of its group. What is left is found by an exact prefix filter. All shingles are put into one order, rare ones first. Two sets that
are similar enough have their first common shingle early in both: within the first n - ceil(least n) + 1 of the larger set, and
within n - ceil(2 least n / (1 + least)) + 1 of the smaller one, its index. Rows meet under these shingles, pairs of
unfitting sizes or places are left out, and every pair that remains is compared by its whole sets. Nothing similar is missed.

Under a shingle, rows are first compared with one of them (`turns` times, a different one each time); groups that this
connects are not compared inside. A group is what confirmed links connect; its ends may be less alike. Nothing is capped, and many
copies of one text cost a few comparisons each.

The order comes from counts of all shingles of the table in `BUCKETS` hash buckets, 4 bytes each, the only data that goes to every
task. It decides how many rows meet, never what is found: texts that share a passage do not meet under it, as its shingles
are frequent and stand last.

Before a pair is compared by its texts, its signs are: a sign is the parity of the shingles that a hash puts there, so two rows differ
in no more signs than shingles. Pairs with more different signs than similar sets may have shingles of their own are left out.

Edge cases: words are those of `simhash.fingerprint`, in lower case ASCII; a text of fewer than `width` words is one
shingle. Texts without words, null ones included, are copies of each other. Shingles are known by 64-bit hashes.
Repeated ids are rows of their own, a null id never is the smallest of a group that has another id. Further columns are
kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import simhash
from factloom.llm.components import components
from factloom.llm.shared import forget, written

BUCKETS = 1 << 20
#: Slices in which the counts of buckets travel, and ways in which a slice is first added up.
_PARTS, _WAYS = 16, 16
#: Hashes counted at a time.
_HELD = 1 << 20
#: How many ways the partners of one text are compared.
_CHUNKS = 32
#: Words of 64 signs for each row.
_SIGNS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 values of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(flat[a:b], 42) for a, b in spans), np.uint64))


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values * _ODD) >> np.uint64(44)).astype(np.int64)


def bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all texts (one column) fall into each bucket."""
    kinds = "part int, way int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, n, way = np.zeros(BUCKETS, np.int64), [], 0, 0
        for batch in batches:
            for text in batch.column(0):
                values = shingles(text.as_py(), width)
                way = (way + int(values[0])) % _WAYS
                held.append(_bucket(values))
                n += len(values)
                if n > _HELD:
                    totals += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=BUCKETS)
        parts = np.minimum(totals, 0xFFFFFFFF).astype(np.uint32).reshape(_PARTS, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(_PARTS), pa.int32()),
                pa.array([way] * _PARTS, pa.int32()),
                pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
            ],
            names=["part", "way", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        found = [zlib.compress(np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array(found, pa.binary())],
            names=["part", "way", "counts"],
        )

    once = texts.mapInArrow(count, kinds).repartition("part", "way").mapInArrow(add, kinds)
    out = np.zeros((_PARTS, BUCKETS // _PARTS), np.uint32)
    for row in once.repartition("part").mapInArrow(add, kinds).collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out.ravel()


def _at_least(share: float, n):
    """The smallest whole number that is `share` of n or more."""
    return np.ceil(share * n - 1e-9)


def first_shingles(values: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles, rare ones first, among which the first one common with a similar set no larger must be."""
    n = len(values) - int(_at_least(least, len(values))) + 1
    return values[np.lexsort((values, counts[_bucket(values)]))[:n]]


def signs(values: np.ndarray) -> np.ndarray:
    """The parities of the shingles, `_SIGNS` words of 64 bits."""
    places = ((values * _ODD) >> np.uint64(20)).astype(np.int64) % (64 * _SIGNS)
    odd = np.bincount(places, minlength=64 * _SIGNS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketched(docs: DataFrame, keep: list[str], text_col: str, width: int, least: float, counts: np.ndarray) -> DataFrame:
    """`keep` columns, the number of shingles, the first of them and the fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sizes, firsts, prints, marks = [], [], [], []
                for text in part.column(len(keep)).to_pylist():
                    values = shingles(text, width)
                    sizes.append(len(values))
                    firsts.append(first_shingles(values, counts, least).view(np.int64))
                    prints.append(simhash.fingerprint(text, width))
                    marks.append(signs(values))
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64)))
                found = [pa.array(sizes, pa.int64()), listed, pa.array(np.array(prints, np.uint64).view(np.int64))]
                flat = pa.array(np.concatenate(marks) if marks else np.empty(0, np.int64))
                found.append(pa.ListArray.from_arrays(np.arange(len(marks) + 1, dtype=np.int32) * _SIGNS, flat))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], *found], names=[*keep, "size", "firsts", "fingerprint", "signs"]
                )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*keep, docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"{kinds}size long, firsts array<long>, fingerprint long, signs array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts, rows of (node, text), are that similar.

    A text travels once for each pair it is the second of, and at most `_CHUNKS` times as the first; the partners
    of a text stream past its set, so a text with very many of them needs no more memory.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(_CHUNKS)).alias("chunk"))
    firsts = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    seconds = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    both = firsts.select("a", "chunk", F.lit(None).cast("long").alias("b"), "text").unionByName(seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                values = shingles(text.as_py(), width)
                if b is None:
                    first = values
                    continue
                common = len(np.intersect1d(first, values, assume_unique=True))
                if common >= _at_least(least, len(first) + len(values) - common):
                    found.append((a, b))
            columns = [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    sorted_rows = both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return sorted_rows.mapInArrow(run, "a long, b long")


def _fits(least: float) -> Column:
    """Whether the sets of a row and of another one (`other_` columns) may be similar, by their sizes and this common shingle's places."""
    small, large = F.least("size", "other_size"), F.greatest("size", "other_size")
    needed = F.ceil(F.lit(least / (1 + least)) * (small + large) - F.lit(1e-9))
    left = F.least(F.col("size") - F.col("pos"), F.col("other_size") - F.col("other_pos"))
    indexed = F.when(F.col("size") <= F.col("other_size"), F.col("indexed")).otherwise(F.lit(False)) | F.when(
        F.col("size") >= F.col("other_size"), F.col("other_indexed")
    ).otherwise(F.lit(False))
    return indexed & (left >= needed) & (small + F.lit(1e-9) >= F.lit(least) * large)


def _signs_fit(least: float) -> Column:
    """Whether the sets of a row and of another one may be similar, by their sizes and signs."""
    needed = F.ceil(F.lit(least / (1 + least)) * (F.col("size") + F.col("other_size")) - F.lit(1e-9))
    apart = sum((F.bit_count(F.get("signs", F.lit(i)).bitwiseXOR(F.get("other_signs", F.lit(i)))) for i in range(_SIGNS)), F.lit(0))
    return apart <= F.col("size") + F.col("other_size") - 2 * needed


_PLACED = ("node", "size", "pos", "indexed", "root")


def _other(rows: DataFrame) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"other_{c}") for c in (*_PLACED, "signs")))


def _with_signs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Add the signs of both rows of a pair (node, other_node)."""
    others = marks.select(F.col("node").alias("other_node"), F.col("signs").alias("other_signs"))
    return pairs.join(marks, "node").join(others, "other_node")


def _mixed(rows: DataFrame, turn: int) -> DataFrame:
    """The rows under keys that join several groups, next to one indexed member of the key, another one each turn.

    Rows move once, by key; a key has at most one row of each text, so it is a small part of all rows even where it is in all texts.
    """
    dealt = rows.repartition("key")
    order = F.struct((F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("order"), *_PLACED)
    keyed = dealt.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("indexed"), order)).alias("hub")
    )
    several = keyed.where((F.col("low") < F.col("high")) & F.col("hub").isNotNull())
    return dealt.join(several.select("key", *(F.col(f"hub.{c}").alias(f"other_{c}") for c in _PLACED)), "key")


def _sorted_pair() -> list[Column]:
    return [F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")]


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    rows = members.select("key", "node", "size", "pos", "indexed")
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(
    members: DataFrame, marks: DataFrame, texts: DataFrame, first_pairs: DataFrame, width: int, least: float, turns: int = 2
) -> DataFrame:
    """(node, root) of all nodes that confirmed links connect.

    `members` are the rows (key, node, size, pos, indexed) under shared keys, `marks` are (node, signs), and `first_pairs` (a, b) are
    compared beforehand.
    """
    found, roots, spent = [], None, []

    def confirm(pairs: DataFrame) -> bool:
        nonlocal roots
        asked = written(pairs, "pairs")
        new = written(confirmed(asked, texts, width, least), "confirmed")
        forget(asked)
        if new.isEmpty():
            return False
        found.append(new)
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        if roots is not None:
            spent.append(roots)
        roots = written(components(every), "roots")
        return True

    confirm(first_pairs)
    rows = members
    for turn in range(turns):
        mixed = written(_mixed(_rooted(rows, roots), turn), "mixed")
        spent.append(mixed)
        rows = mixed
        met = mixed.where((F.col("root") != F.col("other_root")) & _fits(least)).select("node", "other_node", "size", "other_size")
        met = _with_signs(met.distinct(), marks).where(_signs_fit(least))
        # One pair for each row and turn.
        if not confirm(met.groupBy("node").agg(F.min("other_node").alias("other_node")).select(*_sorted_pair()).distinct()):
            break
    mixed = written(_mixed(_rooted(rows, roots), 0).select("key", *_PLACED).join(marks, "node"), "mixed")
    met = mixed.where("indexed").join(_other(mixed), "key").where(
        (F.col("size") <= F.col("other_size")) & (F.col("root") != F.col("other_root")) & _fits(least) & _signs_fit(least)
    )
    confirm(met.select(*_sorted_pair()).distinct())
    forget(mixed, *found, *spent)
    return roots if roots is not None else members.select("node", F.col("node").alias("root")).limit(0)


def _members(rows: DataFrame, least: float) -> DataFrame:
    """(key, node, size, pos, indexed): the first shingles of each row that another row has too, and one of them as its index."""
    last = F.col("size") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("size") - F.lit(1e-9))
    dealt = rows.select("node", "size", F.posexplode("firsts").alias("pos", "key")).repartition("key")
    indexed = F.col("pos") <= last
    several = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(indexed).alias("any")).where("n > 1 AND any")
    return dealt.join(several.select("key"), "key").withColumn("indexed", indexed)


def kept_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8
) -> DataFrame:
    """One whole row of each group: that with the smallest id; of several, that with the smallest digest of id and text.

    Rows of equal id and text are one row. Rows are known by 16 bytes of that digest; whole rows meet the digests of those that go.
    """
    key = f"_key_{len(docs.columns)}"
    given = F.concat_ws("|", F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.coalesce(docs[text_col], F.lit("")))
    keyed = docs.withColumn(key, F.substring(F.unhex(F.sha2(given.cast("binary"), 256)), 1, 16))
    counts = bucket_counts(docs.select(docs[text_col].alias("text")), width)
    sketched = _sketched(keyed.select(id_col, key, text_col), [id_col, key], text_col, width, least, counts)
    # Numbers are given before the table is written, and read from it ever after.
    rows = written(
        sketched.select(
            F.col(id_col).alias("id"), F.col(key).alias("digest"), "size", "firsts", "fingerprint", "signs",
            F.monotonically_increasing_id().alias("node"),
        ),
        "sketches",
    )
    # Rows with equal id and text are one: the first of their numbers stands for them.
    firsts = rows.groupBy("digest").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = written(firsts.where("n > 1"), "repeated")
    more = rows.select("digest", "node").join(repeated, "digest").where("node <> first").select("node")
    unique = rows.join(written(more, "more"), "node", "left_anti")
    near = written(simhash.grouped(written(unique.select("node", "fingerprint"), "prints"), "node"), "near")
    close = near.where("node <> component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b"))
    members = written(_members(unique, least), "members")
    met = written(members.select("node").union(close.select("a")).union(close.select("b")).distinct(), "met")
    named = written(rows.join(met, "node", "left_semi").select("node", "id", "digest"), "named")
    marks = written(rows.join(met, "node", "left_semi").select("node", "signs"), "marks")
    texts = keyed.select(F.col(key).alias("digest"), docs[text_col].alias("text")).join(named.select("node", "digest"), "digest")
    texts = written(texts.select("node", "text"), "texts")
    roots = linked(members, marks, texts, close, width, least)
    grouped = written(named.join(roots, "node").select("id", "digest", "root"), "grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("digest")))
    winners = grouped.groupBy("root").agg(first.alias("first")).select("first.digest")
    losers = written(grouped.select("digest").distinct().join(winners, "digest", "left_anti").select(F.col("digest").alias(key)), "losers")
    again = written(repeated.select(F.col("digest").alias(key)).join(losers, key, "left_anti"), "again")
    forget(rows, near, members, met, named, marks, texts, roots, grouped, repeated)
    once = keyed.join(losers.union(again), key, "left_anti").unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return once.select(*docs.columns)
