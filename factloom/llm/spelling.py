"""Spelling variants by permuterm rotations: words one edit apart, and the common form each is a variant of.

A word w is marked with a terminator, and all rotations of w$ are sorted. The rotation Y$Xc of the word XcY ends in the
character c; without it, the prefix Y$X is left. All words that differ from XcY by replacing c share this prefix, and the
word XY, which lacks c, has Y$X as a whole rotation. So the words of a prefix are one edit from each other and no others are:
a group has at most one word for each letter and one without. Groups are scanned, and every member meets their two most
frequent words; pairs are not listed. A doubled letter can be inserted at several places; only the first of its run counts.

Words of more than `LONG` code points would have rotations as long as themselves. Theirs are known by two digests each, of
what stands before and behind the edited character; nothing else differs.

Edge cases: a null text has no words, a null id is the empty string in the digest of a run. Repeated rows count again.
Ties go to the smallest word in code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import written

#: The letters of words, A-Z apart, as Latin-1 bytes: a byte is a code point.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
#: Not a letter of words.
END = "$"
LONG = 64
#: Counts a task holds before it hands them on.
_HELD = 200_000


def count_words(
    docs: DataFrame, shortest: int = 5, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None
) -> DataFrame:
    """(word, n) of all runs of letters with at least `shortest` code points, A-Z in lower case.

    With `typo_every`, a run whose crc32 of `<id>:<run>` this number divides loses the code point at that crc32 modulo its length.
    """

    def flushed(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        batch = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Characters beyond Latin-1 become a question mark, which is no letter either.
                runs = Counter(RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    if len(word) < shortest:
                        continue
                    if typo_every:
                        digest = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if digest % typo_every == 0:
                            at = digest % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield flushed(counts)
        yield flushed(counts)

    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, n): each whole rotation, with nothing edited, and each without its last character, the edited one."""
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("k"))
    behind = F.expr("substr(word, k + 1)")
    whole = F.struct(F.concat(behind, F.lit(END), F.expr("substr(word, 1, k)")).alias("prefix"), F.lit("").alias("edited"))
    cut = F.struct(
        F.concat(behind, F.lit(END), F.expr("substr(word, 1, k - 1)")).alias("prefix"),
        F.expr("substr(word, k, 1)").alias("edited"),
    )
    both = F.when(F.col("k") > 0, F.array(whole, cut)).otherwise(F.array(whole))
    return turned.select("n", F.inline(both)).select("prefix", "edited", "n")


def near_in_groups(words: DataFrame) -> DataFrame:
    """(word, n_near, best: struct(rank, near)) from each prefix that several words share."""
    # Rotations meet without their word, which prefix and edited character spell.
    rows = rotations(words).repartition("prefix")
    ahead, behind = F.substring_index("prefix", END, -1), F.substring_index("prefix", END, 1)
    rows = rows.select(
        "prefix",
        "edited",
        F.struct((-F.col("n")).alias("rank"), F.concat(ahead, "edited", behind).alias("near")).alias("own"),
        # An insertion here makes the same word as one place earlier.
        F.when(F.col("edited") == "", 0).when(F.endswith(ahead, F.col("edited")), 0).otherwise(1).alias("inserts"),
    )
    group = Window.partitionBy("prefix").orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = rows.select(
        "edited",
        "own",
        "inserts",
        F.count(F.lit(1)).over(group).alias("members"),
        F.sum((F.col("edited") != "").cast("int")).over(group).alias("edits"),
        F.sum("inserts").over(group).alias("insertions"),
        F.first("own").over(group).alias("first"),
        F.nth_value("own", 2).over(group).alias("second"),
    ).where("members > 1")
    shorter = F.col("members") - F.col("edits")
    return scanned.select(
        F.col("own.near").alias("word"),
        F.when(F.col("edited") == "", F.col("insertions"))
        .otherwise(F.col("edits") - 1 + shorter * F.col("inserts"))
        .cast("long")
        .alias("n_near"),
        F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"),
    )


def _long_keys(words: DataFrame) -> DataFrame:
    """(key, node) for words from `LONG` code points on; those of just `LONG` only lack a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = [c.encode() for c in word]
                sides = []
                for side in (letters, letters[::-1]):
                    digest, found = hashlib.sha256(), [hashlib.sha256().digest()]
                    for letter in side:
                        digest.update(letter)
                        found.append(digest.digest())
                    sides.append(found)
                ahead, behind = sides[0], sides[1][::-1]
                keys = [a + b for a, b in zip(ahead, behind)]
                if len(letters) > LONG:
                    keys += [a + b for a, b in zip(ahead, behind[1:])]
                for at in range(0, len(keys), 10_000):
                    part = keys[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.binary()), pa.array([node] * len(part), pa.binary())], names=["key", "node"]
                    )

    return words.select("node", "word").mapInArrow(run, "key binary, node binary")


def near_long(words: DataFrame) -> DataFrame:
    """`near_in_groups` for words beyond `LONG`: a group has at most one word for each letter and one more."""
    long = words.where(F.length("word") >= LONG).withColumn("node", F.unhex(F.sha2("word", 256)))
    members = F.collect_set("node").alias("members")
    groups = _long_keys(long).groupBy("key").agg(members).where(F.size("members") > 1)
    pairs = groups.select(F.explode("members").alias("node"), "members").select("node", F.explode("members").alias("other"))
    pairs = pairs.where("node <> other").distinct()
    own = long.select("node", "word")
    best = long.select(F.col("node").alias("other"), F.struct((-F.col("n")).alias("rank"), F.col("word").alias("near")).alias("best"))
    return pairs.join(own, "node").join(best, "other").select("word", F.lit(1).cast("long").alias("n_near"), "best")


def with_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Add n_near, form and form_n: the most frequent near word where it is at least `ratio` times as frequent."""
    near = near_in_groups(words.where(F.length("word") <= LONG)).unionByName(near_long(words))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.rank") >= F.col("n") * ratio
    return words.join(near, "word", "left").select(
        "word",
        F.when(common, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, -F.col("best.rank")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Add `root`, the last of a word's forms, or itself.

    Words are settled from the roots down, a step of forms in each round. A form is at least twice as frequent as its word, so
    there are no more rounds than bits in the largest count; and it is near to its words, so they are no hot key.
    """
    settled = written(formed.where("form IS NULL").withColumn("root", F.col("word")), "roots")
    below = formed.where("form IS NOT NULL")
    found = settled
    while True:
        above = settled.select(F.col("word").alias("form"), "root")
        settled = written(below.join(above, "form").select(*found.columns), "roots")
        if settled.isEmpty():
            return found
        found = found.unionByName(settled)


def variants(
    docs: DataFrame,
    shortest: int = 5,
    least: int = 3,
    ratio: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    typo_every: int | None = None,
) -> DataFrame:
    """(word, form, n, n_near, form_n, root) of all words with at least `least` occurrences."""
    counted = count_words(docs, shortest, id_col, text_col, typo_every)
    words = written(counted.where(F.col("n") >= least), "words")
    return with_roots(written(with_forms(words, ratio), "formed"))
