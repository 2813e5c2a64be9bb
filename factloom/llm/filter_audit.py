"""Filter interaction audit: what each quality filter removes in every order of the filters.

Documents are reduced to cells, one per part and set of failed filters (a bit mask), so a part of any size is at most
2^filters rows. A Gray-code walk over the subsets of filters then toggles one filter at a time: every cell keeps the number of
active filters it fails, survivors change where that number leaves or reaches zero, and the survivors of each subset are
stored. A step of an order is the difference of two stored states.

Edge cases: a null text is empty, a null part is the empty string. A row is a document, so repeated rows count as often as
they occur; rows that share text and id do not make each other copies. A row without id is never a copy and has no labels.
Of repeated labels any that says 1 counts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written

#: What a word is not made of.
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_PARTS_AT_ONCE = 64


def judged(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, digest, and a boolean for each failure condition but that of copies)."""
    texts = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    # The words in a projection of their own: Catalyst keeps what is read more than once apart.
    worded = texts.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    points = F.length("text")
    return worded.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < 200).alias("A"),
        (F.size(F.array_distinct("words")) * 100 < F.size("words") * 50).alias("B"),
        ((points - F.length(F.translate("text", CAPITALS, ""))) * 100 > points * 2).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """Add `E`, a text that a smaller id has too, and merge equal rows into one with their number `n`.

    Rows meet the first id of their text under (id, text), so a text that a third of all rows share is no hot key.
    """
    conditions = [c for c in rows.columns if c not in ("doc_id", "part", "digest")]
    merged = rows.groupBy("doc_id", "part", "digest", *conditions).agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = merged.join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    return marked.withColumn(COPY, F.col("first").isNull() & F.col("doc_id").isNotNull()).drop("first")


def cells(rows: DataFrame, labels: DataFrame, filters: str, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit i of the mask is filter i."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("doc_id"))
    marks = marks.agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    # Rows without id need no label; joined, they would all meet in one task.
    unknown = rows.where("doc_id IS NULL").withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    mask = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    every = known.unionByName(unknown).withColumn("mask", mask)
    marked = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), marked("good").alias("good"), marked("toxic").alias("toxic")
    )


def gray_walk(counted: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; `counted` has a row (documents, good, toxic) for each mask of failed filters."""
    subsets = len(counted)
    masks = np.arange(subsets)
    failing = np.zeros(subsets, np.int64)
    kept = counted.sum(axis=0)
    states = np.empty_like(counted)
    states[0] = kept
    subset = 0
    for step in range(1, subsets):
        toggled = step & -step
        subset ^= toggled
        touched = (masks & toggled) > 0
        if subset & toggled:
            kept = kept - counted[touched & (failing == 0)].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            kept = kept + counted[touched & (failing == 0)].sum(axis=0)
        states[subset] = kept
    return states


def steps(counted: np.ndarray, filters: str) -> dict[str, list]:
    """One row per order of the filters and step, with the `COUNTS`."""
    states = gray_walk(counted)
    everything = len(counted) - 1
    bits = {f: 1 << i for i, f in enumerate(filters)}
    fails = {f: int(states[0, 0] - states[b, 0]) for f, b in bits.items()}
    alone = {f: int(states[everything ^ b, 0] - states[everything, 0]) for f, b in bits.items()}
    shapley = dict.fromkeys(filters, 0)
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", *COUNTS)}
    order_letters = []
    for order in permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | bits[letter]
            removed, good, toxic = (states[before] - states[after]).tolist()
            shapley[letter] += removed
            row = ("".join(order), step, int(states[after, 0]), removed, fails[letter] - removed, alone[letter], good, toxic)
            for column, value in zip(("filter_order", "step", *COUNTS[:-1]), row):
                out[column].append(value)
            order_letters.append(letter)
            before = after
    out["shapley"] = [shapley[letter] for letter in order_letters]
    return out


def audit_cells(found: DataFrame, filters: str) -> DataFrame:
    """The audit of each part: (part, filter_order, step, and `COUNTS`) from its cells."""
    # At most 2^filters rows a part.
    packed = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    names = ["part", "filter_order", "step", *COUNTS]
    kinds = [pa.string(), pa.string(), pa.int32(), *([pa.int64()] * len(COUNTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PARTS_AT_ONCE):
                columns: dict[str, list] = {c: [] for c in names}
                for row in batch.slice(at, _PARTS_AT_ONCE).to_pylist():
                    counted = np.zeros((1 << len(filters), 3), np.int64)
                    for cell in row["cells"]:
                        counted[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                    rows = steps(counted, filters)
                    columns["part"] += [row["part"]] * len(rows["step"])
                    for column, values in rows.items():
                        columns[column] += values
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in zip(names, kinds)], names=names)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return packed.mapInArrow(run, f"part string, filter_order string, step int, {counts}")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The audit of the filters A (short), B (repetitive), C (capitals), D (symbols) and E (copies) in every part."""
    rows = with_copies(written(judged(docs, part_col, id_col, text_col), "judged"))
    return audit_cells(cells(rows, labels, "ABCDE", id_col), "ABCDE")
