"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. A binary classifier per column tells the languages with +1 there from those
with -1, by the log-likelihood ratio of a text's letter grams (one to three letters, word ends included). Up to six languages
take all columns that split them; more take rows of a Hadamard matrix of at least twice their number, so that any two words
differ in half of their columns and wrong bits are corrected. Decoding is loss-weighted: a codeword's distance is the
exponential loss of all bits against it, each weighted by how often that classifier is right for that language.

Grams are counted over all learning rows, into `BUCKETS` hash buckets. What reaches the driver, and goes to every task, is at
most one number for each bucket and language, and one weight for each bucket and column.

Edge cases: letters are what Unicode calls so, compared in lower case. A null text, and one without letters, is `und` with score
0, and so is every text where no language was learned. One learned language is the answer for all others, with score 1. A row
without id is not held out. Rows of any number and order of repeats are each learned from and answered; a text of any length is read
whole, in blocks. Ties go to the language first in code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Beyond the last code point that is a letter.
_LAST = 0x3FFFF
_BLOCK = 1 << 17
_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.arange(3, dtype=np.uint64) << np.uint64(40)
#: Grams by which the margin of a short text is drawn to zero.
_SHORT = 20
#: How sharply distances between codewords turn into scores.
_SHARP = 4.0
#: Below this lead over the next codeword, in units of the largest possible one, a text is ambiguous.
_LEAD = 0.25


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what is no letter."""
    table = np.zeros(_LAST + 1, np.uint32)
    for point in range(_LAST):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one 0 for what is between words, and the text each belongs to. Texts begin with 0."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = "\0" + "\0\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(points, _LAST)]
    ids = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[np.cumsum(lengths) - lengths] = True
    return codes[keep], ids[keep]


def gram_blocks(codes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(text of each position, buckets of the one, two and three letters from there); `BUCKETS` where there is no such gram."""
    codes = np.concatenate((codes.astype(np.uint64), np.zeros(2, np.uint64)))
    ids = np.concatenate((ids, np.full(2, -1, ids.dtype)))
    for at in range(0, len(codes) - 2, _BLOCK):
        n = min(_BLOCK, len(codes) - 2 - at)
        own, hashed, found = ids[at : at + n], np.zeros(n, np.uint64), []
        for order in range(3):
            hashed = hashed * _FACTOR + codes[at + order : at + order + n]
            there = ids[at + order : at + order + n] == own if order else codes[at : at + n] != 0
            found.append(np.where(there, ((hashed + _ORDERS[order]) * _MIX) >> np.uint64(48), BUCKETS).astype(np.int32))
        yield own, found


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a block together; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > _BLOCK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        columns = 2 ** (languages - 1) - 1
        bits = (np.arange(1, columns + 1)[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits == 1, 1.0, -1.0)
    order = 32
    while order < 2 * languages:
        order *= 2
    # Powers of two first: no two columns then split the languages alike.
    rows = sorted(range(1, order), key=lambda i: (i & (i - 1) != 0, i))[:languages]
    odd = np.array([bin(x).count("1") & 1 for x in range(order)])[np.array(rows)[:, None] & np.arange(1, order)[None, :]]
    return np.where(odd == 1, -1.0, 1.0)


@dataclass
class Model:
    """Languages, their codewords, the weight of each bucket per column, the usual margin of a gram, and how right bits are."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def ratios(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the log-likelihood ratio of each column, and the number of its grams; none without letters."""
    sums, grams = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for start, end in _batches(texts):
        codes, ids = letter_codes(texts[start:end])
        for own, found in gram_blocks(codes, ids):
            firsts = np.flatnonzero(np.diff(own, prepend=-1))
            here = own[firsts] + start
            sums[here] += np.add.reduceat(weights[found[0]] + weights[found[1]] + weights[found[2]], firsts, axis=0)
            grams[here] += np.add.reduceat(sum((f < BUCKETS).astype(np.int64) for f in found), firsts)
    return sums, grams


def decode(model: Model, sums: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the place of the nearest codeword, its score, and whether another one is about as near."""
    margins = np.tanh(1.5 * sums / ((grams + _SHORT)[:, None] * model.scale))
    losses = np.exp(-margins[:, None, :] * model.code[None, :, :])
    distances = (losses * model.trust[None, :, :]).sum(axis=2)
    best = distances.argmin(axis=1)
    shares = np.exp(-_SHARP * (distances - distances.min(axis=1, keepdims=True)))
    if len(model.languages) == 1:
        return best, np.ones(len(best)), np.zeros(len(best), bool)
    nearest = np.partition(distances, 1, axis=1)
    return best, 1 / shares.sum(axis=1), nearest[:, 1] - nearest[:, 0] < _LEAD * _widest(model)


def _widest(model: Model) -> float:
    """The lead of a codeword that all bits agree on, over the next one."""
    apart = ((model.code[:, None, :] != model.code[None, :, :]) * model.trust[None, :, :]).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    return float(apart.min() * (np.e - 1 / np.e))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(texts, langs):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for start, end in _batches(own):
                for _, found in gram_blocks(*letter_codes(own[start:end])):
                    for buckets in found:
                        total += np.bincount(buckets, minlength=BUCKETS + 1)
    for lang, total in counts.items():
        seen = np.flatnonzero(total[:BUCKETS])
        columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


def _bit_counts(languages: list[str], code: np.ndarray, weights: np.ndarray):
    """How often each bit is right for each language, and how large its ratio is per gram."""
    place = {lang: i for i, lang in enumerate(languages)}
    names = ["lang", "bit", "right", "n", "size", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = code.shape
        right, size = np.zeros(shape, np.int64), np.zeros(shape)
        rows, total = np.zeros(shape[0], np.int64), np.zeros(shape[0])
        for batch in batches:
            langs = batch.column(1).to_pylist()
            # A language whose every text is without letters was not learned.
            known = [i for i, lang in enumerate(langs) if lang in place]
            texts = batch.column(0).take(pa.array(known, pa.int64())).to_pylist()
            sums, grams = ratios(texts, weights)
            at = np.array([place[langs[i]] for i in known], np.int64)
            read = grams > 0
            np.add.at(right, at[read], (sums[read] * code[at[read]] > 0).astype(np.int64))
            np.add.at(size, at[read], np.abs(sums[read]))
            np.add.at(rows, at[read], 1)
            np.add.at(total, at[read], grams[read])
        lang, bit = np.indices(shape).reshape(2, -1)
        columns = [lang, bit, right.ravel(), rows[lang], size.ravel(), total[lang]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows with a text and a language."""
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_gram_counts, "lang string, bucket int, n long")
    # At most BUCKETS rows for each language.
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column("lang").to_pylist()
    languages = sorted(set(langs))
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    at = np.fromiter((place[x] for x in langs), np.int64, len(langs))
    counts[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    code = codewords(len(languages))
    # Languages weigh alike within a side, however many rows they have.
    shares = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    seen = counts.sum(axis=0) > 0
    for bit in range(code.shape[1]):
        sides = [shares[code[:, bit] == sign] for sign in (1, -1)]
        if all(len(s) for s in sides):
            weights[:BUCKETS, bit] = np.where(seen, np.log(sides[0].mean(axis=0) / sides[1].mean(axis=0)), 0)
    if len(languages) < 2:
        return Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape))
    kinds = "lang long, bit long, right long, n long, size double, grams double"
    judged = rows.mapInArrow(_bit_counts(languages, code, weights), kinds)
    # One row for each language and column.
    judged = judged.groupBy("lang", "bit").agg(*(F.sum(c).alias(c) for c in ("right", "n", "size", "grams")))
    found = np.zeros((4, *code.shape))
    for r in judged.collect():
        found[:, r["lang"], r["bit"]] = r["right"], r["n"], r["size"], r["grams"]
    right, n, size, grams = found
    trust = (right + 1) / (n + 2)
    scale = (size / np.maximum(grams, 1)).mean(axis=0)
    return Model(languages, code, weights, np.maximum(scale, 1e-9), trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns, lang_pred, score and ambiguous, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            named, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if model.languages and texts:
                sums, grams = ratios(texts, model.weights)
                best, sure, close = decode(model, sums, grams)
                for i in np.flatnonzero(grams > 0):
                    named[i], scores[i], unsure[i] = model.languages[best[i]], sure[i], close[i]
            columns = [pa.array(named, pa.string()), pa.array(scores), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *columns], names=[*keep, "lang_pred", "score", "ambiguous"]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
