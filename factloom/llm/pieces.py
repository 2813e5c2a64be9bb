"""SentencePiece encoding and decoding as a shortest path in a composed weighted transducer.

A model file is compiled into three transducers: the normaliser (white space to its mark, a mark in front), the
pieces (text to ids) and byte fallback (a character no piece begins with to the ids of its bytes). They are
composed with each input on the fly, and the path of least weight over (min, +) is the encoding.

- Unigram models: an arc weighs minus its score.
- BPE models: greedy merging keeps two pieces side by side just when it leaves their concatenation, merged alone,
  as these two; and a sequence whose neighbours all pass this test is what merging gives. So arcs weigh nothing, and
  a further transducer, whose states are the last piece, gives infinite weight to neighbours that merging would
  not leave. Its arcs are found when first met, and kept.

Where no piece continues over a mark that follows another character, words are composed one by one, and results of
frequent short words are kept, in tables of bounded size.

Only the identity character map is compiled; a model with another, or with user-defined pieces, is refused.

Edge cases: a null or empty text gives no ids; ids null or empty give an empty text. A mark written in a text reads
back as a space. A text of any length is encoded whole. Repeated rows are encoded each; an empty table gives an
empty result; columns not named are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
_KEPT = 1 << 18
_ROWS = 256
_LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class _Kept(dict):
    """Results of a function. When there are too many, they grow old, and old ones not asked for again go."""

    def __init__(self, make, most: int = _KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _LONG:
            self[key] = value
        return value


class PieceModel:
    """A compiled model; made once per worker from the bytes of its file."""

    def __init__(self, data: bytes):
        fields = list(_fields(data))
        trainer = dict(next((f for n, f in ((n, list(_fields(v))) for n, v in fields if n == 2)), []))
        rules = dict(next((f for n, f in ((n, list(_fields(v))) for n, v in fields if n == 3)), []))
        if rules.get(2):
            raise ValueError("only the identity character map is supported")
        self.kind = trainer.get(3, _UNIGRAM)
        self.fallback = bool(trainer.get(35, 0))
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes: dict[int, int] = {}
        self.table: list[bytes] = []
        self.unknown = 0
        for number, (_, value) in enumerate(f for f in fields if f[0] == 1):
            piece = dict(_fields(value))
            text, kind = piece.get(1, b"").decode(), piece.get(3, _NORMAL)
            self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            self.table.append(b"")
            if kind == _USER:
                raise ValueError("user-defined pieces are not supported")
            if kind == _NORMAL:
                self.ids[text] = number
                self.table[-1] = text.replace(MARK, " ").encode()
            elif kind == _BYTE:
                self.bytes[int(text[3:5], 16)] = number
                self.table[-1] = bytes([int(text[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown = number
                self.table[-1] = " ⁇ ".encode()
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.longest = max(map(len, self.ids), default=1)
        # The longest piece that ends in three characters.
        self.reach: dict[str, int] = {}
        for text in self.ids:
            self.reach[text[-3:]] = max(len(text), self.reach.get(text[-3:], 0))
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.words = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.kept = _Kept(self._shortest if self.kind == _UNIGRAM else self._stable)
        self.beside = _Kept(lambda pair: self._merged(pair[0] + pair[1]) == [p for p in pair if p])
        self.last = self._last_piece()

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def _emit(self, piece: str) -> tuple[int, ...]:
        """The output of an arc: a piece's id, or byte fallback, or the unknown id."""
        number = self.ids.get(piece)
        if number is not None:
            return (number,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.fallback else (self.unknown,)

    def _arcs(self, text: str, end: int) -> Iterator[str]:
        """Pieces and single characters that end at a position."""
        for start in range(max(0, end - self.longest), end):
            piece = text[start:end]
            if start == end - 1 or piece in self.ids:
                yield piece

    def _shortest(self, text: str) -> tuple[int, ...]:
        best: list[tuple[float, str]] = [(0.0, "")]
        for end in range(1, len(text) + 1):
            weight = lambda p: -self.scores[self.ids[p]] if p in self.ids else -self.worst
            best.append(min(((best[end - len(p)][0] + weight(p), p) for p in self._arcs(text, end)), key=lambda x: x[0]))
        path, end = [], len(text)
        while end:
            path.append(best[end][1])
            end -= len(path[-1])
        return tuple(chain.from_iterable(map(self._emit, reversed(path))))

    def _last_piece(self):
        """A function for the last piece of the one path of finite weight over a text: the one that fits what is before.

        It depends on the text alone, so words that begin alike share all they have found.
        """
        ids, reach, beside = self.ids, self.reach.get, self.beside

        def find(text: str) -> str:
            n = len(text)
            for start in range(n - min(n, reach(text[-3:], 2)), n):
                piece = text[start:]
                if piece in ids or start == n - 1:
                    if beside[last[text[:start]] if start else "", piece]:
                        return piece
            raise ValueError("no path")

        last = _Kept(find)
        return last

    def _stable(self, text: str) -> tuple[int, ...]:
        if len(text) > _LONG:
            return self._long(text)
        ids, last, path = self.ids.get, self.last, []
        while text:
            piece = last[text]
            number = ids(piece)
            if number is None:
                path.extend(reversed(self._emit(piece)))
            else:
                path.append(number)
            text = text[: -len(piece)]
        path.reverse()
        return tuple(path)

    def _long(self, text: str) -> tuple[int, ...]:
        """The same path, by place: for what is too long to keep by its text."""
        last = [""]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                if (piece in self.ids or start == end - 1) and self.beside[last[start], piece]:
                    last.append(piece)
                    break
        path, end = [], len(text)
        while end:
            path.append(last[end])
            end -= len(path[-1])
        return tuple(chain.from_iterable(map(self._emit, reversed(path))))

    def _merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best pair first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            joined = (self.ids.get(a + b) for a, b in zip(parts, parts[1:]))
            pairs = [(-self.scores[n], i) for i, n in enumerate(joined) if n is not None]
            if not pairs:
                break
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode(self, text: str | None) -> np.ndarray:
        words = self.words.findall(self.normal(text or ""))
        return np.fromiter(chain.from_iterable(map(self.kept.__getitem__, words)), np.int32)

    def decode(self, ids: list | np.ndarray | None) -> str:
        text = b"".join(map(self.table.__getitem__, () if ids is None else ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model_bytes(path: str) -> bytes:
    """The driver reads the model once; tasks get its bytes (a vocabulary, whatever the documents)."""
    with open(path, "rb") as file:
        return file.read()


_MODELS: dict[bytes, PieceModel] = {}


def _task_model(shared) -> PieceModel:
    """The model of this worker: what it has kept serves the next task as well."""
    if shared.value not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.value] = PieceModel(shared.value)
    return _MODELS[shared.value]


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode(
    docs: DataFrame, data: bytes, keep: list[str], text_col: str = "text", read_back: bool = False
) -> DataFrame:
    """`keep` columns and `ids`, for every row; with `read_back` also `decoded`, read from the ids at once."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _task_model(shared)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                found = [model.encode(t) for t in batch.column(len(keep)).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                columns, names = [*batch.columns[: len(keep)], ids], [*keep, "ids"]
                if read_back:
                    columns.append(pa.array([model.decode(f.tolist()) for f in found], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(*keep, docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"{_kinds(docs, keep)}ids array<int>" + ", decoded string" * read_back)


def decode(rows: DataFrame, data: bytes, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """`keep` columns and `decoded`, for every row."""
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _task_model(shared)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = [model.decode(ids) for ids in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "decoded"]
                )

    chosen = rows.select(*keep, rows[ids_col].alias("_ids"))
    return chosen.mapInArrow(run, f"{_kinds(rows, keep)}decoded string")
