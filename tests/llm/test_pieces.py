from __future__ import annotations

import math
import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pieces
from factloom.llm.queries import PIECES, in_pieces
from tests.llm.helpers import ODD, documents, with_clashes

needs_model = pytest.mark.skipif(not os.path.isfile(PIECES), reason="no model file here")
ALPHABET = list("ab cdeéñ▁\n\t日本語'.,!123  ") + ["the", "ing", "<0x0A>", "</s>", "\U0001f4a9", "   "]


@pytest.fixture(scope="module")
def pair():
    sentencepiece = pytest.importorskip("sentencepiece")
    return pieces.PieceModel(pieces.model_bytes(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@needs_model
@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_as_the_library(pair, text):
    model, library = pair
    ids = model.encode(text).tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)


@needs_model
def test_long_words(pair):
    model, library = pair
    for text in ["abc" * 3000, "日本語" * 400, "a" * 1000, "x" * 63 + "é" * 63, " " * 500]:
        assert model.encode(text).tolist() == library.encode(text)


@needs_model
def test_tables_grow_old(pair):
    model = pieces.PieceModel(pieces.model_bytes(PIECES))
    model.kept.most = model.last.most = model.beside.most = 3
    text = "some words come back, some words do not come back " * 3
    assert model.encode(text).tolist() == pair[1].encode(text)


@needs_model
def test_odd_rows(spark, pair):
    rows = in_pieces(with_clashes(documents(spark, ODD)).drop("ids"), ["doc_id", "text"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == pair[1].encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert in_pieces(documents(spark, []), ["doc_id"]).count() == 0
    data = pieces.model_bytes(PIECES)
    again = pieces.decode(pieces.encode(documents(spark, ODD), data, ["text"]), data, ["text"]).collect()
    assert len(again) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in again)


def field(number, value):
    if isinstance(value, int):
        return bytes([*varint(number << 3), *varint(value)])
    return bytes([*varint(number << 3 | 2), *varint(len(value))]) + value


def varint(n):
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return [*out, n]


def model_file(scores, kind, fallback):
    """A model written by hand: no tokenizer is trained."""
    out = field(1, field(1, b"<unk>") + field(3, 2))
    for text, score in scores.items():
        out += field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score))
    for b in range(256) if fallback else ():
        out += field(1, field(1, b"<0x%02X>" % b) + field(3, 6))
    return out + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(3, 1) + field(4, 0))


@settings(max_examples=100, deadline=None)
@given(st.text("abc d", max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=3), st.floats(-9, -1), max_size=8))
def test_unigram_is_the_best_path(text, scores):
    scores = {k: struct.unpack("<f", struct.pack("<f", v))[0] for k, v in scores.items()} | {"▁": -2.0}
    model = pieces.PieceModel(model_file(scores, 1, False))
    normal = ("▁" if text else "") + text.replace(" ", "▁")
    worst = min(scores.values()) - 10

    def best(rest):
        if not rest:
            return 0.0
        tries = [scores.get(rest[0], worst) + best(rest[1:])]
        tries += [scores[rest[:k]] + best(rest[k:]) for k in (2, 3) if rest[:k] in scores and len(rest) >= k]
        return max(tries)

    by_id = {1 + i: v for i, v in enumerate(scores.values())}
    assert math.isclose(sum(by_id.get(i, worst) for i in model.encode(text).tolist()), best(normal), abs_tol=1e-6)


def test_other_character_maps_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(field(3, field(2, b"x")))
