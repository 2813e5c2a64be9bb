from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import language
from factloom.llm.queries import QUERIES
from tests.llm.helpers import ODD, SF_DIR, documents, with_clashes

WORDS = {
    "en": "the of and thing with reading that from house street".split(),
    "de": "der die und nicht haus straße über können heit schaft".split(),
    "fr": "le la et pas maison être où façon déjà tion".split(),
    "sv": "och att det inte gård över på är från hus".split(),
    "el": "και το της δεν σπίτι δρόμος είναι από με για".split(),
    "ja": "東京 です ます これ それ 家 道 から まで 日本".split(),
    "pl": "nie jest się dom ulica który być przez żeby może".split(),
}


def corpus(rng, n, langs=tuple(WORDS)):
    rows = []
    for i in range(n):
        lang = langs[i % len(langs)]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([4, 30, 200]))), lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def answers(df):
    return [(r["lang_pred"], r["score"], r["ambiguous"]) for r in df.orderBy("doc_id").collect()]


def plain_grams(text):
    """Counts of (letters) of one to three positions, words apart by one space."""
    letters = [c.lower()[0] if c.isalpha() else " " for c in text]
    line = [" "]
    for c in letters:
        if c != " " or line[-1] != " ":
            line.append(c)
    if line[-1] != " ":
        line.append(" ")
    found = Counter()
    for i in range(len(line)):
        for order in (1, 2, 3):
            gram = tuple(line[i : i + order])
            if len(gram) == order and gram != (" ",):
                found[gram] += 1
    return found


@pytest.mark.parametrize("block", [3, 64, 1 << 17])
def test_grams_do_not_depend_on_blocks_and_neighbours(block, monkeypatch):
    monkeypatch.setattr(language, "_BLOCK", block)
    texts = ["Straße, straße!", "", "...", "a", "a b", "ÀÉ 東京\U00020000 x", "abc" * 50, " abc  abc "]
    found = [Counter() for _ in texts]
    for start, end in language._batches(texts):
        for own, buckets in language.gram_blocks(*language.letter_codes(texts[start:end])):
            for row in buckets:
                for i, b in zip(own.tolist(), row.tolist()):
                    if b < language.BUCKETS:
                        found[i + start][b] += 1
    for text, got in zip(texts, found):
        plain = plain_grams(text)
        assert sorted(got.values()) == sorted(plain.values()), text
        # The same gram is the same bucket in every text.
        alone = Counter()
        for _, buckets in language.gram_blocks(*language.letter_codes([text])):
            for row in buckets:
                alone.update(b for b in row.tolist() if b < language.BUCKETS)
        assert alone == got


@pytest.mark.parametrize("languages", [2, 3, 4, 6, 7, 15, 16, 40])
def test_codewords_are_far_apart(languages):
    code = language.codewords(languages)
    assert code.shape[0] == languages
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1] and all(len(set(c)) == 2 for c in columns)
    distances = [(code[i] != code[j]).sum() for i in range(languages) for j in range(i)]
    assert min(distances) >= code.shape[1] / 2


@pytest.mark.parametrize("languages", [4, 7, 20])
def test_wrong_bits_are_corrected_and_flagged(languages):
    code = language.codewords(languages)
    apart = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
    model = language.Model([f"l{i:02}" for i in range(languages)], code, None, np.ones(code.shape[1]), np.ones(code.shape) / code.shape[1])
    sums, grams = code * 1e4, np.full(languages, 1e3)
    best, clean, close = language.decode(model, sums, grams)
    assert best.tolist() == list(range(languages)) and not close.any()
    wrong = sums.copy()
    wrong[:, : (apart - 1) // 2] *= -1
    best, score, _ = language.decode(model, wrong, grams)
    assert best.tolist() == list(range(languages)) and (score < clean).all()
    _, score, close = language.decode(model, sums * 0, grams)
    assert close.all() and np.allclose(score, 1 / languages)


def test_trust_decides_between_contradicting_bits():
    code = language.codewords(3)
    trust = np.array([[0.9, 0.05, 0.05]] * 3)
    model = language.Model(["a", "b", "c"], code, None, np.ones(3), trust)
    for row in range(3):
        best, _, _ = language.decode(model, code[[row]] * [1e4, -1e4, 1e4], np.array([1e3]))
        assert code[best[0], 0] == code[row, 0]


def test_learns_seven_languages(spark):
    rng = random.Random(1)
    model = language.learn(table(spark, corpus(rng, 210)))
    assert model.languages == sorted(WORDS)
    unseen = corpus(rng, 140)
    got = answers(language.identify(table(spark, unseen), model, ["doc_id"]))
    right = [p == lang for (p, _, _), (_, _, lang) in zip(got, unseen)]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= s <= 1 for _, s, _ in got)
    mixed = " ".join(WORDS["en"] + WORDS["de"]) * 3
    (_, score, close), (_, sure, _) = answers(
        language.identify(table(spark, [(1, mixed, None), (2, " ".join(WORDS["en"]) * 6, None)]), model, ["doc_id"])
    )
    assert close and score < sure


def test_lang_and_ids_are_no_inputs(spark):
    rng = random.Random(2)
    rows = corpus(rng, 70)
    model = language.learn(table(spark, rows))
    plain = answers(language.identify(table(spark, rows), model, ["doc_id"]))
    turned = [(i, t, rng.choice([None, "en", "xx"])) for i, t, _ in rows]
    assert answers(language.identify(table(spark, turned), model, ["doc_id"])) == plain


def test_odd_rows(spark):
    docs = with_clashes(documents(spark, ODD)).withColumnsRenamed({"row": "bucket", "key": "score", "digest": "lang_pred"})
    rng = random.Random(3)
    model = language.learn(table(spark, [*corpus(rng, 40, ("en", "de")), (1, None, "de"), (2, "...", "xx"), (3, "a", None)]))
    assert model.languages == ["de", "en"]
    got = language.identify(docs, model, ["doc_id"]).collect()
    assert len(got) == len(ODD)
    silent = [r for r in got if r["lang_pred"] == "und"]
    assert sorted((r["doc_id"] or 0) for r in silent) == [0, 1, 2, 3] and all(r["score"] == 0 for r in silent)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 4}) == 1


def test_few_languages(spark):
    rows = table(spark, [(1, "one text", "en"), (2, "12 34", "de"), (3, None, "fr")])
    model = language.learn(rows)
    assert answers(language.identify(rows, model, ["doc_id"])) == [("en", 1.0, False), ("und", 0.0, True), ("und", 0.0, True)]
    nothing = language.learn(rows.limit(0))
    assert [a[0] for a in answers(language.identify(rows, nothing, ["doc_id"]))] == ["und"] * 3
    assert language.identify(rows.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op11_language_id"](spark, SF_DIR).collect()]
    assert len(rows) == len(langs)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 0.15 * len(rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
