"""The pipeline on planted documents: what every stage keeps, against plain versions."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from factloom.llm import pieces, queries, shared
from tests.llm.helpers import DOCS
from tests.llm.test_nearcopies import changed, plain_kept

STAGES = dict(corpus_pipeline.STAGES)


def words(rng, n):
    return [f"{rng.choice('bdgklmnprstvz')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randrange(10**5)}" for _ in range(n)]


def toxic(rng):
    text = words(rng, 40)
    text[20:20] = rng.choice(["you are a total blorg", "he is such a blorg", "shut up you frinkel"]).split()
    return " ".join(text)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Rows by kind: toxic ones (two thirds labelled), exact copies, near copies from 0.8 on, clean ones and unrelated versions."""
    rng = random.Random(11)
    rows, kinds, labels = [], {}, []

    def add(kind, text):
        doc_id = len(rows)
        rows.append((doc_id, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), len(text)))
        kinds[doc_id] = kind
        return doc_id

    for i in range(90):
        doc_id = add("toxic", toxic(rng))
        if i % 3:
            labels.append((doc_id, 0, 1))
    for i in range(200):
        doc_id = add("clean", " ".join(words(rng, rng.choice([30, 80, 200]))))
        if i % 2:
            labels.append((doc_id, 1, 0))
    for i in range(20):
        text = rows[90 + i][1]
        for _ in range(rng.choice([1, 2, 5])):
            add("exact", text)
    for i in range(30):
        base = rows[rng.randrange(120, 280)][1].split()
        if len(base) < 60:
            continue
        low = [0.8, 0.85, 0.9, 0.6][i % 4]
        add("near" if low >= 0.8 else "version", " ".join(changed(rng, base, low, 0.78 if low == 0.6 else low + 0.06)))
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, kinds


def test_every_stage(spark, planted):
    folder, rows, kinds = planted
    texts = {r[0]: r[1] for r in rows}
    docs, kept = queries.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, folder), "stage")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    # Toxic documents go, labelled or not, and no other.
    assert kept["toxicity"] == {i for i, k in kinds.items() if k != "toxic"}
    # Of equal texts the largest id stays.
    last = {}
    for i in sorted(kept["toxicity"]):
        last[texts[i]] = i
    assert kept["exact dedup"] == set(last.values())
    # Of similar texts the smallest id stays; versions below the threshold stay too.
    left = [(i, texts[i]) for i in sorted(kept["exact dedup"])]
    assert kept["near dedup"] == set(plain_kept(left))
    assert any(kinds[i] == "near" for i in kept["exact dedup"] - kept["near dedup"])
    assert {i for i, k in kinds.items() if k == "version"} <= kept["near dedup"]
    # Mixing keeps a part, and pieces all of it, with texts that read back.
    assert kept["mixing"] < kept["near dedup"] and len(kept["mixing"]) > 0.75 * len(kept["near dedup"])
    assert kept["pieces"] == kept["mixing"]
    assert all(r["round_trip"] for r in docs.collect())


def test_pieces_are_those_of_the_model(spark, planted):
    sentencepiece = pytest.importorskip("sentencepiece")
    folder, _, _ = planted
    model = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes(queries.PIECES))
    docs = queries.table(spark, folder, "documents").limit(20)
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in STAGES["pieces"](spark, docs.where(docs["doc_id"].isin(*given)), folder).collect():
        assert list(row["ids"]) == model.encode(given[row["doc_id"]])


def test_run_is_the_stages_in_a_row(spark, planted):
    folder, _, _ = planted
    docs = queries.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, folder), "stage")
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.collect(), key=str) == sorted(docs.collect(), key=str)
