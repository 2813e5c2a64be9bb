from __future__ import annotations

import os
import random
import zlib

import pytest

from factloom.llm import toxicity
from factloom.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents, with_clashes

BENCH_DIR = "/root/testdata/sf0.1"
SCORER = toxicity.Scorer(toxicity.Model([("idiot", True, 1.0), ("vequ", False, 1.0)]))


def outputs(text):
    return {name: v for name, v in zip(toxicity.OUTPUTS, SCORER.features(text)) if v}


def test_clauses():
    assert outputs("What an idiot.") == {"insult": 1.0}
    assert outputs("You complete idiot.") == {"aimed insult": 1.0}
    assert outputs("not an idiot") == {"negated": 1.0}
    assert outputs("She said he is an idiot. Idiot!") == {"reported": 1.0, "insult": 1.0}
    assert outputs("never; idiot") == {"insult": 1.0}
    assert outputs("idiot that you are") == {"insult": 1.0, "late target": 1.0}
    assert outputs("kill the process") == {"threat": 1.0}
    assert outputs("we know him and kill it") == {"aimed threat": 1.0}
    assert outputs("vequoir idiots prevequ") == {"insult": 1.0}


def test_elided_beginnings():
    assert outputs("c'est l'idiot") == outputs("c'est un idiot") == {"insult": 1.0}
    assert outputs("d’idiot d'idiot") == {"insult": 2.0}
    assert outputs("you're an idiot") == outputs("t'es idiot") == {"aimed insult": 1.0}
    assert outputs("isn't idiot") == {"negated": 1.0}
    assert outputs("can't idiot") == {"insult": 1.0}
    assert SCORER.score("idiot " * 40) > SCORER.score("idiot " * 39) > SCORER.score("idiot " * 12)


def plain_outputs(words):
    """What the grammar says of one clause, by looking around each term."""
    out = {}
    negated = lambda i: any(w == "not" for w in words[max(0, i - 3) : i])
    said = [i for i, w in enumerate(words) if w in ("said", '"')]
    last_target, last_term = -99, -99
    for i, word in enumerate(words):
        if word == "you":
            if i - last_term <= 4:
                out["late target"] = out.get("late target", 0) + 1.0
                last_term = -99
            last_target = i
        elif word in ("idiot", "kill"):
            if negated(i):
                name = "negated"
            elif said and said[0] < i:
                name = "reported"
            else:
                name = {"idiot": "insult", "kill": "threat"}[word]
                last_term = i
                if i - last_target <= 4:
                    name, last_target = "aimed " + name, -99
            out[name] = out.get(name, 0) + 1.0
    return out


def test_equals_a_plain_reading_of_clauses():
    rng = random.Random(6)
    seen = set()
    for _ in range(3000):
        words = [rng.choice(["idiot", "kill", "you", "not", "said", "a", "b", "c", "d"]) for _ in range(rng.randrange(1, 12))]
        got, expected = outputs(" ".join(words)), plain_outputs(words)
        assert got == expected, words
        seen |= set(got)
    assert seen == set(toxicity.OUTPUTS)


def test_scores_order():
    scores = [SCORER.score(t) for t in ("you idiot", "idiot", "nothing", "not an idiot")]
    assert scores == sorted(scores, reverse=True)


def test_compose_is_one_after_the_other():
    negated, reported = toxicity._scope("N", 2, {"I": "i"}), toxicity._reported()
    both = negated.compose(reported, toxicity._LABELS)
    for text in ("NIOOI", "RNII", "QOOI", "NNOI", "IRI"):
        one = two = state = 0
        for label in text:
            one, middle = negated.step(one, label)
            two, expected = reported.step(two, middle)
            state, got = both.step(state, label)
            assert got == expected


def test_odd_rows(spark):
    rows = [*ODD, (30, "you idiot"), (31, None)]
    labels = spark.createDataFrame([(30, None), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    docs = with_clashes(documents(spark, rows))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    best = max(got, key=lambda r: r["score"])
    assert best["doc_id"] == 30
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(BENCH_DIR), reason="test tables are not here")
def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BENCH_DIR}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, BENCH_DIR).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
