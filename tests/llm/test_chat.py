from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
PARTS = ["\\", "\\\\", "### ", "###", "</turn>", "<next/>", ": ", "\n", "\\e", "\\h", "user", "Assistant", "é", "</tu", "#", "<"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


def turns_of(spark, rows):
    df = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("turns", chat.F.lit(1))))
    return {r["conv_id"]: r for r in df.collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "=user", "a: b", "User", ""]), TEXTS), min_size=1, max_size=60))
def test_round_trip(spark, turns):
    rows = [(i // 4, i, role, text) for i, (role, text) in enumerate(turns)]
    got = turns_of(spark, rows)
    for conv in {r[0] for r in rows}:
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        loss = "".join(s["text"] for s in got[conv]["segments"] if s["loss"])
        assert loss == "".join(escaped(t) for role, t in own if role == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]


def escaped(text):
    for plain, code in chat._CODES.items():
        text = text.replace(plain, code)
    return text


def test_odd_rows(spark):
    rows = [
        (1, 2, "assistant", None),
        (1, 1, "user", "b"),
        (1, 1, "user", "a"),
        (1, 1, "user", "a"),
        (1, None, None, "first"),
        (None, 1, "user", "nobody's"),
        (2, 0, "user", "long " * 20000),
    ]
    got = turns_of(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [
        ("", "first"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", ""),
    ]
    assert [b["role"] for b in got[1]["blocks"]] == ["", "user", "assistant"]
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "nobody's")]
    assert got[2]["turns"][0]["text"] == "long " * 20000
    assert turns_of(spark, []) == {}
