from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import exact
from tests.llm.helpers import ODD, documents, with_clashes


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, top[t or ""], len(groups[t or ""]), i == top[t or ""]) for i, t in rows), key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


def test_odd_rows(spark):
    assert found(exact.exact_groups(with_clashes(documents(spark, ODD)))) == plain(ODD)


def test_texts_of_one_digest_stay_apart(spark):
    rows = [*ODD, (8, "a"), (9, "b"), (10, "a")]
    weak = lambda text: F.length(text).cast("string")
    assert found(exact.exact_groups(documents(spark, rows), digest=weak)) == plain(rows)


def test_kept_rows(spark):
    rows = exact.kept_rows(documents(spark, ODD)).collect()
    assert len(rows) == len({t or "" for _, t in ODD})
    assert {r["text"]: r["doc_id"] for r in rows}["one two"] == 5


def test_empty(spark):
    assert exact.exact_groups(documents(spark, [])).count() == 0
    assert exact.kept_rows(documents(spark, [])).count() == 0
