from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white texts, repeated rows, a repeated id, a null id, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two"),
    (4, "one two"),
    (5, "one two"),
    (5, "another text under the same id"),
    (None, "one two"),
    (None, None),
    (6, "long " * 20000),
    (7, "Ünïcode ✓ \U0001f4a9 text"),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], DOCS)


def with_clashes(df):
    """Further columns under names that operators use inside."""
    for name in ("id", "row", "key", "digest", "_text", "_id", "fingerprint", "n", "weight", "tokens", "gone", "ids"):
        df = df.withColumn(name, df[df.columns[0]])
    return df
