"""Admission and cleaning on small hand-made pages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import html as H
from factloom.operators.admit import admit
from factloom.operators.clean import clean_pages

ANY_SIZE = EngineConfig(min_file_bytes=0, min_raw_chars=0, min_clean_chars=0)
PAGE = "page_id bigint, url string, html string"


def cleaned(spark, html: str, cfg=ANY_SIZE):
    return clean_pages(spark.createDataFrame([(1, None, html)], PAGE), cfg).first()


@pytest.mark.parametrize(
    ("html", "left", "tags", "comments"),
    [
        ("<body><p>a</p><SCRIPT>x</SCRIPT></body>", "<body><p>a</p>", 1, 0),
        ("<body>a<!-- one\n two --><!-- three -->b</body>", "<body>ab", 0, 2),
        ("<body><svg w=1><path d='1'/><path d='2'/></svg>b</body>", "<body>b", 3, 0),
        ("<head><meta charset=x /><link rel=y></head><body>b", "<body>b", 2, 0),
        ("<p>no body</p><style>p{}</style>", "<p>no body</p>", 1, 0),
        ("<body>open end<p>", "<body>open end<p>", 0, 0),
        ("<body><script>var t='<!-- no comment';</script>b<!-- <script> in comment --></body>", "<body>b", 1, 1),
        ("<body><script>'<style>'</script>c</body>", "<body>c", 1, 0),
        ("<body>a<script>never closed", "<body>a", 1, 0),
        ("<body><svg/>kept<noscript><link href=x>y</noscript></body>", "<body>kept", 3, 0),
        ("<body><link-list>custom</link-list><scripty>x</scripty></body>",
         "<body><link-list>custom</link-list><scripty>x</scripty>", 0, 0),
        ("<body><iframe src=x></iframe>z</body>", "<body>z", 1, 0),
    ],
)
def test_noise(spark, html, left, tags, comments):
    row = cleaned(spark, html)
    assert (row.clean_html, row.removed_tags, row.removed_comments) == (left, tags, comments)


def test_inline_images_keep_other_attributes(spark):
    html = (
        '<body><img alt="a b" src="data:image/png;base64,AA==" width=3>'
        "<IMG SRC='data:image/gif;base64,BB'><img src=data:image/x;base64,CC id=q>"
        '<img data-src="data:image/png;base64,DD" src="/real.png"></body>'
    )
    row = cleaned(spark, html)
    assert row.base64_images_removed == 3
    assert '<img alt="a b" src="[BASE64_REMOVED]" width=3>' in row.clean_html
    assert "<IMG SRC=\"[BASE64_REMOVED]\">" in row.clean_html
    assert '<img src="[BASE64_REMOVED]" id=q>' in row.clean_html
    assert 'src="/real.png"' in row.clean_html


def test_json_ld_is_taken_before_scripts_go_and_bad_blocks_are_skipped(spark):
    html = (
        '<script type="application/ld+json"> {"@type":"Thing","n":1} </script>'
        "<script id=x type='application/ld+json'>{broken</script>"
        '<!-- <script type="application/ld+json">{"in":"comment"}</script> -->'
        "<script type=text/javascript>{}</script><body>text</body>"
    )
    row = cleaned(spark, html)
    assert row.json_ld == ['{"@type":"Thing","n":1}']
    assert row.removed_tags == 3 and row.removed_comments == 1
    assert "script" not in row.clean_html


@pytest.mark.parametrize(("size", "reason"), [(999, "too_small"), (1000, None)])
def test_size_counts_bytes(spark, size, reason):
    html = "é" * 400 + "x" * (size - 800)
    row = admit(spark.createDataFrame([(1, None, html)], PAGE)).first()
    assert (row.size_bytes, row.reason) == (size, reason)


@pytest.mark.parametrize(
    ("html", "reason"),
    [
        ("x" * 99, "short_raw"),
        ("x" * 100, None),
        (None, "no_content"),
        ("<style>" + "y" * 100 + "</style>" + "x" * 49, "short_clean"),
        ("<style>" + "y" * 100 + "</style>" + "x" * 50, None),
    ],
)
def test_length_limits(spark, html, reason):
    row = cleaned(spark, html, EngineConfig(min_file_bytes=0))
    assert row.reason == reason
    assert (row.clean_html is None) == (reason is not None)


def test_sizes_count_characters(spark):
    row = cleaned(spark, "<body>" + "é" * 1018 + "</body>")
    assert row.original_size_kb == 1031 / 1024 and row.cleaned_size_kb == 1.0
    assert row.estimated_tokens == 256
    assert row.reduction_pct == pytest.approx((1031 - 1024) / 1031 * 100)


def test_one_evaluation_of_the_patterns(spark):
    """A filter on the outcome of the cleaning stays above it in the plan."""
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"),
                                  F.concat(F.lit("<body>"), F.col("id")).alias("html"))
    plan = clean_pages(pages, ANY_SIZE).where(F.col("reason").isNull() & (F.col("clean_chars") > 2))
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert filters and not any("regexp" in line for line in filters)


def test_declared_url(spark):
    cases = {
        '<link rel="canonical" href="https://a.b/c">': "https://a.b/c",
        "<meta property='og:url' content='https://d.e/f'>": "https://d.e/f",
        "<p>none</p>": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", H.declared_url(F.col("h")))
    assert {r[0]: r[1] for r in rows.collect()} == cases


@pytest.mark.parametrize(
    "tag", ["<a href=x>", "<a ", "<li ", "<h2>", "<h1>", "<link ", "<img ", "<svg>", "<script>", "<!-- ", "< ", "<body "]
)
def test_pages_full_of_open_tags_are_read_once(spark, tag):
    """Would take minutes if each open tag were searched to the end of the page."""
    from factloom.plans.page_flow import PageFlow

    page = spark.createDataFrame([(1, "http://x.y/z", "<body><ul><li>" + tag * 40_000)], PAGE)
    page = page.withColumn("original_file", F.lit("x"))
    start = time.monotonic()
    row = PageFlow().validated(page).select("status").first()
    assert row.status == "extraction_failed" and time.monotonic() - start < 60
