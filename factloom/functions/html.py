"""Single facts of an HTML text by regular expressions; what depends on nested tags is read by `functions.tags`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = r"(?i)<title(?:[\s/][^>]*)?(?:>|\z)([^<]*)"
HOST = r"^https?://(?:www\.|m\.|blog\.)?([^/?#]+)"
TAG = r"<[^<>]*>"
# Entities and what they stand for.
ENTITIES = (
    {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&euro;": "€", "&pound;": "£"}
    | {f"&#{n};": chr(n) for n in (34, 36, 38, 39, 60, 62, 160, 163, 8364)}
    | {"&amp;": "&"}
)


def plain_text(html: Column) -> Column:
    """Text without tags, common entities decoded, runs of white space as one space."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, TAG, "")), r"\s+", " "))


def decoded(text: Column) -> Column:
    """Common named entities and decimal references of printable ASCII; `&amp;` last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(html: Column) -> Column:
    return F.nullif(plain_text(F.regexp_extract(html, TITLE, 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag: double quoted, single quoted or bare."""
    start = rf"(?is)\s{name}\s*=\s*"
    choices = (rf'{start}"([^"]*)"', rf"{start}'([^']*)'", rf"{start}([^\s\"'>]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, c, 1), F.lit("")) for c in choices])


def declared_url(html: Column) -> Column:
    """The address a page states about itself: canonical link, else the Open Graph address."""
    canonical = F.regexp_extract(html, r"""(?is)<link\s[^<>]*rel\s*=\s*["']?canonical[^<>]*>""", 0)
    graph = F.regexp_extract(html, r"""(?is)<meta\s[^<>]*property\s*=\s*["']?og:url[^<>]*>""", 0)
    return F.coalesce(attribute(canonical, "href"), attribute(graph, "content"))
