"""Reading pages: one pass over the tags of each page, inside the tasks.

Tags nest, so a page is read by a small function on Arrow batches (`functions.tags`, `functions.blocks`) and not by patterns.
Only the page's text goes to Python and only what was found comes back; all other columns stay in the JVM row, nothing is
shuffled, and a lost task is redone from its own split. A batch is read in portions of so much text: what Python makes of a
page is many times its size, and a worker holds that of one portion at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import tags
from factloom.functions.blocks import Blocks, first_amount, items_of
from factloom.schemas import ITEMS

CLEANED = (
    "clean_html:string,removed_tags:bigint,removed_comments:bigint,base64_images_removed:bigint,json_ld:array<string>,title:string"
)
#: What a page repeats: its items, how many blocks there should be, and whether other blocks were more.
BLOCKS = (
    f"items:{ITEMS},expected:bigint,more_blocks:boolean,list_entries:bigint,main_headings:bigint,heading:string,price:string"
)

#: Bytes of page text that a worker reads at a time, beyond a single page.
PORTION = 1 << 19

_FIELD = pa.struct([("field", pa.string()), ("value", pa.string()), ("value_type", pa.string())])


def _listed(values: list[list[str]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.string()))


def _items(pages: list[list[list[tuple[str, str]]]]) -> pa.Array:
    """Pages of items of (field, value) as nested Arrow lists."""
    names, values, items, ends = [], [], [0], [0]
    for page in pages:
        for item in page:
            names += [name for name, _ in item]
            values += [value for _, value in item]
            items.append(len(names))
        ends.append(len(items) - 1)
    kinds = pa.array(["string"] * len(names), pa.string())
    fields = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), kinds], fields=list(_FIELD))
    inner = pa.ListArray.from_arrays(pa.array(items, pa.int32()), fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def _cleaned_columns(found: list[tags.Cleaned]) -> dict[str, pa.Array]:
    return {
        "clean_html": pa.array([c.text for c in found], pa.string()),
        "removed_tags": pa.array([c.removed_tags for c in found], pa.int64()),
        "removed_comments": pa.array([c.removed_comments for c in found], pa.int64()),
        "base64_images_removed": pa.array([c.images for c in found], pa.int64()),
        "json_ld": _listed([c.json_ld for c in found]),
        "title": pa.array([c.title or None for c in found], pa.string()),
    }


def _block_columns(found: Iterable[tags.Cleaned]) -> dict[str, pa.Array]:
    items, numbers, headings, prices = [], [], [], []
    for cleaned in found:
        page = tags.Elements(cleaned.text, cleaned.tags)
        blocks = Blocks(page)
        items.append(items_of(blocks))
        heads = [i for i, name in enumerate(page.names) if name == "h1"]
        numbers.append((blocks.expected, blocks.more_blocks, page.names.count("li"), len(heads)))
        text = "".join(t for (_, s, _), t in zip(page.texts, blocks.read) if page.starts[heads[0]] <= s < page.ends[heads[0]]) if heads else ""
        headings.append(" ".join(text.split()) or None)
        prices.append(first_amount(blocks.read) or None if len(items[-1]) < 2 else None)
    expected, more, entries, mains = zip(*numbers) if numbers else ((), (), (), ())
    return {
        "items": _items(items),
        "expected": pa.array(expected, pa.int64()),
        "more_blocks": pa.array(more, pa.bool_()),
        "list_entries": pa.array(entries, pa.int64()),
        "main_headings": pa.array(mains, pa.int64()),
        "heading": pa.array(headings, pa.string()),
        "price": pa.array(prices, pa.string()),
    }


def _scanned_columns(mined: bool, pages: list[str]) -> dict[str, pa.Array]:
    found = [tags.clean(page) for page in pages]
    columns = _cleaned_columns(found)
    return columns | {"blocks": _packed(_block_columns(found))} if mined else columns


def _packed(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def portions(pages: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in order, `PORTION` bytes at a time; a longer page is a portion of its own."""
    begin, size = 0, 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if size and size + n > PORTION:
            yield [page or "" for page in pages.slice(begin, at - begin).to_pylist()]
            begin, size = at, 0
        size += max(n, 1)
    yield [page or "" for page in pages.slice(begin).to_pylist()]


def read_in_portions(read: Callable[[list[str]], dict[str, pa.Array]], batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """A struct for each page, of the columns that `read` makes of a portion."""
    for pages in batches:
        for portion in portions(pages):
            yield _packed(read(portion))


def _by_page(read: Callable[[list[str]], dict[str, pa.Array]], returned: str, text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return read_in_portions(read, batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returned)(text)


def scanned(html: Column, mined: bool) -> Column:
    """The struct `CLEANED` of each page, and where `mined`, its `blocks` (`BLOCKS`) from the same pass."""

    return _by_page(partial(_scanned_columns, mined), f"struct<{CLEANED}{f',blocks:struct<{BLOCKS}>' if mined else ''}>", html)


def blocks_of(clean_html: Column) -> Column:
    """`BLOCKS` of pages that were cleaned before."""
    return _by_page(lambda pages: _block_columns(map(tags.clean, pages)), f"struct<{BLOCKS}>", clean_html)
