"""Repeated blocks of a page: runs of alike siblings that hold links, and the fields their aligned parts make.

Works on the elements of one page, bottom up. Siblings of one name (and class) that hold links are a run; so are headings that
hold links, each with what follows up to the next heading, and the terms of a definition list. A block whose own link is
all it adds to a richer run inside is a container, and the inner blocks count; else it is an item with all it holds. All
runs of a page count, but plain lists of links (menus) give way to any richer run, and described blocks to at least as many
priced ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from factloom.functions.tags import HEADINGS, Elements, attribute, decoded, plain, value

AMOUNT = re.compile(r"(?:US )?[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?")
BARE, DESCRIBED, PRICED = 0, 1, 2

# Elements that end a heading's block; that repeat whatever their class; that lie within a line or a row.
_SECTIONS = frozenset("nav header footer aside main section article".split())
_ENTRIES = frozenset("li tr".split())
_INLINE = frozenset("a span b i em strong small u font label p td th dd".split())
_FORMATS = frozenset("b i em strong small u font".split())

_HREF, _SRC, _ALT, _CLASS, _PROP = map(attribute, ("href", "src", "alt", "class", "itemprop"))

# Words that name a field -> the field.
FIELD_WORDS = {
    "price": "price", "condition": "condition", "shipping": "shipping", "delivery": "shipping", "postage": "shipping",
    "seller": "seller", "vendor": "seller", "merchant": "seller", "store": "seller", "rating": "rating", "stars": "rating",
    "reviews": "reviews", "date": "date", "posted": "date", "listed": "date", "place": "place", "location": "place",
    "city": "place", "brand": "brand", "model": "model", "sku": "sku", "size": "size", "color": "color", "colour": "color",
    "capacity": "capacity", "type": "type", "category": "category", "availability": "availability", "stock": "availability",
    "quantity": "quantity", "description": "description",
}
# Class words that say how a part looks and not what it is.
_LOOKS = frozenset(
    "text muted col row item card cell value label left right small large bold info meta detail details wrap wrapper inner "
    "content box block line first last odd even active link title name entry product result".split()
)
# How the values of a field are written, best first.
_WRITTEN = (
    ("shipping", re.compile(r"(?i)\b(?:shipping|delivery|postage|ships|pickup)\b")),
    ("condition", re.compile(r"(?i)^(?:brand new|new|used|pre-?owned|(?:certified )?refurbished|renewed|open[ -]box|like new|"
                             r"very good|good|excellent|acceptable|for parts)\b.{0,30}$")),
    ("rating", re.compile(r"(?i)^\d(?:\.\d+)?\s*(?:/\s*\d+$|out of \d+|stars?\b)|^[★☆]{2,}")),
    ("reviews", re.compile(r"(?i)^\(?\d[\d.,]*\s?[km]?\)?\s*(?:reviews?|ratings?|votes?|sold)$|^\(\d[\d.,]*[km]?\)$")),
    ("date", re.compile(r"^(?:[A-Z][a-z]{2}-\d{1,2}(?: \d{1,2}:\d{2})?|\d{1,2}/\d{1,2}(?:/\d{2,4})?|\d{4}-\d{2}-\d{2}.{0,15}|"
                        r"[A-Z][a-z]{2} \d{1,2}, \d{4}|[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{4} [\d:]{8}.*)$")),
    ("seller", re.compile(r"(?i)^(?:sold by|by|seller)\s+(?P<value>\S.{0,60})$")),
    ("place", re.compile(r"^(?:[Ff]rom |[Ll]ocated in )?(?P<value>[A-Z][\w.' -]{1,40}, [A-Z][A-Za-z]{1,20})$")),
)
_LABEL = re.compile(r"^([A-Za-z][A-Za-z ]{1,24}?)\s*:\s+(\S.*)$", re.S)
_AROUND_PRICE = re.compile(r"(?i)^(?:from|now|only|price|buy|for|each|usd|us|as low as|[:\s.,*+-])*$")
_WORD = re.compile(r"[^a-z0-9]+")


def first_amount(texts: list[str]) -> str:
    """The first amount of money in texts that follow each other; one that tags cut through is read over them."""
    whole = next((found[0] for found in map(AMOUNT.search, texts) if found), "")
    across = "" if whole else AMOUNT.search(" ".join("".join(texts).split()))
    return whole or (across[0] if across else "")


class Blocks:
    """The blocks of one page. `items` are (start, end, run) of those that hold the items, `expected` is how many there should be."""

    def __init__(self, page: Elements):
        self.page = page
        self.text_starts = [start for _, start, _ in page.texts]
        read = [decoded(page.text[start:end]) for _, start, end in page.texts]
        self.read = read
        self.filled = [0, *accumulate(bool(t) and not t.isspace() for t in read)]
        self.priced = [
            start for (_, start, _), t in zip(page.texts, read) if ("$" in t or "€" in t or "£" in t) and AMOUNT.search(t)
        ]
        self.pictures = [i for i, n in enumerate(page.names) if n == "img"]
        self.images = [page.starts[i] for i in self.pictures]
        self.headings = [i for i, n in enumerate(page.names) if n in HEADINGS]
        self.cells = [page.starts[i] for i, n in enumerate(page.names) if n in ("td", "th")]
        self.link_places: list[int] = []
        self.links: list[int] = []
        self.runs: dict[int, dict] = {}
        self.items: list[tuple[int, int, int]] = []
        self.expected = 0
        self.more_blocks = False
        if "a" in page.names:
            self._find()

    # ---- what lies within a stretch of the page ----

    def _between(self, places: list[int], start: int, end: int) -> int:
        return bisect_left(places, end) - bisect_left(places, start)

    def texts_in(self, start: int, end: int) -> range:
        return range(bisect_left(self.text_starts, start), bisect_left(self.text_starts, end))

    def _filled_in(self, start: int, end: int) -> int:
        at = self.texts_in(start, end)
        return self.filled[max(at.stop, at.start)] - self.filled[at.start]

    def kind(self, start: int, end: int, without: list = ()) -> int:
        """How much a stretch says, apart from the blocks inside that are named."""

        def counted(count) -> int:
            return count(start, end) - sum(count(s, e) for s, e, _ in without)

        if counted(lambda s, e: self._between(self.priced, s, e)):
            return PRICED
        described = (
            counted(self._filled_in) > 1
            or counted(lambda s, e: self._between(self.images, s, e))
            or counted(lambda s, e: self._between(self.headed, s, e))
            or counted(lambda s, e: self._between(self.cells, s, e)) > 1
        )
        return DESCRIBED if described else BARE

    def kind_of_run(self, items: list) -> int:
        kinds = sorted((self.kind(s, e) for s, e, _ in items), reverse=True)
        return kinds[1] if len(kinds) > 1 else BARE

    def picture(self, start: int, end: int) -> str:
        """The tag of the first image in a stretch; empty where there is none."""
        first = bisect_left(self.images, start)
        inside = first < len(self.images) and self.images[first] < end
        return self.page.tag(self.pictures[first]) if inside else ""

    # ---- runs ----

    def _usable(self, a: int) -> bool:
        page = self.page
        if not value(_HREF, page.tag(a)):
            return False
        if self._filled_in(page.starts[a], page.ends[a]):
            return True
        return bool(value(_ALT, self.picture(page.starts[a], page.ends[a])))

    def _find(self) -> None:
        page = self.page
        n = len(page.names)
        usable = [name == "a" and self._usable(i) for i, name in enumerate(page.names)]
        self.links = [i for i in range(n) if usable[i]]
        self.link_places = [page.starts[i] for i in self.links]
        headings = self.headings
        # Headings that hold a link or are held by one.
        self.headed = sorted(
            {page.starts[h] for h in headings if self._between(self.link_places, page.starts[h], page.ends[h])}
            | {page.starts[h] for h in headings if self._inside_link(h, usable)}
        )
        own = [int(u) for u in usable]
        found: list[list] = [[] for _ in range(n)]
        for parent in range(n - 1, -1, -1):
            kids = page.children[parent]
            carrying = [k for k in kids if own[k] or found[k]]
            if not carrying:
                continue
            if len(carrying) == 1 and page.names[carrying[0]] not in _ENTRIES:
                own[parent] += own[carrying[0]]
                found[parent] = found[carrying[0]]
                continue
            units, rest = self._units(parent, kids, own, found)
            for k in rest:
                own[parent] += own[k]
            items = [(page.starts[k], item) for k in rest for item in found[k]]
            for run, unit in units:
                items += [(page.starts[unit[0]], item) for item in self._resolve(run, unit, own, found)]
            items.sort(key=lambda pair: pair[0])
            found[parent] = [item for _, item in items]
        self._choose(found[0])

    def _inside_link(self, heading: int, usable: list) -> bool:
        at = bisect_left(self.link_places, self.page.starts[heading]) - 1
        return at >= 0 and self.page.ends[self.links[at]] > self.page.starts[heading]

    def _new_run(self, name: str) -> int:
        self.runs[len(self.runs)] = {"name": name, "blank": 0}
        return len(self.runs) - 1

    def _units(self, parent: int, kids: list, own: list, found: list) -> tuple[list, list]:
        """(run, its elements) for each block among the children, and the children that are in none."""
        page = self.page
        heads = [k for k in kids if page.names[k] in HEADINGS and own[k]]
        if page.names[parent] == "dl":
            starts = {k for k in kids if page.names[k] == "dt"}
            ends = set()
        elif len(heads) > 1:
            starts = set(heads)
            ends = {
                k for k in kids if page.names[k] in HEADINGS or page.names[k] in _SECTIONS or len(found[k]) > 1
            } - starts
        else:
            starts, ends = set(), set()
        units, rest = [], []
        if len(starts) > 1:
            run, current = self._new_run("dt" if page.names[parent] == "dl" else "heading"), None
            for k in kids:
                if k in starts:
                    current = [k]
                    units.append((run, current))
                elif k in ends:
                    current = None
                    rest.append(k)
                elif current is not None:
                    current.append(k)
                else:
                    rest.append(k)
            if page.names[parent] != "dl" and rest:
                more, rest = self._alike(rest, own, found)
                units += more
            return units, rest
        return self._alike(kids, own, found)

    def _alike(self, kids: list, own: list, found: list) -> tuple[list, list]:
        page = self.page
        groups: dict[tuple, list] = {}
        for k in kids:
            name = page.names[k]
            style = "" if name in _ENTRIES else value(_CLASS, page.tag(k)).split(" ")[0]
            groups.setdefault((name, style), []).append(k)
        units, rest = [], []
        for (name, _), group in groups.items():
            carrying = [k for k in group if own[k] or found[k]]
            if name in _INLINE:
                rich = sum(
                    self.kind(page.starts[k], page.ends[k]) == PRICED
                    or self._between(self.headed, page.starts[k], page.ends[k]) > 0
                    for k in carrying
                )
                together = rich > 1
            else:
                together = len(carrying) > (0 if name in _ENTRIES else 1)
            if not together:
                rest += group
                continue
            run = self._new_run(name)
            for k in group:
                if own[k] or found[k]:
                    units.append((run, [k]))
                elif name == "li":
                    self.runs[run]["blank"] += 1
        return units, rest

    def _resolve(self, run: int, unit: list, own: list, found: list) -> list:
        """The item that a block is, or the items inside it."""
        page = self.page
        start, end = page.starts[unit[0]], page.ends[unit[-1]]
        if len(unit) > 1 or page.names[unit[0]] in HEADINGS:
            end = self._segment_end(unit[-1])
        inner = [item for k in unit for item in found[k]]
        if sum(own[k] for k in unit):
            container = len(inner) > 1 and self.kind(start, end, inner) < self.kind_of_run(inner)
            if not container:
                return [(start, end, run)]
        if not inner:
            self.runs[run]["blank"] += 1
            return []
        single = {r for r, n in Counter(r for _, _, r in inner).items() if n == 1}
        return [(s, e, run if r in single else r) for s, e, r in inner]

    def _segment_end(self, last: int) -> int:
        """Where the text after an element ends: at its next sibling, or with its parent."""
        parent = self.page.parents[last]
        kids = self.page.children[parent]
        at = bisect_left(kids, last) + 1
        return self.page.starts[kids[at]] if at < len(kids) else self.page.ends[parent]

    def _choose(self, found: list) -> None:
        by_run: dict[int, list] = {}
        for item in found:
            by_run.setdefault(item[2], []).append(item)
        several = {r: items for r, items in by_run.items() if len(items) > 1}
        runs = several or by_run
        kinds = {r: self.kind_of_run(items) for r, items in runs.items()}

        def gives_way(run: int) -> bool:
            return any(
                kinds[other] > kinds[run] and (kinds[run] == BARE or len(runs[other]) >= len(runs[run])) for other in runs
            )

        kept = {r for r in runs if not gives_way(r)}
        self.items = [item for item in found if item[2] in kept]
        self.expected = len(self.items) + sum(self.runs[r]["blank"] for r in kept)
        self.more_blocks = any(len(runs[r]) > len(self.items) for r in runs if r not in kept)


def _named(word: str) -> str:
    return _WORD.sub("_", word.lower()).strip("_")


class Fields:
    """The fields of a page's items; parts of blocks are aligned by the path of their elements."""

    def __init__(self, blocks: Blocks):
        self.blocks, self.page = blocks, blocks.page
        page = self.page
        paths, known = [0] * len(page.names), {}
        self.hints: dict[int, tuple[str, str]] = {}
        for i in range(1, len(page.names)):
            parent = page.parents[i]
            cell = bisect_left(page.children[parent], i) if page.names[i] in ("td", "th") else -1
            step = (paths[parent], page.names[i], value(_CLASS, page.tag(i)), cell)
            paths[i] = known.setdefault(step, len(known) + 1)
        self.paths = paths

    def hint(self, element: int) -> tuple[str, str]:
        """(field, weaker guess) that the tags around a text name."""
        page = self.page
        while page.names[element] in _FORMATS and not value(_CLASS, page.tag(element)) and page.parents[element] > 0:
            element = page.parents[element]
        if element not in self.hints:
            self.hints[element] = self._hint(element)
        return self.hints[element]

    def _hint(self, element: int) -> tuple[str, str]:
        page = self.page
        tag = page.tag(element)
        prop = _named(value(_PROP, tag))
        if prop:
            return FIELD_WORDS.get(prop, prop), ""
        weak = ""
        for word in value(_CLASS, tag).split():
            name = _named(word.rsplit("__", 1)[-1])
            if name in FIELD_WORDS:
                return FIELD_WORDS[name], ""
            if not weak and re.fullmatch(r"[a-z]+(?:_[a-z]+)*", name) and 3 <= len(name) <= 24 and name not in _LOOKS:
                weak = name
        if page.names[element] in ("td", "dd", "th"):
            header = self._header(element)
            if header:
                return FIELD_WORDS.get(header.split("_")[-1], header), weak
        return "", weak

    def _header(self, cell: int) -> str:
        """The name of a cell's column, by the first row of its table where that is one of headers."""
        page = self.page
        row = page.parents[cell]
        table = page.parents[row]
        while table > 0 and page.names[table] != "table":
            table = page.parents[table]
        if table <= 0 or page.names[row] != "tr":
            return ""
        first = table
        while page.names[first] != "tr" and page.children[first]:
            first = page.children[first][0]
        heads, at = page.children[first], bisect_left(page.children[row], cell)
        if page.names[first] != "tr" or at >= len(heads) or page.names[heads[at]] != "th":
            return ""
        return _named(plain(page.text[page.opened[heads[at]] : page.ends[heads[at]]]))

    def _parts(self, start: int, end: int) -> tuple[dict, list]:
        """Title, link, price and image of a block, and its other texts as (path, place among equal paths, element, text)."""
        blocks, page = self.blocks, self.page
        at = bisect_left(blocks.link_places, start)
        if at == len(blocks.links) or blocks.link_places[at] >= end:
            return {}, []
        a = blocks.links[at]
        # A link around a whole card is titled by the heading inside.
        head = bisect_left(blocks.headings, a)
        inside = head < len(blocks.headings) and page.starts[blocks.headings[head]] < page.ends[a]
        titled = blocks.headings[head] if inside else a
        within = blocks.texts_in(page.starts[titled], page.ends[titled])
        title = " ".join("".join(blocks.read[i] for i in within).split())
        tag = blocks.picture(start, end)
        all_texts = blocks.texts_in(start, end)
        price = first_amount([blocks.read[i] for i in all_texts])
        source = value(_SRC, tag)
        fields = {
            "title": title or plain(value(_ALT, tag)),
            "link": value(_HREF, page.tag(a)),
            "price": price,
            "image": "" if source.startswith("[") else source,
        }
        parts, seen = [], Counter()
        for i in all_texts:
            if within.start <= i < within.stop:
                continue
            text = " ".join(blocks.read[i].split())
            if not text:
                continue
            element = page.texts[i][0]
            path = self.paths[element]
            seen[path] += 1
            if price and price in text and _AROUND_PRICE.match(text.replace(price, "", 1)):
                continue
            parts.append((path, seen[path], element, text))
        return fields, parts

    def of_run(self, items: list) -> list[list[tuple[str, str]]]:
        """(field, value) pairs of each block of a run: title, link, price, image, then its other parts in order."""
        split = [self._parts(start, end) for start, end, _ in items]
        columns: dict[tuple, list[str]] = {}
        for _, parts in split:
            for path, place, _, text in parts:
                columns.setdefault((path, place), []).append(text)
        written = {key: self._written(texts) for key, texts in columns.items()}
        varying = {key: len(set(texts)) > 1 or len(items) == 1 for key, texts in columns.items()}
        rows = []
        for fields, parts in split:
            row = {name: text for name, text in fields.items() if text}
            uses = Counter(row.keys())
            for path, place, element, text in parts:
                name, text = self._field((path, place), element, text, written, varying)
                if name:
                    uses[name] += 1
                    while uses[name] > 1 and f"{name}_{uses[name]}" in row:
                        uses[name] += 1
                    row[name if uses[name] == 1 else f"{name}_{uses[name]}"] = text
            rows.append(list(row.items()))
        return rows

    def _written(self, texts: list[str]) -> str:
        """The field that more than half of a column's values are written like."""
        votes = Counter(next((name for name, pattern in _WRITTEN if pattern.search(t)), "") for t in texts)
        name, n = votes.most_common(1)[0]
        return name if n * 2 > len(texts) else ""

    def _field(self, key: tuple, element: int, text: str, written: dict, varying: dict) -> tuple[str, str]:
        label = _LABEL.match(text)
        if label:
            name = _named(label[1])
            return FIELD_WORDS.get(name.split("_")[-1], name), label[2]
        name, weak = self.hint(element)
        if name:
            return name, text
        if written[key]:
            found = dict(_WRITTEN)[written[key]].search(text)
            return written[key], found["value"] if found and "value" in found.re.groupindex else text
        if varying[key]:
            return weak or "detail", text
        return "", text


def items_of(blocks: Blocks) -> list[list[tuple[str, str]]]:
    """The fields of all items of a page, in page order; a block without title or link is none."""
    by_run: dict[int, list] = {}
    for item in blocks.items:
        by_run.setdefault(item[2], []).append(item)
    fields = Fields(blocks) if by_run else None
    found = [
        (item[0], row) for items in by_run.values() for item, row in zip(items, fields.of_run(items)) if row[:1] and row[0][0] == "title"
    ]
    return [row for _, row in sorted(found, key=lambda pair: pair[0])]
