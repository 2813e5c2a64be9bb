"""A page as a sequence of tags: one pass that cleans it, and the elements its tags open and close.

The small per-page helper of `operators.scan`, which runs it on Arrow batches inside the tasks. A `>` inside a quoted attribute
value does not end a tag, a block ends with its own end tag however many of its name lie inside, and end tags that HTML
lets out are implied. Everything is linear in the length of the page; what is never closed runs to its end.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Attributes up to the end of a tag; quotes count after an equals sign only. Possessive, so that no part is read twice.
_ATTRIBUTES = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]++|=)*+"""
_TAG = re.compile(
    r"<(?:(?P<comment>!--.*?(?:-->|\Z))"
    rf"|(?P<raw>script|style)(?=[\s/>]|\Z)(?P<attributes>{_ATTRIBUTES})(?:>(?P<text>.*?)(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|(?P<end>/?)(?P<name>[a-z][^\s/>]*){_ATTRIBUTES}(?:>|\Z)"
    r"|(?P<other>[!?][^>]*(?:>|\Z)))",
    re.S | re.I,
)
_LD = re.compile(r"""\stype\s*=\s*["']?application/ld\+json["']?(?:\s|/|\Z)""", re.I)
_INLINE_IMAGE = re.compile(r"""(\ssrc\s*=\s*)(?:"data:image[^"]*"|'data:image[^']*'|data:image[^\s>]*)""", re.I)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")

# Elements without content for a reader, as blocks and as single tags; elements without end tag.
BLOCK_NOISE = frozenset("svg noscript iframe".split())
TAG_NOISE = frozenset("path meta link".split())
VOID = frozenset("area base br col embed hr img input param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# An opening tag ends these elements, unless one of the second group was opened after them.
_LIST, _CELL = ("ul", "ol", "menu"), ("td", "th", "table")
IMPLIED = {
    "li": (("li",), _LIST),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody"), ("table",)),
    "option": (("option",), ("select",)),
    "a": (("a",), ("li", *_CELL)),
} | {h: (tuple(HEADINGS), ("li", "div", *_CELL)) for h in HEADINGS}
_ENDS_P = frozenset("p div ul ol dl table section article nav header footer aside form".split()) | HEADINGS
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th".split())


@dataclass
class Cleaned:
    """What is left of a page, what was removed, and the tags that are left with their places in `text`."""

    text: str = ""
    tags: list = field(default_factory=list)  # (name, opens, start, end)
    removed_tags: int = 0
    removed_comments: int = 0
    images: int = 0
    json_ld: list = field(default_factory=list)
    title: str | None = None


def decoded(text: str) -> str:
    """Entities as the characters they stand for, each once."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def plain(text: str) -> str:
    """Entities decoded, runs of white space as one space."""
    return " ".join(decoded(text).split())


def clean(page: str) -> Cleaned:
    """Drop noise and comments, mask inline images, keep the body (the whole page where there is none)."""
    out, pieces, size, at = Cleaned(), [], 0, 0
    inside, depth = None, 0
    for tag in _TAG.finditer(page):
        kind, start, end = tag.lastgroup, tag.start(), tag.end()
        if kind == "name":
            name, opens = tag["name"].lower(), not tag["end"]
        else:
            name, opens = "", kind != "comment" and kind != "other"
        if inside:
            noise = not name or name in BLOCK_NOISE or name in TAG_NOISE
            out.removed_tags += opens and noise
            if name == inside:
                depth += -1 if not opens else page[end - 2] != "/"
                if not depth:
                    inside, at = None, end
            continue
        if name and name not in TAG_NOISE and not (opens and name in BLOCK_NOISE):
            if name == "img" and "data:image" in tag[0]:
                masked, n = _INLINE_IMAGE.subn(r'\1"[BASE64_REMOVED]"', tag[0], count=1)
                out.images += n
                pieces += (page[at:start], masked)
                begin = size + start - at
                size = begin + len(masked)
                at = end
                out.tags.append((name, opens, begin, size))
                continue
            if name == "title" and opens and out.title is None:
                stop = page.find("<", end)
                out.title = plain(page[end : stop if stop >= 0 else len(page)])
            out.tags.append((name, opens, size + start - at, size + end - at))
            continue
        if kind == "other":
            out.tags.append(("!", False, size + start - at, size + end - at))
            continue
        pieces.append(page[at:start])
        size += start - at
        at = end
        if kind == "comment":
            out.removed_comments += 1
            continue
        out.removed_tags += opens
        if not name and _LD.search(tag["attributes"] + " "):
            out.json_ld.append((tag["text"] or "").strip(" \t\r\n"))
        if opens and name in BLOCK_NOISE and page[end - 2] != "/":
            inside, depth = name, 1
    if not inside:
        pieces.append(page[at:])
    out.text = "".join(pieces)
    stop = next((t for t in out.tags if t[0] == "body" and not t[1]), None)
    first = next((t for t in out.tags if t[0] == "body" and t[1]), None)
    if first and (stop is None or first[2] < stop[2]):
        low, high = first[2], stop[2] if stop else len(out.text)
        out.text = out.text[low:high]
        out.tags = [(n, o, s - low, e - low) for n, o, s, e in out.tags if low <= s < high]
    return out


class Elements:
    """The elements of a cleaned page, in the order they open; element 0 is the page itself.

    `starts` and `opened` are the bounds of an opening tag, `ends` is where the content ends. `texts` are the stretches between
    tags: (element, start, end).
    """

    def __init__(self, text: str, tags: list):
        self.text = text
        self.names, self.parents, self.starts, self.opened, self.ends = ["page"], [-1], [0], [0], [len(text)]
        self.children: list[list[int]] = [[]]
        self.texts: list[tuple[int, int, int]] = []
        stack, open_at = [0], {}

        def last(names) -> int:
            return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

        def close(to: int, position: int) -> None:
            while len(stack) > to:
                element = stack.pop()
                self.ends[element] = position
                open_at[self.names[element]].pop()

        at = 0
        for name, opens, start, end in tags:
            if start > at:
                self.texts.append((stack[-1], at, start))
            at = end
            ended, barrier = IMPLIED.get(name, ((), _CELL))
            if not opens:
                to = last((name,))
                if to > 0 and (name in _TABLE_PARTS or to > last(barrier if name in IMPLIED else _CELL)):
                    close(to, start)
                continue
            to = last(ended)
            if to > last(barrier):
                close(to, start)
            if name in _ENDS_P and (to := last(("p",))) > last(("li", *_CELL)):
                close(to, start)
            element = len(self.names)
            self.names.append(name)
            self.parents.append(stack[-1])
            self.starts.append(start)
            self.opened.append(end)
            self.ends.append(end)
            self.children.append([])
            self.children[stack[-1]].append(element)
            if name not in VOID and text[end - 2 : end] != "/>":
                open_at.setdefault(name, []).append(len(stack))
                stack.append(element)
        if len(text) > at:
            self.texts.append((stack[-1], at, len(text)))
        close(1, len(text))

    def tag(self, element: int) -> str:
        return self.text[self.starts[element] : self.opened[element]]


def attribute(name: str) -> re.Pattern:
    return re.compile(rf"""[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def value(pattern: re.Pattern, tag: str) -> str:
    """The value of an attribute of one tag; empty where it has none."""
    found = pattern.search(tag)
    return next((g for g in found.groups() if g), "") if found else ""
