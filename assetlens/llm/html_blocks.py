"""HTML to leaf blocks: text between block-level tags, with the path of open tags around it."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
MARKS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Their content isn't markup and never text of the page.
RAW = {"script", "style", "template", "svg", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "semantics", "mark", "nobr", "object", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Tags that end an open one of these when they start, up to the tags that enclose lists and tables.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOPS = {"ul", "ol", "dl", "table", "select", "body", "html"}
SPACE = re.compile(r"\s+")


class Path:
    """An open tag with what is open around it, as a linked node, so that a block's path costs no copy."""

    __slots__ = ("cache", "depth", "names", "tag", "up")

    def __init__(self, up: Path | None, tag: str, names: tuple[str, ...]) -> None:
        self.up, self.tag, self.names, self.depth, self.cache = up, tag, names, 1 + (up.depth if up else 0), None


@dataclass
class Block:
    text: str
    #: The innermost open tag that isn't inline, with the words of its class, id and role; None outside of all tags.
    path: Path | None
    #: Code points of the text that stand in links.
    linked: int


class _Ends:
    """Where a tag that begins at a place ends: at the first > outside of quotes, if there is one. Worked out once for a page, from its
    last mark to its first, so that tags that never end cost no search of their own."""

    def __init__(self, page: str) -> None:
        self.at, self.end = [], []
        marks = [(m.start(), m[0]) for m in MARKS.finditer(page)]
        after: dict[str, int] = {}
        found = [-1] * (len(marks) + 1)
        for k in range(len(marks) - 1, -1, -1):
            place, mark = marks[k]
            if mark == ">":
                found[k] = place
            else:
                if mark in after:
                    found[k] = found[after[mark] + 1]
                after[mark] = k
        self.at, self.end = [p for p, _ in marks], found

    def of(self, start: int) -> int:
        return self.end[bisect_left(self.at, start)]


class _Stack:
    """Open tags, and for each name where they are in it."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, Path | None]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def path(self) -> Path | None:
        return self.tags[-1][1] if self.tags else None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        path = self.path()
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
            path = Path(path, tag, names)
        self.tags.append((tag, path))

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            tag, _ = self.tags.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    words: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        words += [w for w in re.split(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])", value) if w]
    return tuple(w.lower() for w in words)


def blocks(page: str) -> list[Block]:
    """All blocks with text in page order; character references are decoded, white space is one space."""
    out: list[Block] = []
    stack, ends_of = _Stack(), _Ends(page)
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                # inline tags aren't part of a leaf's path
                out.append(Block(text, stack.path(), min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    n, look = len(page), 0
    while at < n:
        start = page.find("<", max(at, look))
        if start < 0:
            add(page[at:])
            break
        stop, tag = start + 1, None
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            stop = n if close < 0 else close + 3
        elif page.startswith("<![CDATA[", start):
            close = page.find("]]>", start + 9)
            stop = n if close < 0 else close + 3
            tag = page[start + 9 : n if close < 0 else close]
        elif page.startswith(("<!", "<?"), start):
            close = page.find(">", start)
            stop = n if close < 0 else close + 1
        else:
            m = NAME.match(page, start + 1)
            end = ends_of.of(m.end()) if m else -1
            if end < 0:
                look = start + 1  # not a tag: text goes on
                continue
            stop = end + 1
        if start > at:
            add(page[at:start])
        at = look = stop
        if page.startswith(("<!", "<?"), start):
            if tag:
                add(html.escape(tag))
            continue
        closes, name, attributes = bool(m[1]), m[2].lower(), page[m.end() : end]
        alone = attributes.rstrip().endswith("/")
        if name in RAW:
            if not closes and not alone:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = look = close.end() if close else n
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            end_block()
        if closes:
            own = stack.last((name,))
            # a stray end tag of an inline tag doesn't close blocks
            if own >= 0 and not (inline and stack.blocks and stack.blocks[-1] > own):
                stack.cut(own)
            if name == "a":
                in_link = len(stack.places.get("a", ()))
            continue
        if name in VOID:
            continue
        if name in ENDS:
            ended = stack.last(ENDS[name])
            if ended > stack.last(STOPS):
                stack.cut(ended)
        elif not inline and stack.blocks and stack.tags[stack.blocks[-1]][0] == "p":
            stack.cut(stack.blocks[-1])
        if not alone:
            stack.push(name, _names(attributes))
        if not inline or name == "a":
            in_link = len(stack.places.get("a", ()))
    end_block()
    return out
