"""Leaf blocks of a web page: text between block-level boundaries, with its tag path.

A small tokenizer that takes pages as they come: unclosed and stray tags, missing end
tags, raw-text elements with markup inside, comments, character references. Formulas,
and what is shown where scripts, players or plug-ins are missing, are text like other.
Of the elements whose content is skipped, only scripts and styles that never end take
the rest of the page with them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements by the part they play in the block structure.
RAW = {"script", "style", "template", "iframe", "svg", "textarea", "select", "title", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
    "object", "video", "audio", "canvas", "picture",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd",
}
#: An element of the first kind ends open elements of the second, up to a container.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul",
}
#: Possessive throughout, so that no page is scanned twice: a tag ends at ``>``, before the
#: next ``<`` or with the page, and a quote that is never closed is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"(?:\s|^)(?:class|id|role|hidden|style|aria-hidden)\b", re.I)


class Path:
    """The names from the page's root to an element, each shared by all below it."""

    __slots__ = ("name", "up", "depth", "__weakref__")

    def __init__(self, name: str, up: Path | None = None):
        self.name, self.up, self.depth = name, up, 1 + (up.depth if up else 0)

    def __iter__(self) -> Iterator[str]:
        names, at = [], self
        while at is not None:
            names.append(at.name)
            at = at.up
        return reversed(names)

    def __len__(self) -> int:
        return self.depth

    def __getitem__(self, i: int) -> str:
        return list(self)[i]


@dataclass
class Block:
    """A leaf block: white space made single, names on the path, characters in links."""

    text: str
    path: Path | None
    linked: int = 0
    hidden: bool = False


def _names(tag: str, attrs: str) -> tuple[str, bool]:
    """Tag with its class, id and role words (``div.ad``), and whether it is hidden."""
    if not attrs or not _NAMED.search(attrs):
        return tag, False
    words, hidden = [], False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words += value.lower().split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return ".".join([tag, *words]), hidden


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; those without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, Path, bool]] = []  # tag, path, whether it or one above is hidden
    inner: list[int] = []  # where the elements of the stack that are not inline stand
    open_: Counter[str] = Counter()
    text: list[tuple[str, bool]] = []
    page = page or ""
    endless: set[str] = set()  # raw-text elements that no end tag follows

    def flush() -> None:
        if not text:
            return
        whole = _SPACE.sub(" ", "".join(x for x, _ in text)).strip()
        if whole:
            linked = sum(len(x.strip()) for x, in_link in text if in_link)
            out.append(Block(whole, stack[-1][1] if stack else None, min(linked, len(whole)), bool(stack) and stack[-1][2]))
        text.clear()

    def close(tag: str) -> None:
        """End open elements down to the last ``tag``, if there is one."""
        while open_[tag]:
            t = stack.pop()[0]
            open_[t] -= 1
            if inner and inner[-1] == len(stack):
                inner.pop()
            if t == tag:
                return

    def implied(tag: str) -> None:
        ends = CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else set())
        while inner and (t := stack[inner[-1]][0]) in ends:
            close(t)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text.append((html.unescape(page[at:]), open_["a"] > 0))
            break
        if m.start() > at:
            text.append((html.unescape(page[at : m.start()]), open_["a"] > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text.append((" ", open_["a"] > 0))
            elif tag in INLINE:
                close(tag)
            elif open_[tag]:
                flush()
                close(tag)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if tag != "title" and tag not in INLINE:
                text.append((" ", open_["a"] > 0))
            if not m[3].rstrip().endswith("/") or tag != "svg":
                stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                text.append((" ", open_["a"] > 0))
            continue
        if tag not in INLINE:
            flush()
            implied(tag)
        name, hidden = _names(tag, m[3])
        if tag not in INLINE:
            inner.append(len(stack))
        stack.append((tag, Path(name, stack[-1][1] if stack else None), hidden or (bool(stack) and stack[-1][2])))
        open_[tag] += 1
    flush()
    return out
