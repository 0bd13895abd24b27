"""Ground truth from semantic sources: HTML, LaTeX and XML to (heading, paragraph, table) blocks.

Every parser gives a ``Truth``; a part that the source cannot vouch for is None, which
later means "not evaluated" and is not the same as empty.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import unicodedata
import zipfile
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.rowwise import by_row

SCHEMA = "text string, headings array<string>, heading_levels array<int>, paragraphs array<string>, tables array<array<array<string>>>, note map<string,string>"


def clean(s: str) -> str:
    """Soft hyphens out, all white space single."""
    return re.sub(r"[\s\xa0​]+", " ", s.replace("\xad", "")).strip()


@dataclass
class Truth:
    """Blocks in order: ("heading", text, level), ("para", text) or ("table", rows)."""

    blocks: list[tuple] = field(default_factory=list)
    note: dict[str, str] = field(default_factory=dict)
    headings_known: bool = True

    def row(self) -> dict:
        text, heads, levels, paras, tables = [], [], [], [], []
        for kind, body, *more in self.blocks:
            if kind == "table":
                rows = [r for r in ([clean(c) for c in r] for r in body) if any(r)]
                if rows:
                    tables.append(rows)
                    text += [" ".join(filter(None, r)) for r in rows]
            elif t := clean(body):
                text.append(t)
                if kind == "heading":
                    heads.append(t)
                    levels.append(min(max(int(more[0]), 1), 6))
                else:
                    paras.append(t)
        known = self.headings_known
        return {"text": " ".join(text), "headings": heads if known else None, "heading_levels": levels if known else None, "paragraphs": paras, "tables": tables, "note": self.note}


# HTML

# What of a page is no text of the document.
DROP_TAGS = {
    "script", "style", "template", "svg", "iframe", "noscript", "nav", "aside", "footer", "button", "select", "textarea", "object", "canvas", "audio", "video", "map",
}
MATH_TAGS = {"math", "annotation", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK_TAGS = {
    "p", "div", "section", "article", "main", "header", "blockquote", "pre", "li", "dd", "dt", "dl", "ul", "ol", "figure", "figcaption", "address", "details", "summary",
    "fieldset", "hgroup", "hr", "center",
}
DROP_CLASSES = {
    "mw-editsection", "mw-editsection-bracket", "mw-editsection-divider", "mw-jump-link", "mw-empty-elt", "mw-cite-backlink", "mw-references-wrap", "mw-reflink-text",
    "mw-headline-anchor", "mw-indicators", "reference", "references", "reflist", "refbegin", "reference-text-hidden", "navbox", "navbox-inner", "vertical-navbox",
    "sidebar", "sistersitebox", "toc", "toctitle", "tocnumber", "catlinks", "printfooter", "noprint", "ambox", "metadata", "hatnote", "shortdescription", "mbox-small",
    "navigation", "breadcrumb", "sidenav", "site-header", "site-footer", "cookie-banner", "skip-link", "screen-reader-text", "sr-only", "visually-hidden",
    "mwe-math-fallback-image-inline", "mwe-math-fallback-image-display",
}
DROP_IDS = {"toc", "mw-navigation", "mw-panel", "siteNotice", "footer", "catlinks", "siteSub", "jump-to-nav", "mw-hidden-catlinks"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu"}
DROP_TABLES = {
    "infobox", "infobox_v2", "infobox_v3", "navbox", "vertical-navbox", "sidebar", "ambox", "metadata", "toccolours-nav", "nowraplinks", "mbox-small", "succession-box",
}
DROP_SECTIONS = {
    "references", "reference", "notes", "notes and references", "footnotes", "citations", "external links", "further reading", "bibliography", "sources", "see also",
    "works cited", "literature", "external link", "einzelnachweise", "weblinks", "literatur", "anmerkungen", "siehe auch", "fußnoten", "参考文献", "参考资料", "外部链接",
    "外部連結", "延伸阅读", "参见", "另见", "脚注", "註釋", "注释", "関連項目", "外部リンク", "参照", "脚註", "notas", "referencias", "enlaces externos", "véase también",
    "notes et références", "liens externes", "voir aussi", "bibliographie",
}
EDIT_MARK = re.compile(r"\[\s*(?:edit|edit\s+source|编辑|編集|編輯|bearbeiten|modifier|editar)\s*\]", re.I)
REFERENCE_MARK = re.compile(r"\[\s*(?:\d{1,3}|[a-z]|note\s*\d*|nb\s*\d*|注\s*\d*|citation needed|来源请求)\s*\]", re.I)
NUMBER_CELL = re.compile(r"^[\(\[]?\s*(?:\d{1,3}|[a-zA-Z]{1,2}|[ivxlcIVXLC]{1,5}|[-–—•·*])\s*[\)\].°]?$")
FEW_HEADINGS, MANY_PARAGRAPHS = 3, 50


def unseen(attrs: dict[str, str]) -> bool:
    """Whether the attributes hide an element from readers."""
    style = "".join(attrs.get("style", "").lower().split())
    return attrs.get("hidden") in ("", "hidden", "true") or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class _Semantic(HTMLParser):
    """Blocks of a page: text between block tags, headings, tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.text: list[str] = []
        self.drop: list[str] = []
        self.title: list[str] = []
        self.in_title = False
        self.level: int | None = None
        self.tables: list[list[list[list[str]]]] = []  # open tables; rows of cells of text parts
        self.note: dict[str, str] = {}
        self.wiki = False

    def flush(self) -> None:
        text, self.text = clean("".join(self.text)), []
        if not text:
            return
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1].append(text)
        elif self.level:
            self.blocks.append(("heading", text, self.level))
        else:
            self.blocks.append(("para", text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.drop:
            if tag not in VOID:
                self.drop.append(tag)
            return
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").lower().split())
        self.wiki = self.wiki or any(c.startswith("mw-") for c in classes)
        if tag in MATH_TAGS:
            self.text.append(" ")
            self.note["math_stripped"] = "true"
        other = tag in DROP_TAGS | MATH_TAGS or unseen(a) or classes & DROP_CLASSES or a.get("id") in DROP_IDS or a.get("role", "").lower() in DROP_ROLES
        boxed = tag == "table" and classes & DROP_TABLES
        if other or boxed:
            if not other:
                self.note["infobox_dropped"] = str(int(self.note.get("infobox_dropped", 0)) + 1)
            if tag not in VOID:
                self.drop = [tag]
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.text.append(" ")
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.flush()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.flush()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append([])
        elif tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.drop:
            if tag in self.drop:
                del self.drop[len(self.drop) - 1 - self.drop[::-1].index(tag) :]
            return
        if tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = None
        elif tag == "table" and self.tables:
            self.flush()
            rows = [[" ".join(c) for c in r] for r in self.tables.pop()]
            if self.tables and self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += [c for r in rows for c in r if c]
            elif rows:
                self.blocks.append(("table", rows))
        elif tag in ("td", "th", "tr") or tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.drop:
            self.text.append(data)


def without_sections(blocks: list[tuple]) -> list[tuple]:
    """Reference and link sections go, up to the next heading of their level or above."""
    out, below = [], None
    for b in blocks:
        if b[0] == "heading":
            if below is not None and b[2] <= below:
                below = None
            if below is None and clean(b[1]).lower().strip(" :：.") in DROP_SECTIONS:
                below = b[2]
        if below is None:
            out.append(b)
    return out


def is_layout(rows: list[list[str]]) -> bool:
    """One row, or a column of short numbers beside long text: layout, not data."""
    full = [r for r in rows if any(r)]
    if len(rows) == 1:
        return True
    if not full or any(len(r) != 2 for r in full):
        return False
    return all(NUMBER_CELL.match(r[0].strip()) for r in full) and sum(len(r[1]) for r in full) / len(full) > 40


def from_html(page: str | bytes) -> Truth:
    """Truth of a page whose markup is semantic; headings are unknown where they are unlikely."""
    from foliospark.sources.html_tree import decode

    p = _Semantic()
    p.feed(decode(page) if isinstance(page, bytes) else page)
    p.close()
    p.flush()
    mark = lambda s: clean(REFERENCE_MARK.sub(" ", EDIT_MARK.sub(" ", s)) if p.wiki else EDIT_MARK.sub(" ", s))
    out: list[tuple] = []
    for kind, body, *more in without_sections(p.blocks):
        if kind != "table":
            out.append((kind, mark(body), *more))
            continue
        rows = [[mark(c) for c in r] for r in body]
        if sum(1 for r in rows for c in r if c) < 2:
            out.append(("para", " ".join(c for r in rows for c in r if c)))
        elif is_layout(rows):
            out += [("para", " ".join(filter(None, r))) for r in rows]
        else:
            out.append(("table", rows))
    out = [b for b in out if b[0] == "table" or b[1]]
    title = clean("".join(p.title))
    if title and not any(b[0] == "heading" for b in out):
        out.insert(0, ("heading", title, 1))
    heads = sum(b[0] == "heading" for b in out)
    paras = sum(b[0] == "para" for b in out)
    note = p.note | ({"wikipedia_cleanup": "true"} if p.wiki else {})
    return Truth(out, note, bool(heads) and not (heads < FEW_HEADINGS and paras > MANY_PARAGRAPHS))


# LaTeX

# Environments and commands by what becomes of them.
MATH_ENVS = (
    "equation", "displaymath", "eqnarray", "align", "alignat", "flalign", "gather", "multline", "math", "dmath", "IEEEeqnarray", "subequations", "split", "cases",
)
TABULARS = ("tabular", "longtable", "tabularx", "supertabular", "array")
FLOATS = ("figure", "table", "wrapfigure", "wraptable", "sidewaysfigure", "sidewaystable", "SCfigure", "subfigure")
DROPPED_ENVS = ("thebibliography", "tikzpicture", "picture", "comment", "filecontents", "algorithm", "algorithmic", "algorithm2e", "pgfpicture")
SECTIONS = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
SIGNS = {
    "&": "&", "%": "%", "$": "$", "#": "#", "_": "_", "{": "{", "}": "}", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å",
    "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "ldots": "…", "dots": "…", "textellipsis": "…", "textendash": "–", "textemdash": "—",
    "textbackslash": "\\", "textasciitilde": "~", "textquotedblleft": "“", "textquotedblright": "”", "textquoteleft": "‘", "textquoteright": "’", "copyright": "©",
    "textcopyright": "©", "textregistered": "®", "pounds": "£", "euro": "€", "texteuro": "€", "degree": "°", "textdegree": "°", "textbullet": "•", "S": "§", "P": "¶",
    "dag": "†", "ddag": "‡",
}
ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327",
    "k": "\u0328", "b": "\u0331", "d": "\u0323", "r": "\u030a", "t": "\u0361",
}
KEPT_SECOND = {"textcolor", "href"}
DROPPED_ARGS = {
    "label": 1, "cite": 1, "citep": 1, "citet": 1, "citealp": 1, "citealt": 1, "citeauthor": 1, "citeyear": 1, "nocite": 1, "ref": 1, "eqref": 1, "pageref": 1, "autoref": 1,
    "cref": 1, "Cref": 1, "index": 1, "vspace": 1, "hspace": 1, "setlength": 2, "addtolength": 2, "bibliographystyle": 1, "bibliography": 1, "usepackage": 1,
    "documentclass": 1, "newcommand": 2, "renewcommand": 2, "providecommand": 2, "input": 1, "include": 1, "includegraphics": 1, "graphicspath": 1, "thanks": 1,
    "affiliation": 1, "institute": 1, "email": 1, "pagestyle": 1, "thispagestyle": 1, "hypersetup": 1, "geometry": 1, "captionsetup": 1, "linespread": 1, "cmidrule": 1, "cline": 1,
}
MOST_INPUTS = 8
_COMMAND = re.compile(r"\\(?:([A-Za-z@]+)\*?|(.))", re.S)


def _group(s: str, at: int) -> tuple[str, int]:
    """The argument at or after ``at`` (options skipped) and where it ends."""
    while m := re.compile(r"\s*\[[^\[\]]*\]").match(s, at):
        at = m.end()
    m = re.compile(r"\s*").match(s, at)
    at = m.end()
    if at >= len(s):
        return "", at
    if s[at] != "{":
        m = _COMMAND.match(s, at)
        return (m[0], m.end()) if m else (s[at], at + 1)
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(s, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth:
            return s[at + 1 : m.start()], m.end()
    return s[at + 1 :], len(s)


def tex_text(s: str) -> str:
    """Readable text of LaTeX without formulas."""
    out: list[str] = []
    at = 0
    for _ in range(len(s) + 1):
        m = re.compile(r"\\|[{}~&]|---?|``|''").search(s, at)
        if m is None:
            out.append(s[at:])
            break
        out.append(s[at : m.start()])
        at = m.end()
        if m[0] != "\\":
            out.append({"{": "", "}": "", "~": " ", "&": " ", "---": "—", "--": "–", "``": "“", "''": "”", "-": "-"}[m[0]])
            continue
        c = _COMMAND.match(s, at - 1)
        if c is None:
            break
        name, at = c[1] or c[2], c.end()
        if c[2] == "\\":
            at = (o.end() if (o := re.compile(r"\s*\[[^\]]*\]").match(s, at)) else at)
            out.append(" ")
        elif name in ACCENTS and (c[2] or len(name) == 1):
            arg, at = _group(s, at)
            out.append(unicodedata.normalize("NFC", tex_text(arg) + ACCENTS[name]))
        elif name in SIGNS:
            out.append(SIGNS[name])
            if c[1] and at < len(s) and s[at] == " ":
                at += 1
        elif c[2]:
            out.append("" if name == "-" else " ")
        elif name in DROPPED_ARGS:
            for _k in range(DROPPED_ARGS[name]):
                _, at = _group(s, at)
            out.append(" ")
        elif name in KEPT_SECOND:
            _, at = _group(s, at)
            arg, at = _group(s, at)
            out.append(f" {tex_text(arg)} ")
        else:  # formatting and unknown commands: the text in their argument stays
            at = (o.end() if (o := re.compile(r"\s*\[[^\[\]]*\]").match(s, at)) else at)
            out.append(" ")
    return re.sub(r" +([,.;:!?%)\]}»”’])", r"\1", clean("".join(out)))


def _environment(s: str, names: tuple[str, ...], at: int = 0) -> tuple[int, str, str, int] | None:
    """(start, name, body, end) of the first environment of these names, nesting counted."""
    one = "|".join(re.escape(n) for n in names)
    m = re.compile(rf"\\begin\s*\{{({one})(\*?)\}}").search(s, at)
    if m is None:
        return None
    name, depth = m[1] + m[2], 1
    for x in re.compile(rf"\\(begin|end)\s*\{{{re.escape(name)}\}}").finditer(s, m.end()):
        depth += 1 if x[1] == "begin" else -1
        if not depth:
            return m.start(), name, s[m.end() : x.start()], x.end()
    return m.start(), name, s[m.end() :], len(s)


def _replace(s: str, names: tuple[str, ...], to) -> str:
    while f := _environment(s, names):
        s = s[: f[0]] + to(f[1], f[2]) + s[f[3] :]
    return s


def strip_formulas(s: str) -> tuple[str, int]:
    """Every formula becomes a blank; and how many there were."""
    n = 0

    def gone(*_: object) -> str:
        nonlocal n
        n += 1
        return " "

    s = _replace(s, MATH_ENVS, gone)
    for pattern in (r"\$\$.*?\$\$", r"\\\[.*?\\\]", r"\\\(.*?\\\)", r"(?<!\\)\$(?:\\.|[^$\\])*?\$"):
        s = re.sub(pattern, gone, s, flags=re.S)
    return s, n


def _tabular(body: str) -> list[list[str]]:
    _, at = _group(body, 0)
    rows = re.split(r"\\\\(?:\s*\[[^\]]*\])?|\\tabularnewline", body[at:])
    grid = [[tex_text(c) for c in re.split(r"(?<!\\)&", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\(?:cline|cmidrule)(?:\([^)]*\))?\{[^}]*\}", " ", r))] for r in rows]
    return [r for r in grid if any(r)]


def tex_sources(raw: bytes) -> dict[str, str]:
    """The .tex files in a tar, a gzip or a plain file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            return {m.name.removeprefix("./"): t.extractfile(m).read().decode("utf-8", "replace") for m in t if m.isfile() and m.name.endswith(".tex")}
    except tarfile.TarError:
        return {"main.tex": raw.decode("utf-8", "replace")}


def _inlined(files: dict[str, str], name: str, depth: int = 0) -> str:
    text = re.sub(r"(?<!\\)((?:\\\\)*)%.*", r"\1", files.get(name, files.get(f"{name}.tex", "")))
    if depth >= MOST_INPUTS:
        return text
    return re.sub(r"\\(?:input|include)\s*\{([^}]*)\}", lambda m: _inlined(files, m[1].strip().removeprefix("./"), depth + 1), text)


def from_latex(raw: bytes | str) -> Truth:
    """Truth of a LaTeX document: sections, paragraphs, tables; floats leave their caption."""
    files = tex_sources(raw) if isinstance(raw, bytes) else {"main.tex": raw}
    main = max(files, key=lambda k: ("\\documentclass" in files[k], "\\begin{document}" in files[k], len(files[k])), default="")
    src = _inlined(files, main)
    title = m and _group(src, m.end())[0] if (m := re.search(r"\\title\b", src)) else ""
    body = (f := _environment(src, ("document",))) and f[2] or src
    body = _replace(body, DROPPED_ENVS, lambda *_: "\n\n")
    tables: list[list[list[str]]] = []

    def keep(_: str, inner: str) -> str:
        if rows := _tabular(strip_formulas(inner)[0]):
            tables.append(rows)
            return f"\n\n@@table{len(tables) - 1}@@\n\n"
        return " "

    body = _replace(body, TABULARS, keep)
    captions = lambda inner: "\n\n".join(_group(inner, m.end())[0] for m in re.finditer(r"\\caption\b", inner))
    body = _replace(body, FLOATS, lambda _, inner: "\n\n" + captions(inner) + "\n\n" + "\n\n".join(re.findall(r"@@table\d+@@", inner)) + "\n\n")
    body, n = strip_formulas(body)
    body = re.sub(r"\\(?:begin|end)\s*\{[^}]*\}(?:\[[^\]]*\])?", "\n\n", body)
    body = re.sub(r"\\item\b(?:\s*\[[^\]]*\])?", "\n\n", body)
    present = [s for s in SECTIONS if re.search(rf"\\{s}\b", body)]
    shift = SECTIONS.index(present[0]) if present else 0
    blocks: list[tuple] = [("heading", t, 1)] if (t := tex_text(strip_formulas(title)[0])) else []
    at = 0
    for m in [*re.finditer(rf"\\({'|'.join(SECTIONS)})\b\*?", body), None]:
        for part in re.split(r"\n\s*\n", body[at : m.start() if m else len(body)]):
            if x := re.fullmatch(r"\s*@@table(\d+)@@\s*", part):
                blocks.append(("table", tables[int(x[1])]))
            elif t := tex_text(part):
                blocks.append(("para", t))
        if m:
            head, at = _group(body, m.end())
            blocks.append(("heading", tex_text(head), SECTIONS.index(m[1]) - shift + 2))
    return Truth(blocks, {"math_stripped": "true"} if n else {})


# XML

ROWS, CELLS = {"row", "tr", "tablerow", "tableheaderrow"}, {"entry", "td", "th", "tablecolumn", "tableheadercolumn"}
TABLE_NAMES = {"table", "tablestruct", "informaltable"}
JP_PARTS = ("part", "chapter", "section", "subsection", "division", "article")
JP_LINES = {"paragraph", "item", "class", "amendprovision"} | {f"sublist{i}" for i in range(1, 4)} | {f"subitem{i}" for i in range(1, 11)}
LISTS = ("dl", "ul", "ol")


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _under(e: ET.Element, without: tuple[str, ...] = ()) -> str:
    parts = [e.text or ""]
    for c in e:
        if _name(c) not in without:
            parts.append(_under(c, without))
        parts.append(c.tail or "")
    return clean(" ".join(parts))


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if _name(c) == name), None) if e is not None else None
    return e


def _said(e: ET.Element | None, name: str) -> str:
    c = _child(e, name)
    return _under(c) if c is not None else ""


def _rows(e: ET.Element) -> list[list[str]]:
    rows = [[_under(c) for c in r if _name(c) in CELLS] or [_under(c) for c in r] for r in e.iter() if _name(r) in ROWS]
    return [r for r in rows if any(r)]


def read_xml(raw: bytes) -> ET.Element:
    """The root; of a zip the largest member; unknown entities become their character."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            raw = z.read(max((i for i in z.infolist() if i.filename.endswith(".xml")), key=lambda i: i.file_size))
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        text = raw.decode("utf-8", "replace")
        text = re.sub(r"^.*?(?=<)|<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", text, count=3, flags=re.S)
        named = lambda m: m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else html5.get(m[1] + ";", " ")
        return ET.fromstring(re.sub(r"&([A-Za-z][A-Za-z0-9]{1,31});", named, text).strip())


def _law_de(root: ET.Element) -> list[tuple]:
    out: list[tuple] = []
    level = 1

    def listed(e: ET.Element) -> None:
        number = ""
        for c in e:
            kind = _name(c)
            if kind == "dt":
                number = _under(c)
            elif kind in LISTS:
                listed(c)
            elif kind in TABLE_NAMES:
                out.append(("table", _rows(c)))
            else:
                out.append(("para", clean(f"{number} {_under(c, LISTS)}")))
                number = ""
                for inner in c:
                    if _name(inner) in LISTS:
                        listed(inner)
        if number:
            out.append(("para", number))

    for norm in (e for e in root.iter() if _name(e) == "norm"):
        meta = _child(norm, "metadaten")
        if not out and (title := next(filter(None, (_said(meta, k) for k in ("langue", "kurzue", "amtabk", "jurabk"))), "")):
            out.append(("heading", title, 1))
        if (unit := _child(meta, "gliederungseinheit")) is not None:
            level = min(5, 2 + max(0, len(_said(unit, "gliederungskennzahl")) // 3 - 1))
            out.append(("heading", f"{_said(unit, 'gliederungsbez')} {_said(unit, 'gliederungstitel')}", level))
        out.append(("heading", f"{_said(meta, 'enbez')} {_said(meta, 'titel')}", min(6, level + 1)))
        for c in _child(norm, "textdaten", "text", "content") or ():
            if _name(c) in TABLE_NAMES:
                out.append(("table", _rows(c)))
            elif _name(c) in LISTS:
                listed(c)
            elif _name(c) not in ("toc", "footnotes", "kommentar"):
                out.append(("para", _under(c)))
    return out


def _law_jp(root: ET.Element) -> list[tuple]:
    out: list[tuple] = []
    scope = next((e for e in root.iter() if _name(e) == "lawbody"), root)
    if title := next((_under(e) for e in scope.iter() if _name(e) == "lawtitle"), ""):
        out.append(("heading", title, 1))
    if number := next((_under(e) for e in root.iter() if _name(e) == "lawnum"), ""):
        out.append(("para", number))

    def walk(e: ET.Element, depth: int, used: frozenset = frozenset()) -> None:
        for c in e:
            kind = _name(c)
            if id(c) in used or kind in ("toc", "lawtitle", "lawnum"):
                continue
            if kind in TABLE_NAMES:
                out.extend(("para", _under(t)) for t in c if kind == "tablestruct" and _name(t).endswith(("title", "caption")))
                out.append(("table", _rows(c)))
            elif kind in JP_PARTS:
                heads = [t for k in ("title", "caption") for t in c if _name(t) == kind + k]
                out.append(("heading", " ".join(map(_under, heads)), min(6, depth + 1)))
                walk(c, depth + 1, frozenset(map(id, heads)))
            elif kind in JP_LINES:
                own = [t for t in c if _name(t).endswith(("sentence", "num")) or _name(t) in ("column", kind + "title")]
                out.append(("para", " ".join(map(_under, own))))
                walk(c, depth + 1, frozenset(map(id, own)))
            elif kind.endswith(("sentence", "num")) or kind == "column" or not len(c):
                is_head = kind.endswith(("title", "caption", "label")) and not len(c)
                out.append(("heading", _under(c), min(6, depth + 1)) if is_head else ("para", _under(c)))
            else:
                walk(c, depth)

    walk(scope, 1)
    return out


def _plain_xml(root: ET.Element, depth: int = 1) -> list[tuple]:
    out: list[tuple] = []
    for c in root:
        if _name(c) in TABLE_NAMES:
            out.append(("table", _rows(c)))
        elif len(c):
            out += _plain_xml(c, depth + 1)
        elif re.search(r"(title|caption|heading|titel|bez|ueberschrift)$", _name(c)):
            out.append(("heading", _under(c), min(6, depth)))
        elif _name(c) not in ("script", "style"):
            out.append(("para", _under(c)))
    return out


def from_xml(raw: bytes | str) -> Truth:
    """Truth of an XML document by its dialect."""
    root = read_xml(raw.encode() if isinstance(raw, str) else raw)
    names = {_name(e) for e in root.iter()}
    dialect, reader = ("gii-norm", _law_de) if "norm" in names and "metadaten" in names else ("egov-jp", _law_jp) if names & {"lawbody", "lawtitle"} else ("generic", _plain_xml)
    return Truth([b for b in reader(root) if b[0] == "table" or clean(b[1])], {"dialect": dialect})


PARSERS = {"html": from_html, "latex": from_latex, "xml": from_xml}


def parse_truth(sources: DataFrame, kind: str = "kind", content: str = "content") -> DataFrame:
    """``sources`` with the truth columns; a source that cannot be read has a note ``error``."""

    def parse(kind: str | None, raw: bytes | str | None) -> dict:
        try:
            row = PARSERS[kind](raw).row()
        except Exception as e:  # one bad source must not fail the others
            row = {"text": None, "headings": None, "heading_levels": None, "paragraphs": None, "tables": None, "note": {"error": f"{type(e).__name__}: {e}"}}
        return row | {"note": list(row["note"].items())}

    parsed = by_row(parse, T.StructType.fromDDL(SCHEMA))(F.col(kind), F.col(content))
    return sources.withColumn("t", parsed).select(*[c for c in sources.columns if c != content], "t.*")
