"""Office files (docx, xlsx, pptx) to structure nodes, from the zip of XML that they are."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from foliospark.sources.nodes import Node, Parsed, bullet_list, heading, paragraph, table

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of spreadsheets that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}
NOTES_PREFIX = "Notes: "


class OfficeError(ValueError):
    """A file that cannot be read."""


def _open(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise OfficeError(f"not an office file: {e}") from e


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    folder, name = posixpath.split(part)
    rels = _xml(z, f"{folder}/_rels/{name}.rels")
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/") for r in rels} if rels is not None else {}


def heading_level(style: str | None) -> int | None:
    """Level of a paragraph style: Title 1, Heading N N, Heading 1."""
    style = (style or "").strip()
    if style.lower() == "title":
        return 1
    if m := re.fullmatch(r"heading\s*(\d*)", style, re.I):
        return int(m[1] or 1)
    return None


def _docx_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out).strip()


def parse_docx(raw: bytes) -> Parsed:
    """Body in order: headings by style, list styles gathered, tables as grids."""
    with _open(raw) as z:
        body = _xml(z, "word/document.xml")
        if body is None:
            raise OfficeError("no document part")
        styles = _xml(z, "word/styles.xml")
    named = {s.get(f"{_W}styleId"): (n.get(f"{_W}val") if (n := s.find(f"{_W}name")) is not None else None) for s in styles.iter(f"{_W}style")} if styles is not None else {}
    nodes: list[Node] = []
    items: list[str] = []

    def settle() -> None:
        if items:
            nodes.append(bullet_list(list(items)))
            items.clear()

    for e in body.find(f"{_W}body") or ():
        if e.tag == f"{_W}p":
            text = _docx_text(e)
            ref = e.find(f"{_W}pPr/{_W}pStyle")
            style = named.get(ref.get(f"{_W}val"), ref.get(f"{_W}val")) if ref is not None else None
            if not text:
                continue
            if level := heading_level(style):
                settle()
                nodes.append(heading(text, level))
            elif "list" in (style or "").lower():
                items.append(text)
            else:
                settle()
                nodes.append(paragraph(text))
        elif e.tag == f"{_W}tbl":
            settle()
            rows = [["\n".join(filter(None, map(_docx_text, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if rows:
                nodes.append(table(rows))
    settle()
    return Parsed(nodes)


def cell_text(value: object) -> str:
    """A spreadsheet value as text: whole floats without .0, dates in ISO form."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    styles = _xml(z, "xl/styles.xml")
    if styles is None:
        return []
    own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
    is_date = lambda k: k in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")), re.I))
    xfs = styles.find(f"{_S}cellXfs")
    return [is_date(int(x.get("numFmtId", 0))) for x in xfs] if xfs is not None else []


def _value(c: ET.Element, shared: list[str], dates: list[bool]) -> object:
    kind, v = c.get("t", "n"), c.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    style = int(c.get("s", 0))
    if style < len(dates) and dates[style]:
        return dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(number * 86400))
    return number if "." in v.text or "e" in v.text.lower() else int(v.text)


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Without empty rows at the end and empty columns on the right; padded."""
    while rows and not any(rows[-1]):
        rows.pop()
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    return [(r + [""] * width)[:width] for r in rows]


def parse_xlsx(raw: bytes) -> Parsed:
    """Each sheet is a page: its title, then its cells as one table."""
    nodes: list[Node] = []
    with _open(raw) as z:
        book = _xml(z, "xl/workbook.xml")
        if book is None:
            raise OfficeError("no workbook part")
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings] if strings is not None else []
        targets, dates = _related(z, "xl/workbook.xml"), _date_styles(z)
        sheets = list(book.iter(f"{_S}sheet"))
        for page, sheet in enumerate(sheets, 1):
            nodes.append(heading(sheet.get("name", ""), 1, page))
            root = _xml(z, targets.get(sheet.get(f"{_R}id", ""), ""))
            rows: list[list[str]] = []
            for r in root.iter(f"{_S}row") if root is not None else ():
                at = int(r.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - len(rows))]
                for k, c in enumerate(r.findall(f"{_S}c")):
                    j = _column(c.get("r", "")) if c.get("r") else k
                    rows[at - 1] += [""] * (j + 1 - len(rows[at - 1]))
                    rows[at - 1][j] = cell_text(_value(c, shared, dates))
            if grid := trimmed(rows):
                nodes.append(table(grid, page))
    return Parsed(nodes, len(sheets))


def parse_pptx(raw: bytes) -> Parsed:
    """Each slide is a page: title, paragraphs and tables, then the speaker's notes."""
    nodes: list[Node] = []
    lines = lambda e: [t for p in e.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]
    with _open(raw) as z:
        show = _xml(z, "ppt/presentation.xml")
        if show is None:
            raise OfficeError("no presentation part")
        targets = _related(z, "ppt/presentation.xml")
        slides = [targets.get(s.get(f"{_R}id", ""), "") for s in show.iter(f"{_P}sldId")]
        for page, name in enumerate(slides, 1):
            slide = _xml(z, name)
            tree = slide.find(f"{_P}cSld/{_P}spTree") if slide is not None else None
            for shape in tree if tree is not None else ():
                if shape.tag == f"{_P}graphicFrame":
                    rows = [["\n".join(lines(c)) for c in r.findall(f"{_A}tc")] for r in shape.iter(f"{_A}tr")]
                    if rows:
                        nodes.append(table(rows, page))
                    continue
                place = shape.find(f".//{_P}nvPr/{_P}ph")
                texts = lines(shape)
                if place is not None and place.get("type") in ("title", "ctrTitle") and texts:
                    nodes.append(heading(texts[0], 2, page))
                    texts = texts[1:]
                nodes += [paragraph(t, page) for t in texts]
            for target in _related(z, name).values():
                if "notesSlide" in target and (notes := _xml(z, target)) is not None:
                    for shape in notes.iter(f"{_P}sp"):
                        place = shape.find(f".//{_P}nvPr/{_P}ph")
                        if place is not None and place.get("type") == "body" and (texts := lines(shape)):
                            nodes.append(paragraph(NOTES_PREFIX + " ".join(texts), page))
    return Parsed(nodes, len(slides))
