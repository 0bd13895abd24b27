"""Small office files with known content, for tests and for the corpus of exact truths."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def _rels(targets: dict[str, str]) -> str:
    return f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def docx(parts: list) -> bytes:
    """A document of (style name or None, text) paragraphs and of grids (lists of rows)."""
    styles = {p[0] for p in parts if isinstance(p, tuple) and p[0]}
    ids = {s: s.replace(" ", "") for s in styles}
    para = lambda t, s=None: "<w:p>" + (f'<w:pPr><w:pStyle w:val="{ids[s]}"/></w:pPr>' if s else "") + f"<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    grid = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = "".join(grid(p) if isinstance(p, list) else para(p[1], p[0]) for p in parts)
    named = "".join(f'<w:style w:styleId="{v}"><w:name w:val="{k}"/></w:style>' for k, v in sorted(ids.items()))
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{named}</w:styles>"})


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets of rows of strings, numbers and None."""

    def cell(v: object, r: int, c: int) -> str:
        at = f'r="{chr(65 + c)}{r}"'
        if v is None:
            return ""
        return f"<c {at}><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c {at} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    files, tabs, targets = {}, "", {}
    for k, (name, rows) in enumerate(sheets.items(), 1):
        body = "".join(f'<row r="{i}">' + "".join(cell(v, i, j) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>"
        tabs += f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>'
        targets[f"rId{k}"] = f"worksheets/sheet{k}.xml"
    return _zip({"xl/workbook.xml": f"<workbook {_S}><sheets>{tabs}</sheets></workbook>", "xl/_rels/workbook.xml.rels": _rels(targets), **files})


def pptx(slides: list[tuple[str, list[str], str]]) -> bytes:
    """A show of (title, paragraphs, notes) slides."""
    shape = lambda kind, texts: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in texts) + "</p:txBody></p:sp>"
    files, ids, targets = {}, "", {}
    for k, (title, texts, notes) in enumerate(slides, 1):
        tree = shape("title", [title]) + (shape("body", texts) if texts else "")
        files[f"ppt/slides/slide{k}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        if notes:
            files[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels({"rId1": f"../notesSlides/notesSlide{k}.xml"})
            files[f"ppt/notesSlides/notesSlide{k}.xml"] = f"<p:notes {_P}><p:cSld><p:spTree>{shape('body', [notes])}</p:spTree></p:cSld></p:notes>"
        ids += f'<p:sldId id="{255 + k}" r:id="rId{k}"/>'
        targets[f"rId{k}"] = f"slides/slide{k}.xml"
    return _zip({"ppt/presentation.xml": f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _rels(targets), **files})
