"""Documents in, nodes out: parsers behind one Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.rowwise import by_row
from foliospark.sources.html_tree import parse_html
from foliospark.sources.nodes import PARSED, Parsed
from foliospark.sources.ooxml import parse_docx, parse_pptx, parse_xlsx

#: Parser of a file's bytes by its extension; add to it to read more kinds.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {"docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx, "html": parse_html, "htm": parse_html, "xhtml": parse_html}
SUPPORTED = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", *PARSERS)


def parse_one(kind: str | None, raw: bytes | str | None, parsers: dict | None = None) -> dict:
    """Nodes of one file; a failure is a row with its error, not a failed task."""
    parser = (parsers or PARSERS).get((kind or "").lower())
    if parser is None:
        return Parsed(error=f"no parser for {kind!r}").rows()
    try:
        return parser(bytes(raw) if isinstance(raw, (bytearray, memoryview)) else raw).rows()
    except Exception as e:  # one bad file must not fail the others
        return Parsed(error=f"{type(e).__name__}: {e}").rows()


def parse_documents(docs: DataFrame, kind: str = "ext", content: str = "content") -> DataFrame:
    """``docs`` with ``pages``, ``nodes`` and ``error``; filter before calling, not after."""
    parsed = by_row(parse_one, PARSED)(F.col(kind), F.col(content))
    return docs.withColumn("parsed", parsed).select(*docs.columns, "parsed.pages", "parsed.nodes", "parsed.error")


def html_nodes(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """node rows (doc_id, ord, type, level, page, content, items, grid) of HTML texts."""
    parsed = parse_documents(pages.select(F.col(id_col).alias("doc_id"), F.lit("html").alias("ext"), F.col(html).alias("content")))
    return parsed.select("doc_id", F.explode("nodes").alias("n")).select("doc_id", "n.*")
