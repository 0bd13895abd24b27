"""Table functions for SQL: outline, sections, hits and chunks of a table of blocks.

    register(spark)
    SELECT * FROM doc_outline(TABLE(blocks))
    SELECT * FROM doc_section(TABLE(blocks), 'results')
    SELECT * FROM doc_hits(TABLE(blocks), 'two words') ORDER BY score DESC LIMIT 10
    SELECT * FROM doc_chunks(TABLE(blocks), 400)

The table has the columns doc_id (of any type), ord, kind, level, page and text. Each
function states by itself that a document's rows come together and in order, so a call
needs no PARTITION BY; hits look at one row at a time and shuffle nothing. Outlines hold
the open headings of one document only, sections the text asked for, chunks the chunk
being filled. Results are those of ``outline``, ``section_text``, ``search`` (without its
order and limit) and ``chunk``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliospark.operators.chunks import DEFAULT, LEAST, Packer, tokens

NEEDED = ("doc_id", "ord", "kind", "level", "page", "text")
DEEPEST = 6


def _analyzed(blocks: AnalyzeArgument, fields: list[tuple[str, object]], grouped: bool = True) -> AnalyzeResult:
    """The schema of a result whose first column is the table's doc_id."""
    if not blocks.isTable:
        raise ValueError("the first argument is a table of blocks: TABLE(...)")
    if missing := [c for c in NEEDED if c not in blocks.dataType.names]:
        raise ValueError(f"the table of blocks lacks {', '.join(missing)}")
    out = StructType().add("doc_id", blocks.dataType["doc_id"].dataType)
    for name, kind in fields:
        out = out.add(name, kind)
    return AnalyzeResult(out, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("ord")]) if grouped else AnalyzeResult(out)


def _constant(a: AnalyzeArgument | None, what: str) -> object:
    if a is None or a.value is None:
        raise ValueError(f"{what} must be given as a constant")
    return a.value


class Outline:
    """Headings with the tokens of their sections; text before the first one is a row of level 0."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(blocks, [("ord", IntegerType()), ("level", IntegerType()), ("title", StringType()), ("page", IntegerType()), ("tokens", LongType())])

    def __init__(self):
        self.open: list[tuple[int, tuple, int]] = []  # level, row, tokens before
        self.sum, self.headed, self.preface = 0, False, None

    def _closed(self, level: int) -> Iterator[tuple]:
        while self.open and self.open[-1][0] >= level:
            _, row, before = self.open.pop()
            yield (*row, self.sum - before)

    def eval(self, row: Row) -> Iterator[tuple]:
        if row.kind == "heading":
            yield from self._closed(min(row.level, DEEPEST))
            self.open.append((min(row.level, DEEPEST), (row.doc_id, row.ord, row.level, row.text, row.page), self.sum))
            self.headed = True
        elif not self.headed:
            doc, at, page, n = self.preface or (row.doc_id, row.ord, None, 0)
            pages = [p for p in (page, row.page) if p is not None]
            self.preface = (doc, at, min(pages) if pages else None, n + tokens(row.text))
        self.sum += tokens(row.text)

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed(0)
        if self.preface:
            doc, at, page, n = self.preface
            yield doc, at, 0, None, page, n


class Section:
    """The sections that a name means, as Markdown; exact titles of a document replace partial ones."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if not str(_constant(name, "the name of a section")).strip():
            raise ValueError("the name of a section is empty")
        return _analyzed(blocks, [("title", StringType()), ("page", IntegerType()), ("last_page", IntegerType()), ("tokens", LongType()), ("markdown", StringType())])

    def __init__(self):
        self.open: list[tuple[int, list]] = []
        self.exact, self.partial = [], []

    def eval(self, row: Row, name: str) -> None:
        want = name.strip().lower()
        if row.kind == "heading":
            level = min(row.level, DEEPEST)
            self.open = [x for x in self.open if x[0] < level]
            low = row.text.strip().lower()
            if want in low:
                found = [row.doc_id, row.text, [], 0, []]
                (self.exact if low == want else self.partial).append(found)
                self.open.append((level, found))
        text = f"{'#' * min(row.level, DEEPEST)} {row.text}" if row.kind == "heading" else row.text
        for _, found in self.open:
            found[2] += [] if row.page is None else [row.page]
            found[3] += tokens(row.text)
            found[4].append(text)

    def terminate(self) -> Iterator[tuple]:
        for doc, title, pages, n, texts in self.exact or self.partial:
            yield doc, title, min(pages, default=None), max(pages, default=None), n, "\n\n".join(texts)


class Hits:
    """Blocks that hold every term, how often, and the text around the first term."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        if not str(_constant(query, "the query")).split():
            raise ValueError("empty query")
        return _analyzed(blocks, [("ord", IntegerType()), ("page", IntegerType()), ("score", IntegerType()), ("snippet", StringType())], grouped=False)

    def eval(self, row: Row, query: str) -> Iterator[tuple]:
        terms, low = query.lower().split(), row.text.lower()
        if all(t in low for t in terms):
            flat = re.sub(r"^ | $", "", re.sub(r"\s+", " ", row.text))
            start = max(flat.lower().find(terms[0]) - 80, 0)
            clip = ("…" if start else "") + flat[start : start + 240] + ("…" if start + 240 < len(flat) else "")
            yield row.doc_id, row.ord, row.page, sum(low.count(t) for t in terms), clip


class Chunks:
    """Retrieval chunks of near so many tokens."""

    @staticmethod
    def analyze(blocks: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if most is not None:
            _constant(most, "the size of a chunk")
        fields = [("chunk", IntegerType()), ("pages", ArrayType(IntegerType())), ("heading_path", ArrayType(StringType())), ("tokens", IntegerType()), ("content", StringType())]
        return _analyzed(blocks, fields)

    def __init__(self):
        self.packer, self.doc, self.given = None, None, 0

    def _filled(self) -> Iterator[tuple]:
        for c in self.packer.chunks[self.given :]:
            yield self.doc, c["chunk"], c["pages"], c["heading_path"], c["tokens"], c["content"]
        self.packer.chunks[self.given :] = [{}] * (len(self.packer.chunks) - self.given)  # their number stays
        self.given = len(self.packer.chunks)

    def eval(self, row: Row, most: int = DEFAULT) -> Iterator[tuple]:
        if self.packer is None:
            self.packer, self.doc = Packer(max(most, LEAST)), row.doc_id
        self.packer.block(row.kind, row.level, row.page, row.text)
        yield from self._filled()

    def terminate(self) -> Iterator[tuple]:
        if self.packer is not None:
            self.packer.close()
            yield from self._filled()


FUNCTIONS = {"doc_outline": Outline, "doc_section": Section, "doc_hits": Hits, "doc_chunks": Chunks}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    from pyspark.sql.functions import udtf

    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
