"""Structure nodes: what every reader gives, and the schema they have in Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("grid", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
PARSED = T.StructType([T.StructField("pages", T.IntegerType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("error", T.StringType())])


@dataclass
class Node:
    """A heading, paragraph, list or table; its place in the document is its order."""

    type: str
    page: int = 1
    content: str | None = None
    level: int | None = None
    items: list[str] | None = None
    grid: list[list[str]] | None = None


@dataclass
class Parsed:
    """A document's nodes, or why there are none."""

    nodes: list[Node] = field(default_factory=list)
    pages: int = 1
    error: str | None = None

    def rows(self) -> dict:
        nodes = [{"ord": i, "type": n.type, "level": n.level, "page": n.page, "content": n.content, "items": n.items, "grid": n.grid} for i, n in enumerate(self.nodes)]
        return {"pages": max(1, self.pages), "nodes": nodes, "error": self.error}


def heading(text: str, level: int, page: int = 1) -> Node:
    return Node("heading", page, text, min(max(level, 1), 6))


def paragraph(text: str, page: int = 1) -> Node:
    return Node("paragraph", page, text)


def bullet_list(items: list[str], page: int = 1) -> Node:
    return Node("list", page, items=items)


def table(rows: list[list[str]], page: int = 1) -> Node:
    """Rows padded to the widest."""
    width = max(map(len, rows), default=0)
    return Node("table", page, grid=[r + [""] * (width - len(r)) for r in rows])
