"""Structure trees as a relation, against plain recursion over the same trees."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.operators import tree as T
from foliospark.plans import catalog
from foliospark.plans.registry import table
from foliospark.sources.parse import html_nodes
from tests.conftest import SF

SAY = ["plain words", "• bullet first", '(1) quote " and \\ and {brace}', "(2) " + "clause of some length " * 5, "(3) short one", "日本語 {", "", "  ", "(12) " + "é" * 90, "x"]


def _tree(r: random.Random, depth: int = 0) -> dict:
    kind = r.choice(["paragraph", "heading", "list", "list", "table", "frame", None])
    node: dict = {} if kind is None else {"type": kind}
    if r.random() < 0.7 and kind != "table":
        node["content"] = r.choice(["notes.pdf", "MUST", "Title"]) if kind == "heading" else r.choice(SAY)
    if r.random() < 0.5:
        node["page number"] = r.randint(1, 3)
    if kind == "heading":
        node["heading level"] = r.randint(1, 4)
    if r.random() < 0.2:
        node |= {"box": [1.5, 2], "tag": None, "deep": [[1], [2, 3]], "ok": True}
    more = depth < 4
    if kind == "list":
        node["list items"] = [{"type": "list item", "content": r.choice(SAY), **({"kids": [_tree(r, depth + 2)]} if more and r.random() < 0.4 else {})} for _ in range(r.randint(0, 5))]
        node["number of list items"] = len(node["list items"])
    elif kind == "table":
        node["rows"] = [{"row number": i, "cells": [{"content": r.choice(SAY)} if r.random() < 0.7 or not more else {"kids": [_tree(r, depth + 3)]} for _ in range(2)]} for i in range(r.randint(1, 3))]
    if more and r.random() < 0.5 and kind not in ("list", "table") or kind == "list" and r.random() < 0.1:
        node["kids"] = [_tree(r, depth + 1) for _ in range(r.randint(0, 3))]
    if r.random() < 0.1:
        node["caption"] = {"content": "below"}
    return node


def _trees(n: int = 60) -> list[tuple[int, object]]:
    r = random.Random(9)
    out: list[tuple[int, object]] = [(i, {"file name": "f", "kids": [_tree(r) for _ in range(r.randint(0, 5))]}) for i in range(n)]
    return [*out, (n, {}), (n + 1, [{"content": "top"}, {"kids": [{"content": "q"}]}]), (n + 2, []), (n + 3, "text"), (n + 4, {"a": {"b": {"c": [{"content": "far"}]}}})]


def _holds(v: object) -> bool:
    return isinstance(v, dict) or isinstance(v, list) and any(map(_holds, v))


def _walked(doc: int, tree: object) -> list[tuple]:
    rows: list[list] = []

    def visit(v: object, parent: int | None, depth: int, slot: str, many: bool) -> None:
        if isinstance(v, list):
            for x in v:
                if _holds(x):
                    visit(x, parent, depth, slot, True)
        elif isinstance(v, dict):
            at = len(rows)
            content, level, page = v.get("content"), v.get("heading level"), v.get("page number")
            rows.append([doc, at, at, parent, depth, slot, many, v.get("type"), level, page, content])
            for k in sorted(k for k in v if _holds(v[k])):
                visit(v[k], at, depth + 1, k, False)
            rows[at][2] = len(rows) - 1

    if _holds(tree):
        visit(tree, None, 0, "", False)
    return [tuple(r) for r in rows]


def _sorted(v: object) -> object:
    return {k: _sorted(v[k]) for k in sorted(v, key=lambda k: (_holds(v[k]), k))} if isinstance(v, dict) else [_sorted(x) for x in v] if isinstance(v, list) else v


NUMBERED = re.compile(r"\(\s*\d{1,3}\s*\)\s")


def _tidied(nodes: list) -> list:
    out = []
    for v in nodes:
        if "kids" in v:
            v = v | {"kids": _tidied(v["kids"])}
        if v.get("type") == "heading" and v.get("content") in ("notes.pdf", "MUST"):
            v = {k: x for k, x in v.items() if k != "heading level"} | {"type": "paragraph"}
        if v.get("type") != "list" or not v.get("list items"):
            out.append(v)
            continue
        items = [i | ({"content": i["content"].removeprefix("• ")} if i["content"].startswith("• ") else {}) for i in v["list items"]]
        para = [bool(NUMBERED.match(i["content"].strip())) for i in items]
        long = any(p and len(i["content"].strip()) > 80 for p, i in zip(para, items, strict=True))
        if sum(para) < 2 or not long or v.get("kids") or "caption" in v:
            out.append(v | {"list items": items})
            continue
        run: list = []
        for i, p in [*zip(items, para, strict=True), (None, True)]:
            if p and run:
                out.append(v | {"list items": run, "number of list items": len(run)})
                run = []
            if p and i:
                page = i.get("page number", v.get("page number"))
                out.append(i | {"type": "paragraph"} | ({} if page is None else {"page number": page}))
            elif i:
                run.append(i)
    return out


def _gathered(v: object) -> str:
    if isinstance(v, list):
        parts = [_gathered(x) for x in v]
    elif isinstance(v, dict):
        own = v.get("content")
        parts = [own.strip() if isinstance(own, str) else "", *[_gathered(v[k]) for k in sorted(v) if isinstance(v[k], (dict, list))]]
    else:
        parts = []
    return " ".join(p for p in parts if p)


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(i, json.dumps(t)) for i, t in _trees()] + [(900, "{broken"), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.try_parse_json("text").alias("tree"))
    return T.walk(df.repartition(3)).cache()


def test_walk_and_intervals(nodes):
    cols = ("doc_id", "pre", "upto", "parent", "depth", "slot", "many", "type", "level", "page", "content")
    want = [r for i, t in _trees() for r in _walked(i, t)]
    assert sorted(map(tuple, nodes.select(*cols).collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_trees_come_out_as_they_came_in(nodes):
    got = {r.doc_id: r.tree for r in T.tree_json(nodes).collect()}
    for i, t in _trees():
        assert (i in got) == _holds(t)
        if i in got:
            assert got[i] == json.dumps(_sorted(t), ensure_ascii=False, separators=(",", ":"))


def test_tidying_moves_whole_subtrees(nodes):
    tidy = T.tidy_tree(nodes).cache()
    got = {r.doc_id: json.loads(r.tree) for r in T.tree_json(tidy).collect()}
    for i, t in _trees():
        if isinstance(t, dict):
            want = t | {"kids": _tidied(t["kids"])} if "kids" in t else t
            assert got[i] == want, i
    # places and intervals are those of a walk over the result
    cols = ("doc_id", "pre", "upto", "parent", "depth", "slot")
    want = {i: [(r[0], *r[1:6]) for r in _walked(i, _sorted(t))] for i, t in got.items()}
    have: dict = {}
    for r in tidy.select(*cols).orderBy("doc_id", "pre").collect():
        have.setdefault(r.doc_id, []).append(tuple(r))
    assert have == want


def test_text_below_and_page_counts(nodes):
    got = {(r.doc_id, r.of): r.text for r in T.gather_text(nodes, nodes.where("depth = 0")).collect()}
    for i, t in _trees():
        tops = t if isinstance(t, list) else [t]
        texts = [got[i, at] for at in sorted(k for d, k in got if d == i)]
        assert texts == [_gathered(x) for x in tops if _holds(x)]
    chars = {r.doc_id: r.chars for r in T.text_chars(nodes).collect()}
    assert all(chars[i] == sum(ch.isalnum() for ch in _gathered(t)) for i, t in _trees() if _holds(t))
    stats = {(r.doc_id, r.page): (r.elements, r.chars) for r in T.tree_page_stats(nodes).collect()}
    want: dict = {}
    for i, t in _trees():
        for r in _walked(i, t):
            if r[7] and r[9] is not None:
                n, c = want.get((i, r[9]), (0, 0))
                want[i, r[9]] = (n + 1, c + len((r[10] or "").strip()))
    assert stats == want


def _blocks(v: dict) -> list[tuple]:
    kind, page, own = v.get("type"), v.get("page number"), (v.get("content") or "").strip()
    if kind == "heading":
        return [("heading", own)] if own else []
    if kind == "table":
        cells = [[_gathered(c).replace("|", "\\|") for c in row["cells"]] for row in v["rows"]]
        lines = ["| " + " | ".join(c) + " |" for c in cells]
        return [("table", "\n".join([lines[0], "|" + " --- |" * len(cells[0]), *lines[1:]]))]
    if kind == "list":
        return [("text", "- " + i["content"].strip()) for i in v["list items"] if i["content"].strip()]
    return ([("text", own)] if own else []) + [b for k in v.get("kids", []) for b in _blocks(k)]


def test_blocks_in_reading_order(nodes):
    got: dict = {}
    for r in T.flatten_tree(nodes).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text))
    for i, t in _trees():
        if isinstance(t, dict):
            assert got.get(i, []) == _blocks(t)


def test_empty(spark):
    none = T.walk(spark.createDataFrame([], "doc_id long, text string").select("doc_id", F.try_parse_json("text").alias("tree")))
    assert [f(none).count() for f in (T.tidy_tree, T.tree_json, T.flatten_tree, T.text_chars, T.tree_page_stats)] == [0] * 5
    assert T.gather_text(none, none).count() == 0


def test_page_trees_hold_the_parsed_nodes(spark):
    got = catalog.QUERIES["q_page_trees"](spark, SF).where("depth = 1 and slot = 'kids'")
    parsed = html_nodes(table(spark, SF, "pages"))
    row = lambda df, at: sorted((r.doc_id, r[at], r.type, r.level, r.page, r.content) for r in df.collect())
    have, want = row(got, "pre"), row(parsed, "ord")
    assert [(r[0], *r[2:]) for r in have] == [(r[0], *r[2:]) for r in want] and len(have) > 100
    items = catalog.QUERIES["q_page_trees"](spark, SF).where("slot = 'list items'").count()
    assert items == parsed.agg(F.sum(F.when(F.col("items").isNotNull(), F.size("items")))).head()[0]
