"""Native and windowed forms against plain Python folds, and literal edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import rtl, text
from foliospark.operators import blocks, chunks, evaluate, ledger, qa, render
from foliospark.sources import files, html_tree, ooxml, synthetic, truth
from foliospark.streaming import watch

BLOCK = "doc_id int, ord int, kind string, level int, page int, text string"


def _random_blocks(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for d in range(8):
        for i in range(1, n // 8 + 1):
            head = r.random() < 0.3
            out.append((d, i, "heading" if head else "text", r.randint(1, 7) if head else None, i // 10 + 1, f"t{d}.{i}" * r.randint(1, 9)))
    return out


def test_heading_paths_equal_the_stack_fold(spark):
    rows = _random_blocks(3)
    want, stack, last = {}, [], None
    for d, i, kind, level, _, t in rows:
        stack = [] if d != last else stack
        last = d
        if kind == "heading":
            level = min(level, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, t))
        want[d, i] = [x for _, x in stack]
    got = blocks.with_path(spark.createDataFrame(rows, BLOCK)).collect()
    assert {(r.doc_id, r.ord): list(r.path) for r in got} == want


def test_section_ends_and_tokens_equal_a_loop(spark):
    rows = _random_blocks(4)
    got = {(r.doc_id, r.ord): (r.section_end, r.section_tokens) for r in blocks.with_sections(spark.createDataFrame(rows, BLOCK)).collect()}
    for k, (d, i, kind, level, _, _) in enumerate(rows):
        if kind != "heading":
            assert got[d, i] == (None, None)
            continue
        end = k + 1
        while end < len(rows) and rows[end][0] == d and not (rows[end][2] == "heading" and min(rows[end][3], 6) <= min(level, 6)):
            end += 1
        assert got[d, i] == (i + end - k, sum(chunks.tokens(rows[j][5]) for j in range(k, end)))


def test_outline_has_the_preface(spark):
    rows = [(1, 1, "text", None, 1, "ahead of all"), (1, 2, "heading", 1, 1, "One"), (1, 3, "text", None, 2, "x" * 40), (1, 4, "heading", 2, 2, "Two")]
    got = {r.ord: (r.level, r.title, r.tokens) for r in blocks.outline(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {1: (0, None, 3), 2: (1, "One", 12), 4: (2, "Two", 1)}


def test_sections_by_name_prefer_exact(spark):
    rows = [(1, 1, "heading", 1, 1, "Scope"), (1, 2, "text", None, 1, "a"), (1, 3, "heading", 1, 2, "Scope of it"), (2, 1, "heading", 2, 1, "The scope"), (2, 2, "text", None, 3, "b")]
    got = {r.doc_id: (r.title, r.markdown, r.page, r.last_page) for r in blocks.section_text(spark.createDataFrame(rows, BLOCK), "scope").collect()}
    assert got == {1: ("Scope", "# Scope\n\na", 1, 1), 2: ("The scope", "## The scope\n\nb", 1, 3)}


def test_search_ranks_and_cuts(spark):
    rows = [(1, 1, "text", None, 1, "cat dog"), (1, 2, "text", None, 1, "Cat cat DOG"), (2, 1, "text", None, 1, "cat")]
    got = blocks.search(spark.createDataFrame(rows, BLOCK), "cat dog", 99).collect()
    assert [(r.doc_id, r.ord, r.score) for r in got] == [(1, 2, 3), (1, 1, 2)]
    with pytest.raises(ValueError):
        blocks.search(spark.createDataFrame(rows, BLOCK), "  ")


def test_long_text_is_split_without_loss():
    long = "这是一个很长的句子。" * 200
    pieces = chunks.split_long(long, 50)
    assert len(pieces) > 1 and "".join(pieces) == long and all(chunks.tokens(p) <= 50 for p in pieces)
    assert chunks.split_long("x" * 1000, 50)[0] == "x" * 50


def test_chunks_follow_headings_and_budget(spark):
    rows = [(1, 1, "heading", 1, 1, "A")] + [(1, i, "text", None, i, "w " * 120) for i in range(2, 6)] + [(1, 6, "heading", 2, 6, "B"), (1, 7, "text", None, 6, "end")]
    got = chunks.chunk(spark.createDataFrame(rows, BLOCK), 150).orderBy("chunk").collect()
    assert [list(r.heading_path) for r in got] == [["A"], ["A"], ["A", "B"]]
    assert [list(r.pages) for r in got] == [[1, 3], [4, 5], [6, 6]]
    assert all(r.tokens <= 150 for r in got)


def test_page_qa_has_all_pages_and_the_upper_median(spark):
    stats = spark.createDataFrame([(1, 1, 3, 1000), (1, 2, 1, 100), (1, 4, 2, 0), (1, 5, 1, 1200)], "doc_id int, page int, elements int, chars int")
    got = {r.page: (r.status, r.percent) for r in qa.page_qa(stats, spark.createDataFrame([(1, 6)], "doc_id int, pages int")).collect()}
    assert got == {1: ("normal", 100), 2: ("low-density", 10), 3: ("blank", 0), 4: ("image-only", 0), 5: ("normal", 120), 6: ("blank", 0)}


def test_json_tree_is_json(spark):
    import json

    nodes = spark.createDataFrame([(1, 0, "heading", 1, 1, "A", None, None), (1, 1, "table", None, 2, None, None, [["x"]])], "doc_id int, ord int, type string, level int, page int, content string, items array<string>, grid array<array<string>>")
    tree = json.loads(render.json_trees(nodes).head().tree)
    assert tree["number of pages"] == 2 and [k["type"] for k in tree["kids"]] == ["heading", "table"] and tree["kids"][1]["rows"][0]["cells"][0]["content"] == "x"


def test_p95_by_place(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 41)], "x double")
    assert tuple(evaluate.times(df, (), "x").head()) == (20.5, 38.0)
    assert tuple(evaluate.times(df.where("x <= 5"), (), "x").head()) == (3.0, 5.0)


def test_truth_keeps_unknown_apart_from_empty(spark):
    rows = [(1, 0, "heading", 1, "H", None), (1, 1, "paragraph", None, " a  b ", None), (1, 2, "table", None, None, [["x", ""], ["", ""]])]
    b = spark.createDataFrame(rows, "doc_id int, ord int, kind string, level int, text string, grid array<array<string>>")
    r = evaluate.truths_from_blocks(b, F.lit(False)).head()
    assert r.headings is None and r.paragraphs == ["a b"] and r.tables == [[["x", ""]]] and r.text == "H a b x"


def test_signature_ignores_chunk_size_without_chunks():
    a = ledger.signature({"chunk_size": 1, "rag_chunks": False})
    assert a == ledger.signature({"chunk_size": 2, "rag_chunks": False}) != ledger.signature({"chunk_size": 2, "rag_chunks": True})


def test_page_specs_and_selections():
    assert files.parse_pages("1,3,5-7") == [1, 3, 5, 6, 7] and files.parse_pages(" 2 , 4 ") == [2, 4]
    assert files.parse_pages("abc") is None and files.parse_pages("") is None
    assert files.parse_selection("3-1，5", 5) == [1, 2, 3, 5] and files.parse_selection("ALL", 2) == [1, 2]
    with pytest.raises(ValueError):
        files.parse_selection("9", 3)


def test_config_warns():
    got, warnings = files.parse_config("[output]\nchunk_size = 5\nodd = 1\nqa = 3\n[ocr]\nmode = 'later'\n")
    assert got == {"output.chunk_size": 5} and len(warnings) == 3


def test_files_are_scanned_and_sniffed(spark, tmp_path):
    for name in ("a.html", ".b.html", "~$c.docx", "d.exe", "sub/e.PDF"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"%PDF-1")
    got = files.scan(spark, str(tmp_path)).select("ext", files.sniffed(F.lit("x"), F.col("content")).alias("k")).collect()
    assert sorted((r.ext, r.k) for r in got) == [("html", "pdf"), ("pdf", "pdf")]


def test_json_lines_are_tolerant(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('# note\n\n{"id": "a", "n": 1}\n{"id": "b", "n"')
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string, n int").collect()] == [("a", 1)]


def test_html_decoding_order():
    assert html_tree.decode(b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert html_tree.decode(b'<meta charset="iso-8859-1">\xe9') == '<meta charset="iso-8859-1">é'
    assert html_tree.decode(b"\xff") == "�"


def test_nested_lists_and_unclosed_cells():
    got = html_tree.parse_html("<ul><li>a<ol><li>b</ol><li>c</ul><table><tr><td>1<td>2<tr><td>3</table><li>stray")
    assert [(n.type, n.items, n.grid) for n in got.nodes] == [("list", ["a", "b", "c"], None), ("table", None, [["1", "2"], ["3", ""]]), ("list", ["stray"], None)]


def test_formula_sources_in_order():
    one = lambda h: html_tree.parse_html(h).nodes[0].content
    assert one("<p><math><mi>a</mi></math></p>") == "$a$"
    assert one('<p><math alttext="b"><mi>a</mi></math></p>') == "$b$"
    assert one('<p>x<math display="block" alttext="b"></math></p>') == "x\n$$b$$"
    assert html_tree.bare_tex(r"{\displaystyle a}{\displaystyle b}") == r"{\displaystyle a}{\displaystyle b}"


def test_office_levels_and_cells():
    import datetime as dt

    assert [ooxml.heading_level(s) for s in ("Title", "heading 3", "Heading", "Normal", None)] == [1, 3, 1, None, None]
    assert [ooxml.cell_text(v) for v in (2.0, 2.5, None, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4))] == ["2", "2.5", "", "2024-01-02", "2024-01-02 03:04:00"]
    assert ooxml.parse_xlsx(synthetic.xlsx({"S": [[None, "x"]]})).nodes[1].grid == [["", "x"]]


def test_latex_accents_and_inputs():
    assert truth.tex_text(r"\'e \c{c}a --- ``q'' \textcolor{red}{x} \textbf{y}~z") == "é ça — “q” x y z"
    assert truth.strip_formulas(r"a $x$ b \[y\] c \begin{align*}z\end{align*}")[1] == 3


def test_layout_tables_are_paragraphs():
    long = "w " * 40
    got = truth.from_html(f"<h1>t</h1><h2>u</h2><h2>v</h2><table><tr><td>(1)</td><td>{long}</td></tr><tr><td>(2)</td><td>{long}</td></tr></table>").row()
    assert got["tables"] == [] and len(got["paragraphs"]) == 2


def test_right_to_left_lines():
    assert rtl.to_logical("םלוע םולש") == "שלום עולם"
    assert rtl.to_logical("plain (a)") == "plain (a)"
    assert rtl.bracket_balance(["(a)", ")("]) == (1, 2)
    for line in ("שלום (A/77) עולם", "abc 123"):
        assert sorted(rtl.to_logical(line)) == sorted(line)


def test_visual_text_is_told(spark):
    df = spark.createDataFrame([(".ןחבמ הז ,םלוע םולש ,םולש",), ("שלום עולם, זה מבחן.",), ("plain",)], "t string")
    assert [r[0] for r in df.select(rtl.looks_visual("t")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(rtl.restore_visual("t")).collect()][1:] == ["שלום עולם, זה מבחן.", "plain"]


def test_token_distance_against_a_table(spark):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(1)
    pairs = [([r.choice("abcd") * r.randint(1, 3) for _ in range(r.randint(0, 12))] for _ in range(2)) for _ in range(40)]
    rows = [tuple(p) for p in pairs]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.token_distance(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [dist(a, b) for a, b in rows]


def test_files_settle_in_a_stream(spark, tmp_path):
    schema = "poll int, path string, mtime double, size long"
    for k, rows in enumerate(([(1, "a", 1.0, 5), (1, "b", 1.0, 5)], [(2, "a", 1.0, 5), (2, "b", 2.0, 6)], [(3, "a", 1.0, 5), (3, "b", 2.0, 6)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = watch.settled(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.size) for r in spark.table("settled").collect()) == [("a", 5), ("b", 6)]


def test_event_windows_as_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    q = watch.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = watch.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(batch)
