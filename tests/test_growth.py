"""Work and results that must hold for long lists, many rows and odd texts."""

from __future__ import annotations

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.functions.metrics import heading_tp, kendall, number_stats
from foliospark.functions.rowwise import OUT_READ, OUT_ROWS, pieces
from foliospark.functions.text import list_paragraph_flags, numbers
from foliospark.plans import catalog
from foliospark.sources.parse import html_nodes


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _greedy(pred: list[str], truth: list[str]) -> int:
    free, n = list(truth), 0
    for p in pred:
        sims = [1.0 if p == t else 1 - _distance(p, t) / max(len(p), len(t)) if p and t else 0.0 for t in free]
        if sims and max(sims) >= 0.85:
            free.pop(sims.index(max(sims)))
            n += 1
    return n


def test_heading_matches_equal_the_greedy_loop(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé日") for _ in range(r.choice([0, 1, 7, 13, 20, 40])))
    spoilt = lambda w: "".join(r.choice([c, c, c, c, c, c, c, c, "a", "", c + "b"]) for c in w)
    rows = []
    for d in range(120):
        base = [word() for _ in range(4)]
        rows.append((d, *[[spoilt(r.choice(base)) for _ in range(r.randint(0, 7))] for _ in range(2)]))
    got = spark.createDataFrame(rows, "d int, p array<string>, t array<string>").select("d", heading_tp(F.col("p"), F.col("t")).alias("n")).collect()
    assert {x.d: x.n for x in got} == {d: _greedy(p, t) for d, p, t in rows}


def test_many_long_headings_are_matched_in_time(spark):
    r = random.Random(6)
    heads = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(90)]
    df = spark.createDataFrame([(heads, [h if i % 2 else h[::-1] for i, h in enumerate(heads)])], "p array<string>, t array<string>")
    began = time.perf_counter()
    assert df.select(heading_tp(F.col("p"), F.col("t")).alias("n")).first().n == 45
    assert time.perf_counter() - began < 30


def test_titles_decode_what_their_sql_decodes(spark, tmp_path):
    heads = ["one &amp;&amp; two&amp", "a = &quot;73 &lt;b&gt; &amp;lt; &amp;amp;", " two\n  lines &#65; &copy", None]
    pages = [(i, "u", h and f"<html><title>no</title><body><h1>{h}</h1><p>x &quot;y</p><h1>second</h1></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {0: "one && two&amp", 1: "a = &quot;73 <b> &lt; &amp;", 2: "two lines &#65; &copy", 3: None}
    assert {r.doc_id: r.title for r in catalog.QUERIES["q_html_titles"](spark, str(tmp_path)).collect()} == want


def test_results_of_a_full_batch_leave_in_pieces(spark):
    made: list[int] = []
    batch = (pa.array(map(str, range(10_000))), pa.array([b"x" * 10] * 10_000))
    out = []
    for part in pieces(lambda a, b: made.append(1) or f"{a}{len(b)}", pa.string(), [batch, ([], []), (pa.array([None, "y"]), pa.array([b"", b"z" * OUT_READ]))]):
        assert len(part) <= OUT_ROWS and len(made) <= len(out) + OUT_ROWS
        out += part.to_pylist()
    assert out == [f"{i}10" for i in range(10_000)] + ["None0", f"y{OUT_READ}"]


def test_pages_of_a_full_batch_keep_their_nodes(spark):
    pages = spark.range(0, 9000, 1, 1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("<p>p"), "id", F.lit("<ul><li>x</ul>"))).alias("html"))
    got = html_nodes(pages).groupBy("type").agg(F.count("*").alias("n"), F.count_if((F.col("type") == "list") | (F.col("content") == F.concat(F.lit("p"), "doc_id"))).alias("own")).collect()
    assert {r.type: (r.n, r.own) for r in got} == {"paragraph": (7200, 7200), "list": (7200, 7200)}


def test_flags_of_a_long_list_are_found_in_time(spark):
    items = [f"({i % 900}) {'word ' * (i % 30)}" if i % 2 else f"item {i}" for i in range(6000)]
    began = time.perf_counter()
    df = spark.createDataFrame([(items,), (["(1) a", None, "(2) b"],), (["(1) " + "x" * 90, None],), ([],), (None,)], "items array<string>")
    got = [r.f for r in df.select(list_paragraph_flags("items").alias("f")).collect()]
    assert got == [[i % 2 == 1 for i in range(6000)], [False] * 3, [False] * 2, [], None] and time.perf_counter() - began < 20


def test_scores_of_many_numbers_are_found_in_time(spark):
    said = " ; ".join(f"no {i % 97}, {i:,d}.50 x" for i in range(3000))
    began = time.perf_counter()
    df = spark.createDataFrame([(said, said)], "p string, t string").select(numbers("p").alias("p"), numbers("t").alias("t"))
    s = df.select(number_stats(F.col("p"), F.col("t")).alias("s")).first().s
    assert (s.digit_f1, s.digit_n_truth) == (1.0, 6000) and time.perf_counter() - began < 20


def test_order_of_many_paragraphs(spark):
    xs = random.Random(8).choices(range(400), k=600)
    pairs = [(y > x) - (y < x) for i, x in enumerate(xs) for y in xs[i + 1 :]]
    df = spark.createDataFrame([(xs,), ([3, 3],), ([1],), ([],)], "xs array<int>")
    assert [r.t for r in df.select(F.round(kendall(F.col("xs")), 9).alias("t")).collect()] == [round(sum(pairs) / sum(map(abs, pairs)), 9), 1.0, None, None]


def test_cells_are_counted_without_a_join(spark, tmp_path):
    rows = [(1, 10.0), (1, 10.0), (1, 50.0), (1, None), (2, None), (3, 7.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.QUERIES["q_cell_f1"](spark, str(tmp_path))
    assert {r.doc_id: r.f1 for r in df.collect()} == {1: 0.5, 2: 0.0, 3: 1.0}  # null cells match nothing
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
