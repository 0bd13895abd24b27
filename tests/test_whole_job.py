"""Queries that have to look at whole texts and whole tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliospark.functions import edits
from foliospark.functions.metrics import heading_f1
from foliospark.functions.text import token_distance
from foliospark.operators.corpus import round_robin
from foliospark.plans import catalog
from foliospark.plans.registry import conversation_blocks


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_benchmark_similarity_sees_whole_texts(spark, tmp_path):
    same = "word " * 70
    texts = [same + "end", same + "other end", "café 今天", "cafè 明天", "", "x" * 310, "x" * 310 + "é"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r.sim for r in catalog.QUERIES["q_benchmark_similarity"](spark, str(tmp_path)).collect()}
    assert got == {i: round(1 - _distance(a, b) / max(len(a), len(b)), 9) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}


def test_section_text_has_every_section(spark, sf_dir):
    rows = sorted((r.doc_id, r.ord, r.kind, r.level, r.page, r.text) for r in conversation_blocks(spark, sf_dir).collect())
    want = []
    for d in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == d]
        low = [r[5].lower().strip() if r[2] == "heading" else "" for r in of]
        exact = "the" in low
        for i, r in enumerate(of):
            if "the" not in low[i] or exact and low[i] != "the":
                continue
            end = next((j for j in range(i + 1, len(of)) if of[j][2] == "heading" and of[j][3] <= r[3]), len(of))
            text = "\n\n".join("#" * x[3] + " " + x[5] if x[2] == "heading" else x[5] for x in of[i:end])
            want.append((d, r[5], min(x[4] for x in of[i:end]), max(x[4] for x in of[i:end]), text))
    got = [(r.doc_id, r.title, r.page, r.last_page, r.markdown) for r in catalog.QUERIES["q_section_text"](spark, sf_dir).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
    listed = catalog.QUERIES["q_section_lookup"](spark, sf_dir).collect()
    assert len(listed) == 20 and all(r.markdown is None for r in listed)


def test_report_and_summary_have_all_results(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert catalog.QUERIES["q_report_rows"](spark, sf_dir).count() == n and catalog.QUERIES["q_batch_summary"](spark, sf_dir).head().total == n


def test_chosen_rows_count_against_the_budget(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, format string")
    first = {r.id for r in round_robin(rows, "format", budget=6).collect()}
    chosen = spark.createDataFrame([(i,) for i in [*sorted(first)[:4], 99]], "id int")
    more = {r.id for r in round_robin(rows, "format", budget=10, chosen=chosen).collect()}
    assert len(more) == 6 and not more & set(sorted(first)[:4])
    assert round_robin(rows, "format", budget=3, chosen=chosen).count() == 0


def test_scores_of_documents_see_whole_texts(spark, tmp_path):
    parts = [" ".join(f"w{i * 800 + k}" for k in range(800)) for i in range(80)]
    items = [f"item{i}" for i in range(3000)]
    html = "<h1>long page</h1>" + "".join(f"<p>{p}</p>" for p in parts)
    pages = [(1, html + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"), (2, html)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r for r in catalog.QUERIES["q_score_documents"](spark, str(tmp_path)).select("id", "char_sim", "cer", "order_tau", "heading_f1").collect()}
    truth = len("long page ") + len(" ".join(parts))
    more = len(" " + " ".join(items))
    assert truth > 400_000 and abs(got["1"].char_sim - (1 - more / (truth + more))) < 1e-12 and abs(got["1"].cer - 3000 / (2 + 80 * 800)) < 1e-12
    assert got["2"].char_sim == 1.0 and got["2"].cer == 0.0 and all(r.order_tau == r.heading_f1 == 1.0 for r in got.values())


def test_headings_are_compared_whole(spark):
    same = "x" * 400_000
    df = spark.createDataFrame([([same + "y" * 100_000], [same]), ([same + "y"], [same + "y"])], "p array<string>, t array<string>")
    assert [r.f for r in df.select(heading_f1("p", "t").alias("f")).collect()] == [0.0, 1.0]


def test_distance_in_bands_and_blocks_against_a_table(monkeypatch):
    r = random.Random(5)
    for _ in range(1500):
        for name, value in (("FIRST", r.choice([1, 2, 5, 20])), ("GROWS", r.choice([2, 4])), ("BLOCK", 4), ("HELD", r.choice([1, 1 << 20]))):
            monkeypatch.setattr(edits, name, value)
        letters = "ab天é😀"[: r.randint(1, 5)]
        a = r.choices(letters, k=r.randint(0, 60))
        b = [x for x in a if r.random() > 0.1] + r.choices(letters, k=r.randint(0, 4)) if r.random() < 0.8 else r.choices(letters, k=r.randint(0, 60))
        want = _distance(a, b)
        assert edits.distance(a, b) == edits.distance("".join(b), "".join(a)) == want
    assert edits.distance(None, "a") is None and edits.distance("", "") == 0


def test_distance_of_more_words_than_there_are_letters(spark):
    n = 1_200_000  # more than Unicode has
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("a"))
    assert df.select(token_distance(F.reverse("a"), F.slice(F.reverse("a"), 2, n))).first()[0] == 1
