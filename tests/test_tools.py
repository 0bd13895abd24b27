"""SQL table functions against the DataFrame functions; engines that misbehave."""

from __future__ import annotations

import os
import time
from collections import Counter

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from foliospark.functions import tables
from foliospark.operators.blocks import outline, search, section_text
from foliospark.operators.chunks import chunk
from foliospark.operators.runner import RESULT, Engine, run_engine, run_engines, run_one, run_rows
from foliospark.plans.registry import conversation_blocks

BLOCKS = "doc_id string, ord int, kind string, level int, page int, text string, more int"


@pytest.fixture(scope="module")
def blocks(spark, sf_dir):
    tables.register(spark)
    own = [
        ("x", 1, "text", None, None, "before  all  of it", 0), ("x", 2, "heading", 7, 1, "Deep The", 0), ("x", 3, "text", None, 2, "wörds 日本語 the end " * 60, 0),
        ("x", 4, "heading", 2, 2, "the", 0), ("x", 5, "text", None, 3, "The of, of THE.", 0), ("x", 6, "heading", 3, None, "sub the", 0), ("y", 1, "text", None, 1, "no heading here of the", 0),
    ]
    talk = conversation_blocks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("more", F.lit(1))
    both = spark.createDataFrame(own, BLOCKS).unionByName(talk).repartition(4).cache()
    both.createOrReplaceTempView("blocks_here")
    return both


def _same(a, b):
    rows = lambda df: Counter(str([r[c] for c in a.columns]) for r in df.select(*a.columns).collect())
    assert rows(a) == rows(b) and a.limit(1).count()


def test_outline_section_and_chunks(spark, blocks):
    _same(outline(blocks), spark.sql("SELECT * FROM doc_outline(TABLE(blocks_here))"))
    for name in ("the", " THE ", "sub"):
        _same(section_text(blocks, name), spark.sql(f"SELECT * FROM doc_section(TABLE(blocks_here), '{name}')"))
    for size in (60, 400):
        _same(chunk(blocks, size), spark.sql(f"SELECT * FROM doc_chunks(TABLE(blocks_here), {size})"))
    _same(chunk(blocks), spark.sql("SELECT * FROM doc_chunks(TABLE(blocks_here))"))
    assert spark.sql("SELECT * FROM doc_outline(TABLE(SELECT * FROM blocks_here WHERE ord < 0))").count() == 0


def test_hits(spark, blocks):
    got = spark.sql("SELECT doc_id, ord, page, score, snippet FROM doc_hits(TABLE(blocks_here), 'The of') ORDER BY score DESC, doc_id, ord LIMIT 20")
    assert got.collect() == search(blocks, "the of", 20).select(*got.columns).collect()
    plan = spark.sql("SELECT * FROM doc_hits(TABLE(blocks_here), 'x')")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("InMemoryTableScan")[0]


@pytest.mark.parametrize("call", ["doc_hits(TABLE(blocks_here), '  ')", "doc_section(TABLE(blocks_here), '')", "doc_outline(TABLE(SELECT 1 AS doc_id))", "doc_outline(5)"])
def test_calls_that_make_no_sense(spark, blocks, call):
    with pytest.raises((AnalysisException, PySparkException)):
        spark.sql(f"SELECT * FROM {call}").collect()


def misbehaving(kind: str, text: str) -> str | None:
    if text == "hang":
        time.sleep(60)
    if text == "crash":
        os._exit(3)
    if text == "memory":
        return str(len(bytearray(1 << 30)))
    if text == "raise":
        raise RuntimeError("no " * 500)
    if text == "exit":
        raise SystemExit(1)
    return "" if text == "empty" else text * 3


ENGINE = Engine("odd", misbehaving, {"txt"}, seconds=1.5, memory_mb=200)


def test_every_row_has_one_status(spark):
    texts = ["fine", "hang", "crash", "memory", "raise", "exit", "empty", "fine", None, "x" * 500_000]
    rows = [(i, "TXT", t) for i, t in enumerate(texts)] + [(90, "png", "hang"), (91, None, "hang")]
    docs = spark.createDataFrame(rows, "id int, format string, content string").repartition(3)
    got = {r.id: r for r in run_engine(docs, ENGINE).collect()}
    want = ["ok", "timeout", "fail", "fail", "fail", "fail", "fail", "ok", "missing", "ok"]
    assert {k: r.status for k, r in got.items()} == {str(i): s for i, s in enumerate(want)} | {"90": "unsupported", "91": "unsupported"}
    assert got["0"].text == "finefinefine" and got["9"].text == "x" * 1_500_000 and got["0"].peak_mb > 1 and got["0"].wall_s < 1.5
    assert "MemoryError" in got["3"].note and "code 3" in got["2"].note and len(got["4"].note) <= 300 and got["1"].wall_s == 1.5
    assert run_one(ENGINE, "txt", "fine")[0] == "ok"


def test_work_done_is_not_done_again(spark):
    docs = spark.createDataFrame([(1, "txt", "a"), (2, "txt", "hang"), (2, "txt", "hang"), (3, "txt", "c")], "id int, format string, content string")
    done = spark.createDataFrame([("odd", "2"), ("other", "1")], "engine string, id string")
    other = Engine("other", lambda kind, text: text, ("txt",))
    got = Counter((r.engine, r.id, r.status) for r in run_engines(docs, [ENGINE, other], done).collect())
    assert got == {("odd", "1", "ok"): 1, ("odd", "3", "ok"): 1, ("other", "2", "ok"): 2, ("other", "3", "ok"): 1}
    assert run_engine(docs.where("id > 9"), ENGINE).collect() == [] and len(RESULT.split(",")) == 8


def test_calls_that_hang_wait_together(spark):
    """Ten hanging rows of one task cost about one time limit; the rows among them are not lost."""
    docs = spark.createDataFrame([(i, "txt", "hang" if i % 2 else "fine") for i in range(20)], "id int, format string, content string").coalesce(1)
    began = time.perf_counter()
    got = Counter(r.status for r in run_engine(docs, ENGINE).collect())
    assert got == {"ok": 10, "timeout": 10} and time.perf_counter() - began < 8


def burning(kind: str, text: str) -> str:
    """Computes for some time of its own."""
    began = time.process_time()
    while time.process_time() - began < 0.3:
        pass
    return str(os.getpid())


def test_calls_that_compute_do_not_share_time():
    out = list(run_rows(Engine("busy", burning, ("txt",), seconds=3.0), [(i, "txt", "x") for i in range(12)]))
    assert [o[0] for _, o in out] == ["ok"] * 12 and {o[3] for _, o in out} != {str(os.getpid())}
    assert sorted(r for r, _ in out) == list(range(12)) and max(o[1] for _, o in out) < 1.5
