"""The data source of document files, and the block table that follows them."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators.block_table import BlockTable
from foliospark.operators.blocks import line_blocks
from foliospark.plans import file_queries
from foliospark.sources import document_files
from foliospark.sources.parse import parse_documents


@pytest.fixture
def folder(spark, tmp_path):
    document_files.register(spark)
    for name, text in {"a.html": "<p>one</p>", "b.HTM": "<p>two</p>" * 9, "sub/c.html": "<h1>Three</h1>", "d.docx": "x" * 50, "~$d.docx": "lock", ".e.html": "hidden", "f.dat": "other", "g.pdf": ""}.items():
        at = tmp_path / "in" / name
        at.parent.mkdir(exist_ok=True, parents=True)
        at.write_text(text)
        os.utime(at, (1_000_000_000, 1_000_000_000))
    return tmp_path / "in"


def _names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def _read(spark, at, **options):
    r = spark.read.format("document_files")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(at))


def test_rows_and_pushed_filters(spark, folder):
    every = _read(spark, folder)
    assert _names(every) == ["a.html", "b.HTM", "c.html", "d.docx", "g.pdf"]
    assert "f.dat" in _names(_read(spark, folder, supported="false")) and ".e.html" not in _names(_read(spark, folder, supported="false"))
    assert {r.ext for r in every.collect()} == {"html", "htm", "docx", "pdf"} and every.where("ext = 'pdf'").head().content == b""
    wanted = every.where(F.col("ext").isin("html", "htm") & (F.col("size") >= 14) & (F.col("mtime") < F.lit("2005-01-01").cast("timestamp")))
    assert _names(wanted) == ["b.HTM", "c.html"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "size" not in plan.split("Filter", 1)[-1].split("BatchScan")[0].replace("isnotnull(size", "")  # the listing has compared it
    assert _names(every.where(F.col("path").endswith("l") & (F.length("content") > 10))) == ["c.html"]  # one pushed, one not


def test_files_are_opened_only_for_their_content(spark, folder):
    if os.geteuid() == 0:
        (folder / "gone.html").symlink_to(folder / "nowhere")
    slim = spark.read.format("document_files").schema("size long, path string").load(str(folder))
    assert slim.columns == ["size", "path"] and slim.agg(F.sum("size")).head()[0] == 10 + 90 + 14 + 50
    reader = document_files.FileReader({"path": str(folder), "partitionBytes": "60"}, slim.schema)
    parts = reader.partitions()
    assert [sum(f.size for f in p.files) <= 60 or len(p.files) == 1 for p in parts] == [True] * len(parts) and len(parts) > 2


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i:02}.txt").write_bytes(bytes([65 + i]) * (1 << 20))
    schema = spark.createDataFrame([], "path string, content binary").schema
    reader = document_files.FileReader({"path": str(tmp_path), "supported": "false"}, schema)
    assert len(reader.partitions()) == 1
    sizes = [b.nbytes for p in reader.partitions() for b in reader.read(p)]
    assert len(sizes) > 1 and max(sizes) <= document_files.OUT_BYTES + (1 << 20)


def test_pieces_are_the_whole_files(spark, tmp_path):
    document_files.register(spark)
    texts = {"a.txt": "é\n日".encode() * 333, "b.txt": b"", "c.txt": b"x" * 100, "d.txt": b"y" * 101}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    pieces = _read(spark, tmp_path, supported="false", pieceBytes=10, partitionBytes=100)
    assert pieces.columns == ["path", "ext", "mtime", "size", "content", "start"]
    got = {}
    for r in pieces.orderBy("path", "start").collect():
        at = got.setdefault(r.path.rsplit("/", 1)[1], bytearray())
        assert r.start == len(at) and len(r.content) <= 10 and r.size == len(texts[r.path.rsplit("/", 1)[1]])
        at += r.content
    assert got == texts
    reader = document_files.FileReader({"path": str(tmp_path), "supported": "false", "pieceBytes": "10", "partitionBytes": "100"}, pieces.schema)
    assert max(sum(f.length for f in p.files) for p in reader.partitions()) == 100 and len(reader.partitions()) > 20
    assert pieces.select("path").count() == sum(max(1, -(-len(t) // 10)) for t in texts.values())


def test_the_files_of_the_query_are_read_in_pieces(spark, tmp_path, monkeypatch):
    rows = [(1, "a\nb" * 700_000, "en"), (2, "日本" * 400_000, "en"), (3, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    lengths, count = [], file_queries._in_folders
    monkeypatch.setattr(file_queries, "_in_folders", lambda files: lengths.extend(r[0] for r in files.select(F.length("content")).collect()) or count(files))
    for query in (file_queries.q_document_files, file_queries.q_document_stream):
        lengths.clear()
        got = {(r.lang, r.n, r.bytes) for r in query(spark, str(tmp_path)).collect()}
        assert got == {("en", 2, 2_100_000 + 2_400_000 + 2), ("de", 1, 1)}
        assert max(lengths) <= 1 << 20 and sum(lengths) == 4_500_003


def test_rows_go_to_the_parsers(spark, folder):
    got = parse_documents(_read(spark, folder).where("ext in ('html', 'htm')")).select("path", F.size("nodes").alias("n"), "error").collect()
    assert {r.path.rsplit("/", 1)[1]: r.n for r in got} == {"a.html": 1, "b.HTM": 9, "c.html": 1} and all(r.error is None for r in got)


def test_stream_gives_each_settled_file_once(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("document_files").option("lagSeconds", "50").load(str(folder)).select("path", "content")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return _names(spark.read.schema("path string").parquet(str(tmp_path / "out")))

    assert run() == ["a.html", "b.HTM", "c.html", "d.docx", "g.pdf"]
    (folder / "new.html").write_text("still growing")
    assert "new.html" not in run()
    os.utime(folder / "new.html", (time.time() - 60,) * 2)
    (folder / "a.html").write_text("changed")
    os.utime(folder / "a.html", (time.time() - 70,) * 2)
    assert run() == ["a.html", "a.html", "b.HTM", "c.html", "d.docx", "g.pdf", "new.html"]


def test_only_changed_files_are_parsed(spark, tmp_path):
    parsed = spark.sparkContext.accumulator(0)

    def parse(files):
        def count(batches):
            for b in batches:
                parsed.add(b.num_rows)
                yield b

        return line_blocks(files.mapInArrow(count, files.schema), "path").withColumnRenamed("doc_id", "path")

    t = BlockTable(spark, f"file://{tmp_path}/t", parse, buckets=4)
    files = lambda texts, at=1.0: spark.createDataFrame([(p, at, len(x), x) for p, x in texts.items()], "path string, mtime double, size long, text string")
    held = lambda: sorted((r.path, r.ord, r.text) for r in t.read().collect())
    texts = {f"f{i}": f"line one of {i}\n\nline three" for i in range(30)} | {"empty": ""}
    want = lambda: sorted((p, k + 1, x) for p, s in texts.items() for k, x in enumerate(s.split("\n")) if x)
    assert t.refresh(files(texts)) == {"parsed": 31, "gone": 0} and held() == want() and parsed.value == 31
    assert t.refresh(files(texts)) == {"parsed": 0, "gone": 0} and parsed.value == 31 and t.rows.numbers() == [1]
    before = t.rows.version().folders
    texts["f3"] = "now shorter"
    texts["f30"] = "new"
    del texts["f7"], texts["empty"]
    assert t.refresh(files(texts)) == {"parsed": 2, "gone": 2} and held() == want() and parsed.value == 33
    assert any(f in t.rows.version().folders.values() for f in before.values())  # a bucket without changes stays as it is
    assert t.refresh(files(texts, 2.0).where("path = 'f1'").unionByName(files(texts).where("path <> 'f1'"))) == {"parsed": 1, "gone": 0} and parsed.value == 34
    assert t.refresh(files({"f1": texts["f1"]}, 2.0)) == {"parsed": 0, "gone": 29} and len(held()) == 2
    assert t.refresh(files(texts).limit(0)) == {"parsed": 0, "gone": 1} and held() == []
