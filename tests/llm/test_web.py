"""WARC round trips and main-text extraction."""

from __future__ import annotations

import hashlib
import random
import time

import pytest

from foliospark.llm import html_extract, train_labeller, warc
from foliospark.llm.html_blocks import blocks
from foliospark.llm.html_extract import extract, main_texts
from foliospark.llm.labeller import trained


def _pages(spark):
    r = random.Random(3)
    big = "<p>" + "".join(r.choice("abcé☃<>\r\n") for _ in range(40_000))
    rows = [(1, "http://a/\r\nx", "x" * 1500), (2, None, "x" * 1500), (9, "u", "x" * 1500), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big + "!"), (None, "u", "x" * 1500), (11, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows, df = _pages(spark)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "") == (h or "")]
        again = i is not None and len(b) >= 1000 and i != max(same)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None, None))
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_unreadable_files_are_rows(spark, tmp_path):
    import gzip

    one = b"".join(r + warc.END for r in warc.page_records(1, "u", b"first", hashlib.sha1(b"first").hexdigest(), "response", None, "0" * 32))
    two = b"".join(r + warc.END for r in warc.page_records(2, "u", b"second", hashlib.sha1(b"second").hexdigest(), "response", None, "1" * 32))
    files = {
        "good": gzip.compress(one) + gzip.compress(two), "noise": b"no archive at all", "cut": one + two[:-20], "gzip-cut": gzip.compress(one) + gzip.compress(two)[:-12],
        "gzip-tail": gzip.compress(one) + b"\0\0", "no-length": two.replace(b"Content-Length", b"Content-Size"), "numbers": one.replace(b"X-Page-ID: 1", b"X-Page-ID: one"), "empty": b"",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.warc").write_bytes(content)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    bad = {r.error.split(".warc: ")[0].rsplit("/", 1)[1] for r in rows if r.error}
    assert bad == {"noise", "cut", "gzip-cut", "gzip-tail", "no-length"}
    assert all(r.page_id is None and r.payload is None and r.record_type is None for r in rows if r.error)
    assert sorted(bytes(r.payload) for r in rows if not r.error) == [b"first"] * 5 + [b"second"]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_chunked_framing():
    for n in (0, 1, 4096, 10_000):
        x = bytes(range(256)) * (n // 256 + 1)
        assert warc.dechunked(warc.chunked(x[:n])) == x[:n]
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments_are_verified():
    payload = b"y" * 50_000
    digest = hashlib.sha1(payload).hexdigest()
    records = warc.page_records(1, "u", payload, digest, "response", None, "0" * 32)
    data = b"".join(r + warc.END for r in records)
    parts = [(int(h["warc-segment-number"]), int(t) if (t := h.get("warc-segment-total-length")) else None, b) for h, b in warc.parse(data)]
    assert len(parts) > 2
    assert warc.reassembled(parts[::-1], digest) == (payload, None)
    assert warc.reassembled(parts[:-1], digest)[1] == "the last segment is missing"
    assert warc.reassembled(parts[1:], digest)[1] == "segments are missing or repeat"
    assert warc.reassembled([*parts[:-1], (parts[-1][0], parts[-1][1] + 1, parts[-1][2])], digest)[1] == "total length differs"
    assert warc.reassembled(parts, "0" * 40)[1] == "digest differs"


def test_blocks_of_sloppy_markup():
    got = blocks("<ul><li>a<li>b <b>c</ul><p>one<p>two<br>x &amp; y<script>var s='</p>'</script><div class='ad big'>z</div><!-- c --><table><tr><td>1<td>2</table>tail")
    assert [b.text for b in got] == ["a", "b c", "one", "two x & y", "z", "1", "2", "tail"]
    assert got[4].path[-1] == "div.ad.big"
    assert blocks(None) == [] and blocks("<p") == []


def test_labeller_on_held_out_pages():
    by_block, by_page = train_labeller.accuracy(trained(), 50_000_000, 150)
    assert by_block > 0.995 and by_page > 0.95


def test_gradients_by_differences():
    import numpy as np

    from foliospark.llm.labeller import Labeller

    model = Labeller.fresh(3)
    x, mask, y = next(train_labeller.batches([train_labeller.labelled(i) for i in range(4)], np.random.default_rng(0), 4))
    _, grad = model.gradients(x, mask, y)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for k in ("hf", "cb", "out"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        step = 1e-3
        model.w[k][at] += step
        up, _ = model.gradients(x, mask, y)
        model.w[k][at] -= 2 * step
        down, _ = model.gradients(x, mask, y)
        model.w[k][at] += step
        assert abs((up - down) / (2 * step) - grad[k][at]) < 0.05 * abs(grad[k][at]) + 1e-4


def test_extraction_on_the_tables(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"</?b>", "", inner).replace("<", " <").replace(">", "> ")).split())
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<script>x</script>")], "page_id long, url string, html string")
    assert {tuple(r) for r in html_extract.extract(odd).collect()} == {(1, "u", "", 0), (2, None, "", 0), (None, "u", "", 0)}


def test_unclosed_quotes_and_deep_nesting_take_linear_time():
    began = time.process_time()
    assert len(blocks("<a " * 300_000 + '"')) <= 1
    assert [b.text for b in blocks("<p class='x>one</p><p>two")] == ["one", "two"]
    deep = blocks("".join(f"<div>{i % 10}" for i in range(50_000)))
    assert len(deep) == 50_000 and len(deep[-1].path) == 50_000
    assert len(blocks("<b>" * 50_000 + "<p>x" * 20_000)) == 20_000
    main_texts(["".join(f"<div>{i % 10}" for i in range(3_000))])
    assert time.process_time() - began < 30


def test_extraction_of_repeated_rows_and_empty_tables(spark):
    page = "<html><body><nav><a href=/>home</a></nav><article><p>A long enough sentence of the article, as it should be.</p></article></body></html>"
    kind = "page_id long, url string, html string, text string"
    rows = [(1, "u", page, "kept out"), (1, "u", page, "kept out"), (2, None, None, None), (None, "v", "", None)]
    got = [tuple(r) for r in extract(spark.createDataFrame(rows, kind)).collect()]
    assert len(got) == 4 and got.count(next(r for r in got if r[0] == 1)) == 2 and {r[3] for r in got if r[0] != 1} == {0}
    assert extract(spark.createDataFrame([], kind)).collect() == []


def test_pages_written_by_hand():
    """Layouts that the training pages do not copy: encyclopedia, papers, blogs, tables, letters, in seven languages."""
    from tests.llm.pages_by_hand import PAGES, labelled

    right = n = 0
    for page in PAGES.values():
        plain, want = labelled(page)
        found = blocks(plain)
        assert [b.text for b in found] == [t for t, _ in want]
        got = trained().label([found])[0]
        right, n = right + sum(bool(g) == w for g, (_, w) in zip(got, want, strict=True)), n + len(want)
    assert right / n >= 0.9
    by_block, by_page = train_labeller.accuracy(trained(), 70_000_000, 150, train_labeller.Wild)
    assert by_block > 0.99 and by_page > 0.9


def test_text_of_formulas_and_fallbacks_is_kept():
    said = lambda page: [b.text for b in blocks(page)]
    assert said("<p>with <math>x=2</math> inside") == ["with x=2 inside"]
    assert said("<p><math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>") == ["x=2"]
    assert said("<p>a<noscript><p>b</p></noscript><video src=v>c</video><object>d</object>") == ["a", "b", "cd"]
    assert said("<p>a<textarea>never closed<p>b<iframe>c") == ["a never closed", "b c"]
    assert said("<p>a<script>never closed<p>b") == ["a"]
    assert len(said("<p>x<textarea>" * 20_000)) == 20_000
