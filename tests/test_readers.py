"""Hidden text, encodings and null dimensions."""

from __future__ import annotations

import codecs

import pytest

from foliospark.operators.evaluate import grouped_report
from foliospark.sources import html_tree, truth


@pytest.mark.parametrize("attrs", ["hidden", 'hidden="hidden"', 'aria-hidden="TRUE"', 'style="Display : none"', 'style="color:red; visibility:hidden"', 'class="NavBox x"', 'role="Navigation"'])
def test_truth_drops_what_readers_do_not_see(attrs):
    found = str(truth.from_html(f"<body><p>kept one</p><div {attrs}><p>gone</p><br></div><p>kept two</p></body>"))
    assert "kept one" in found and "kept two" in found and "gone" not in found


@pytest.mark.parametrize("attrs", ['hidden="until-found"', 'aria-hidden="false"', 'style="display:block"', 'class="nav"'])
def test_truth_keeps_the_rest(attrs):
    assert "kept" in str(truth.from_html(f"<body><div {attrs}><p>kept</p></div></body>"))


@pytest.mark.parametrize(("raw", "want"), [
    (codecs.BOM_UTF16_LE + "aé日".encode("utf-16-le"), "aé日"), (codecs.BOM_UTF16_BE + "aé日".encode("utf-16-be"), "aé日"), (codecs.BOM_UTF8 + "é".encode(), "é"), ("é".encode(), "é"),
    (b'<meta charset="latin-1">\xe9', '<meta charset="latin-1">é'), (b'<meta charset="nonsense">\xc3\xa9', '<meta charset="nonsense">é'), (b"\xff\xfea", "\ufffd\ufffda"), (codecs.BOM_UTF8 + b"a\xff", "a\ufffd"),
])
def test_decode(raw, want):
    assert html_tree.decode(raw) == want


@pytest.mark.parametrize(("tex", "want"), [
    (r"{\displaystyle a+{b}}", "a+{b}"), (r"{\displaystyle a} + {b}", r"{\displaystyle a} + {b}"), (r"{\displaystyle a", r"{\displaystyle a"), ("x  y", "x y"), ("", ""), (r"{\textstyle }", ""),
])
def test_bare_tex(tex, want):
    assert html_tree.bare_tex(tex) == want


def test_null_values_are_a_value_of_their_dimension(spark):
    rows = [("e", "1", "ok", "pdf", None, 0.5, 1.0), ("e", "2", "ok", "pdf", "en", 0.7, 2.0)]
    df = spark.createDataFrame(rows, "engine string, id string, status string, format string, lang string, char_sim double, wall_s double")
    got = sorted((r.dimension, r.lang or "", r.n) for r in grouped_report(df, ("format", "lang")).collect())
    assert got == [("all", "", 2), ("format", "", 2), ("lang", "", 1), ("lang", "en", 1)]
