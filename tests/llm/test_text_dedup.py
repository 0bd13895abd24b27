"""BWT, substring and n-gram dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from foliospark.llm import bwt_dedup, ngram_join, shared, substring
from foliospark.llm.shared import components
from tests.llm import brute


def _pairs(rows):
    return [(r[0], r[1]) for r in rows]


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", [200, 100])
def test_bwt_equals_brute_force(docs, rows, length):
    assert _got(bwt_dedup.bwt_digest(docs, length)) == sorted(brute.byte_repeats(_pairs(rows), length), key=repr)


def test_bwt_periodic_texts_and_repeated_rows(spark):
    rows = [(1, "ab" * 300), (2, "q" * 199), (3, "q" * 200), (4, "q" * 201), (None, "z" * 250), (5, "unique " + "".join(map(chr, range(200, 500)))), (5, "unique " + "".join(map(chr, range(200, 500)))), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(bwt_dedup.bwt_digest(df)) == sorted(brute.byte_repeats(rows, 200), key=repr)


def test_bwt_empty_and_bytes_kept(none, docs):
    assert bwt_dedup.bwt_digest(none).collect() == []
    for r in bwt_dedup.kept_bytes(docs).collect():
        assert all(a["start"] < a["end"] for a in r.spans)


def test_merged_shards_give_the_order_of_all_suffixes():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(40, 90))) for _ in range(30)] + [b"ab" * 30, b"ab" * 30]
    off = np.cumsum([0, *map(len, strings)])
    for shard in (50, 500, 1 << 20):
        got = bwt_dedup.repeated_places(strings, np.ones(off[-1], np.int64), 20, 5, shard)
        for s, a, z in zip(strings, off[:-1], off[1:], strict=True):
            want = [j for j in range(len(s) - 19) if sum(t[k : k + 20] == s[j : j + 20] for t in strings for k in range(len(t) - 19)) > 1]
            assert np.flatnonzero(got[a:z]).tolist() == want


def test_substring_equals_brute_force(docs, rows):
    assert _got(substring.substring_digest(docs)) == sorted(brute.word_repeats(_pairs(rows), 50), key=repr)


def test_substring_null_and_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, b + " " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(substring.substring_digest(df)) == sorted(brute.word_repeats(rows, 50), key=repr)


def test_substring_cut_keeps_columns_and_layout(spark, docs, none):
    out = substring.remove_repeats(docs, spans_col="spans")
    assert out.columns == [*docs.columns, "spans"]
    for r in out.collect():
        assert (r.text is None) == (r.doc_id == 60)
    assert substring.remove_repeats(none).collect() == []
    body = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, body, 5), (2, f"head\n\n{body}\ntail", 6)], "doc_id long, text string, k_id int")
    assert {r.doc_id: r.text for r in substring.remove_repeats(df).collect()} == {1: body, 2: "head\n\ntail"}


def test_jaccard_equals_brute_force(docs, rows):
    assert _got(ngram_join.jaccard_components(docs)) == sorted(brute.jaccard(_pairs(rows)), key=repr)


def test_jaccard_chains_and_boilerplate(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    rows, boiler = [], [word() for _ in range(40)]
    for i in range(12):  # each close to the next, the ends far apart
        base = [*base[8:], *(word() for _ in range(8))]
        rows.append((100 - i, " ".join(base)))
    rows += [(200 + i, " ".join([*boiler, *(word() for _ in range(25))])) for i in range(40)]
    assert _got(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == sorted(brute.jaccard(rows), key=repr)


def test_one_of_each_group_stays(spark, docs, rows, none):
    want = {i for i, _, c in brute.jaccard(_pairs(rows)) if i == c}
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert ngram_join.one_of_each(none).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert ngram_join.one_of_each(odd).count() == 3
    assert [r.component_id for r in ngram_join.jaccard_components(odd).collect()].count(None) == 2


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_components_of_long_chains(spark, monkeypatch, at_once):
    if at_once == 3:  # tasks that put nothing together: the steps over all edges do it
        monkeypatch.setattr(shared, "_contract", lambda batches: batches)
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (100, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


def _mixture(n: int, seed: int = 3):
    """Texts of 20 of 40 shared passages: many frequent columns, no links."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    blocks = [" ".join(word() for _ in range(20)) for _ in range(40)]
    return [(i, " ".join(r.sample(blocks, 20))) for i in range(n)]


def test_jaccard_candidates_of_shared_passages_stay_few(spark, monkeypatch):
    counts = []
    whole = ngram_join.Product.cross_pairs

    def counted(self, index):
        out = whole(self, index)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.Product, "cross_pairs", counted)
    got = ngram_join.jaccard_components(spark.createDataFrame(_mixture(400), "doc_id long, text string").repartition(4)).collect()
    assert all(r.component_id == r.id for r in got) and counts[0] < 0.1 * 400 * 399 / 2


def test_jaccard_tiles_equal_brute_force(spark, monkeypatch):
    """All columns count as hot, tiles are small, and no centre joins anything first."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    monkeypatch.setattr(ngram_join.Product, "star_pairs", lambda self, index, turn: spark.createDataFrame([], "a long, b long, na long, nb long"))
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(6):
        base = [word() for _ in range(60)]
        for k in range(7):
            copy = list(base)
            copy[r.randrange(60)] = word()
            rows.append((10 * g + k, " ".join(copy[: r.randint(45, 60)])))
    assert _got(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(brute.jaccard(rows), key=repr)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    a, b = np.unique(h[:3000]), np.unique(h[500:3100])
    bits = ngram_join.bitmaps(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_jaccard_rows_that_share_an_id(spark):
    r = random.Random(4)
    say = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = say(), say(), say()
    rows = [(3, a), (5, a + " end"), (5, b), (7, b + " x"), (8, c), (8, c), (None, a)]
    got = {(x.id, x.n_shingles): x.component_id for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 56): 3, (5, 57): 3, (5, 56): 3, (7, 57): 3, (8, 56): 8, (None, 56): None}


def test_one_of_each_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x"), (2, "a b c d e f", 7, 8, "y")], "doc_id long, text string, k_gone int, k_id int, id string")
    assert [tuple(r) for r in ngram_join.one_of_each(df).collect()] == [(1, "a b c d e f", 5, 6, "x")]


def test_rows_that_share_only_the_id_stay(spark):
    r = random.Random(4)
    a, b, c, d = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4))
    rows = [(3, a), (5, a + " end"), (5, b), (7, c), (7, c), (7, c + " end"), (8, d), (9, b + " end"), (None, a), (1, None), (1, "")]
    got = _got(ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert [i for i, _ in got].count(1) == 1 and [i for i, _ in got].count(7) == 1
    assert sorted((i, x) for i, x in got if i not in (None, 1, 7)) == sorted([(3, a), (5, b), (8, d)])
    assert (None, a) in got and len(got) == 6


def test_bwt_large_groups_are_cut(spark, monkeypatch):
    """A passage shorter than the length, with other surroundings each time."""
    r = random.Random(2)
    say = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage = say(180)
    rows = [(i, say(150) + passage + say(150)) for i in range(40)]
    rows += [(100, rows[3][1][100:] + say(20)), (101, rows[3][1][140:360]), (102, rows[7][1]), (103, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute.byte_repeats(rows, 200), key=repr)
    monkeypatch.setattr(bwt_dedup, "GROUP", 5)
    seen = []
    whole = bwt_dedup._emit_contexts
    monkeypatch.setattr(bwt_dedup, "_emit_contexts", lambda length, single=False: (seen.append(single), whole(length, single))[1])
    assert _got(bwt_dedup.bwt_digest(df)) == want and True in seen


def test_bwt_spans_all_come_from_the_transforms(spark, monkeypatch):
    """Without the merge nothing is removed, exact copies included."""
    df = spark.createDataFrame([(i, "passage " * 3 + " ".join(f"w{j}" for j in range(90))) for i in range(4)], "doc_id long, text string")
    assert {r.n_removed for r in bwt_dedup.bwt_digest(df).collect()} != {0}
    monkeypatch.setattr(bwt_dedup, "_merge", lambda length: lambda batches: iter(()))
    assert {r.n_removed for r in bwt_dedup.bwt_digest(df).collect()} == {0}
