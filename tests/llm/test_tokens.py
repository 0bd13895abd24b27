"""Token counts and packing against the library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from foliospark.llm import packing, pretoken_spans, pretokens
from foliospark.llm.kernels import Texts
from foliospark.llm.token_counts import counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a <|endoftext|> b<|endoftext|>", "  x\n\n y  don't 'tis\t\t 12 ½  z ", "it's we'll I'd 've", "日本語 テキスト", "　 a  b", "😀😀 ë"]


def _texts(rows):
    return [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, ODD[0])]


def test_counts_equal_the_library(spark, rows, none):
    texts = _texts(rows)
    lib = Tokenizer.from_file(PATH)
    want = sorted((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in token_counts(df).collect()) == want
    assert token_counts(none).collect() == []


def test_spans_equal_the_pattern():
    r = random.Random(5)
    parts = ["a", "t", "s", " ", "  ", "\n", "'", "''", "re", "ll", "1", "½", "　", "é", "😀", "!", "ve", "D", "'T", "中", "'s ", " 't", "̈"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    t = Texts(pa.array(texts))
    start, bound = pretoken_spans.spans(t)
    end, raw = np.append(start[1:], t.size), t.data.tobytes()
    find = pretokens.pieces(PATH).find
    for i, x in enumerate(texts):
        assert [raw[a:z].decode() for a, z in zip(start[bound[i] : bound[i + 1]], end[bound[i] : bound[i + 1]], strict=True)] == find(x)


def test_a_full_table_is_thinned(monkeypatch):
    monkeypatch.setattr(pretoken_spans, "SLOTS", 1024)
    e = pretoken_spans.Encodings(PATH)
    lib = Tokenizer.from_file(PATH)
    r = random.Random(1)
    for words in (100, 100, 100, 2000, 100, 5000):  # more distinct pre-tokens than slots, too
        texts = [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(words)) for _ in range(2)] + ["", "ab ab ab"]
        want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
        ids, off = pretoken_spans.ids_of(e, Texts(pa.array(texts)))
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == want
        assert counts(e, pa.array(texts), PATH).tolist() == list(map(len, want))


def test_packing_is_gapless_and_whole(spark, rows, none):
    texts = _texts(rows)
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 3
    assert packing.pack(none).collect() == []


def test_cutting_puts_the_short_piece_first():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.cut(1, 1024) == [(0, 1)]


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(4)
    for n in (1, 50, 5000):
        have = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        used = np.zeros(1025, np.int64)
        for p, k in packing.plan(have, 1024):
            assert sum(p) <= 1024
            for a in p:
                used[a] += k
        assert (used == have).all()
    sequences = sum(k for _, k in packing.plan(have, 1024))
    least = max(-(-int((have * np.arange(1025)).sum()) // 1024), int(have[513:].sum()))
    assert sequences <= 1.01 * least + 2


def test_every_three_length_pattern_is_fitted():
    length, rng = 1024, np.random.default_rng(0)
    have = np.zeros(length + 1, np.int64)
    for _ in range(60):
        a = int(rng.integers(150, 341))
        b, n = int(rng.integers(a, (length - a) // 2 + 1)), int(rng.integers(1, 101))
        for x in (a, b, length - a - b):
            have[x] += n
    there = np.flatnonzero(have).tolist()
    want = {(length - a - b, b, a) for a in there for b in there if a <= b <= length - a - b and have[length - a - b]}
    assert {p for p in packing.patterns(have, length) if len(p) == 3} == want
    least = -(-int((have * np.arange(length + 1)).sum()) // length)
    assert sum(n for _, n in packing.plan(have, length)) <= least + 10
