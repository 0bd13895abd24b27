"""Codec, collocations and periodic runs against the library and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliospark.llm import bpe_codec, collocations, periodic_runs

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "  x\n\n y  don't 'tis\t\t 12 ½  z ", "日本語 テキスト", "😀😀 ë\x00\x7f", "a" * 999 + "b" * 1001, "-" * 300 + " " * 301]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# codec


def _codec_rows(texts):
    lib = Tokenizer.from_file(PATH)
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        yield i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))


def test_codec_equals_the_library(spark, rows, none):
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, ODD[0]), (None, "no id"), (2000, "long word " * 140_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, bpe_codec.codec_digest(df).collect())) == Counter(_codec_rows(texts))
    assert bpe_codec.codec_digest(none).collect() == []


def test_every_prefix_rule_gives_the_library_s_ids():
    r, c, lib = random.Random(2), bpe_codec.codes(PATH), Tokenizer.from_file(PATH)
    tokens = [t for t in c.token if t]
    parts = ["a", "e", " ", "th", "ing", "=", "-", "\n", "é", "ÃÂ", "0", " the", "ss", "zz"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    texts += [x * k for x in ("a", " ", "-", "ab", "ÃÂ") for k in range(70)]
    got = c.column_ids(pa.array(texts))
    assert got.to_pylist() == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert c.column_texts(got).to_pylist() == texts


def test_codec_columns_and_bad_ids(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, None, "y")], "doc_id long, text string, c_0 string")
    got = bpe_codec.decode(bpe_codec.encode(df)).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 1, "text": "ab", "c_0": "x", "ids": [397], "decoded": "ab"} and got[1].ids == [] and got[1].decoded == ""
    with pytest.raises(ValueError, match="ids"):
        bpe_codec.encode(df.withColumnRenamed("c_0", "ids"))
    c = bpe_codec.codes(PATH)
    assert c.column_texts(pa.array([[int(np.argmax([t == b"\xc3" for t in c.token]))], [], None], pa.list_(pa.int32()))).to_pylist() == ["�", "", ""]
    for bad in ([99999999], [-1], [None]):
        with pytest.raises(ValueError, match="without a token"):
            c.column_texts(pa.array([bad], pa.list_(pa.int32())))


# collocations


def _phrases(rows, longest=5, least=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in many.items():
        for i in range(len(p)):
            for z in range(i + 2, len(p) + 1):
                if z - i < len(p) and a >= many[lang, p[i:z]]:
                    gone.add((lang, p[i:z]))
    out = []
    for lang in n:
        found = []
        for (at, p), a in many.items():
            if at == lang and (at, p) not in gone:
                s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _talk(seed=3, n=300):
    r = random.Random(seed)
    words = ["a", "of", "The", "the", "é", "日本", "x\x01", "x", "x-y", "'s", "B\x0e", "dog", "Über"]
    say = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", ";", "\x1f"]) for _ in range(k))
    fixed = "new york stock exchange opens "
    return [(None if i % 50 == 0 else say(r.randint(0, 60)) + fixed * (i % 3) + say(2), r.choice(["en", "en", "fr", None, ""])) for i in range(n)] + [("", "de"), ("  .. ", "xx")]


@pytest.mark.parametrize("cut", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, cut):
    rows = _talk()
    df = spark.createDataFrame([(t, x, "p", 1) for t, x in rows], "text string, lang string, part string, n int").repartition(5)
    sent = collocations.SENT
    if cut:  # many slices and ranges, ranges over what a task holds, most words not sent
        monkeypatch.setattr(collocations, "SLICE", 500)
        monkeypatch.setattr(collocations, "RANGE", 100)
        monkeypatch.setattr(collocations, "HELD", 60)
        sent = 3
    for least, top in ((5, 2000), (20, 7)):
        assert sorted(map(tuple, collocations.collocations(df, least=least, top=top, sent_most=sent).collect())) == _phrases(rows, least=least, top=top)


def test_collocations_of_nothing(spark, none):
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r, n = 3 * 10**12 + 1, 7 * 10**13 + 3, 4 * 10**12 + 7, 9 * 10**15 + 11
    lexicon = spark.createDataFrame([(1, "x", "en", l, n), (2, "y", "en", r, n)], "id long, word string, lang string, n long, total long")
    phrases = spark.createDataFrame([(bytearray((1).to_bytes(4, "big") + (2).to_bytes(4, "big")), a)], "key binary, a long")
    assert collocations.scored(phrases, phrases, lexicon).head()["score"] == 1000 * a * n // (l * r)


def test_radix_sort_and_ranges():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (5000, 5)).astype(np.int32) * rng.choice([1, 70_000, 1 << 22], 5).astype(np.int32)
    got, n = collocations.radix_sorted(keys, np.ones(len(keys), np.int64), int(keys.max()))
    want = Counter(map(tuple, keys.tolist()))
    assert [(*k,) for k in got.tolist()] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    assert (collocations.ids_of(collocations.bytes_of(got, 3).ravel(), 3, 5) == got).all()


# periodic runs


def _runs(w, least=24, times=3):
    out = {}
    for p in range(1, len(w) // times + 1):
        k, eq = 0, [w[i] == w[i + p] for i in range(len(w) - p)]
        while k < len(eq):
            j = k
            while j < len(eq) and eq[j]:
                j += 1
            if j > k and j + p - k >= max(least, times * p):
                out.setdefault((k, j + p), p)
            k = max(j, k + 1)
    return sorted((a, z - a, p) for (a, z), p in out.items())


def _run_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    found = _runs(words)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return (
        i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def _chant(r):
    k = r.choice([1, 2, 3, 5, 50])
    w = [r.randrange(k) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 4)):
        u = [r.randrange(k) for _ in range(r.choice([1, 2, 3, 4, 8, 13, 20]))]
        if r.random() < 0.4:
            u = u * r.randint(1, 9) + [r.randrange(k) for _ in range(r.randint(0, 3))]
        m = u * r.randint(1, 6)
        at = r.randint(0, len(w))
        w[at:at] = m[: r.randint(0, len(m))]
    return w


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(11)
    for probes in (1 << 18, 7):
        monkeypatch.setattr(periodic_runs, "PROBES", probes)
        for _ in range(600):
            w = _chant(r)
            for least, times in ((24, 3), (4, 4)):
                assert periodic_runs.runs(np.array(w, np.uint64), least, times) == _runs(w, least, times)


def test_runs_of_documents(spark, rows, none):
    r = random.Random(5)
    texts = [(x[0], x[1]) for x in rows] + [(100 + i, " \t".join(f"w{k}" for k in _chant(r))) for i in range(80)]
    texts += [(None, "a b " * 30), (100, "again " * 40), (300, "é\n" * 25), (301, "x y z " * 250_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, periodic_runs.runs_digest(df.where("doc_id is null or doc_id <> 301")).collect()))
    assert got == Counter(_run_row(*t) for t in texts[:-1])
    assert any(k[1] > 1 for k in got)
    long = periodic_runs.periodic_runs(df.where("doc_id = 301")).head()
    assert [tuple(x) for x in long.runs] == [(0, 750_000, 3)] and long.collapsed == "x y z"
    assert periodic_runs.runs_digest(none).collect() == []


def test_run_columns(spark):
    df = spark.createDataFrame([(1, "a " * 30, "x")], "doc_id long, text string, c_1 string")
    got = periodic_runs.periodic_runs(df, rest_col=None).head()
    assert got.c_1 == "x" and [tuple(x) for x in got.runs] == [(0, 30, 1)]
    with pytest.raises(ValueError, match="runs"):
        periodic_runs.periodic_runs(df.withColumnRenamed("c_1", "runs"))
