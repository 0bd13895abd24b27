"""Quality rules, mixing and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm import mixing, quality
from tests.llm import brute


def _frequent(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r[3], set()).add((0 if limits.copies_once else r[0], r[1] or ""))
    out = {}
    for host, docs in by.items():
        n = Counter(k for _, t in docs for k in {brute.line_key(x) for x in t.split("\n")} if k)
        out[host] = {k for k, c in n.items() if c > max(limits.least, limits.share * len(docs))}
    return out


def _verdicts(rows, limits):
    freq, want = _frequent(rows, limits), []
    for r in rows:
        *figures, failed = brute.base_figures(r[1])
        gone = sum(len(brute.line_key(x)) for x in (r[1] or "").split("\n") if brute.line_key(x) in freq[r[3]])
        left = figures[0] - gone
        want.append((r[0], *figures, failed, (not failed) and left >= limits.words_left and left >= limits.part_left * figures[0], gone))
    return want


@pytest.mark.parametrize("copies_once", [False, True])
def test_rules_equal_brute_force(docs, rows, copies_once):
    limits = quality.Limits(least=3, share=0.05, copies_once=copies_once)
    got = sorted(tuple(r) for r in quality.quality_rules(docs, limits).collect())
    want = sorted(_verdicts(rows, limits))
    assert got == want and any(w[-1] for w in want) and any(w[-2] for w in want)


def test_cleaned_documents_lose_frequent_lines(spark, docs, rows, none, monkeypatch):
    limits = quality.Limits(least=3, share=0.05)
    want = {v[0] for v in _verdicts(rows, limits) if v[-2]}
    freq = _frequent(rows, limits)
    kept = {r.doc_id: r for r in quality.Rules(docs, limits=limits).cleaned().collect()}
    assert set(kept) == want
    for r in rows:
        if r[0] in want:
            lines = [x for x in r[1].split("\n") if brute.line_key(x) not in freq[r[3]]]
            assert kept[r[0]].text.rstrip("\n") == "\n".join(lines).rstrip("\n") and kept[r[0]].n_chars == len(kept[r[0]].text)
    monkeypatch.setattr(quality, "BROADCAST", 0)  # beyond the bound: the same by a join
    assert {r.doc_id: r.text for r in quality.Rules(docs, limits=limits).cleaned().collect()} == {k: v.text for k, v in kept.items()}
    assert quality.Rules(none).cleaned().collect() == [] and quality.quality_rules(none).collect() == []


def test_documents_are_counted_by_id_or_by_text(spark):
    text = "\n".join(" ".join(f"w{i}.{j}" for j in range(10)) for i in range(8))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, text, "en", "s", 1) for i in range(40)], kind)
    assert quality.quality_rules(df).where("not kept and n_removed_words = 80").count() == 40
    assert quality.quality_rules(df, quality.Limits(copies_once=True)).where("kept and n_removed_words = 0").count() == 40
    same = spark.createDataFrame([(7, text, "en", "s", 1)] * 40, kind)  # one document
    assert quality.quality_rules(same).where("kept").count() == 40
    none = spark.createDataFrame([(None, text, "en", "s", 1)] * 40, kind)  # forty of them
    assert quality.quality_rules(none).where("kept").count() == 0


def test_raking_meets_bounded_marginals():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, k, t) for s in "abc" for k in "xy" for t in range(4)], columns=["s", "l", "t"])
    cells["tokens"] = rng.integers(100, 10_000, len(cells))
    rate = mixing.rake(cells, ["s", "l", "t"], [0.5, 0.7, 0.8], 0.4, 500)
    assert (rate >= 0).all() and (rate <= 1).all()
    took = rate * cells["tokens"]
    for d, power in (("s", 0.5), ("l", 0.7), ("t", 0.8)):
        share = cells.groupby(d)["tokens"].sum() ** power
        want = 0.4 * cells["tokens"].sum() * share / share.sum()
        assert np.allclose(took.groupby(cells[d]).sum(), want, rtol=0.01)


def test_raking_equals_plain_proportional_fitting():
    """Given shares, far below the tokens there are: textbook fitting on a dense array."""
    rng = np.random.default_rng(3)
    mass = rng.integers(500, 5000, (3, 2, 4)).astype(float)
    aims = [{"a": 0.5, "b": 0.2}, {"x": 0.4, "y": 0.6}, 0.0]
    want = mass * 0.01
    shares = [np.array([0.5, 0.2, 0.3]), np.array([0.4, 0.6]), np.full(4, 0.25)]
    for _ in range(500):
        for axis, share in enumerate(shares):
            other = tuple(k for k in range(3) if k != axis)
            scale = 0.01 * mass.sum() * share / want.sum(axis=other)
            want = want * scale.reshape([-1 if k == axis else 1 for k in range(3)])
    cells = pd.DataFrame([("abc"[i], "xy"[j], k, mass[i, j, k]) for i in range(3) for j in range(2) for k in range(4)], columns=["s", "l", "t", "tokens"])
    rate = mixing.rake(cells, ["s", "l", "t"], aims, 0.01, 500)
    assert np.allclose(rate * cells["tokens"], want.ravel(), rtol=1e-6)


def test_given_shares_with_unknown_and_empty_categories():
    mass, names = np.array([10.0, 30.0, 60.0, 0.0]), ["a", None, "c", "d"]
    assert np.allclose(mixing.target_shares(mass, names, {"a": 0.4, "d": 0.5, "zz": 0.9}), [0.4, 0.2, 0.4, 0])
    assert np.allclose(mixing.target_shares(mass, names, {None: 3, "a": 1, "c": 0}), [0.25, 0.75, 0, 0])
    assert np.allclose(mixing.target_shares(np.zeros(2), ["a", "b"], {"a": 1}), [0, 0])


def test_sampling_follows_rates(spark, docs, rows, none):
    plan = {r.doc_id: r for r in mixing.mixing_plan(docs).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: r.n_tokens for i, r in plan.items()} == {r[0]: len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert {r.topic for r in plan.values()} <= set(range(mixing.TOPICS)) and {r.sampled for r in plan.values()} == {True, False}
    picked = mixing.sampled(docs)
    assert picked.columns == docs.columns and {r.doc_id for r in picked.collect()} == {i for i, r in plan.items() if r.sampled}
    again = {r.doc_id: (r.topic, r.rate) for r in mixing.mixing_plan(docs.repartition(7)).collect()}
    assert again == {i: (r.topic, r.rate) for i, r in plan.items()}
    assert mixing.mixing_plan(none).collect() == [] and mixing.sampled(none).collect() == []


def test_topics_part_what_documents_are_about(spark):
    """Two languages, four subjects each with words of its own: subjects stay together."""
    r, rows = random.Random(1), []
    word = lambda k: "".join(r.choice("abcdefghijklmn") for _ in range(k))
    words = {(g, s): [word(8) for _ in range(25)] for g in ("en", "de") for s in range(4)}
    for i in range(240):
        g, s = ("en", "de")[i % 2], (i // 2) % 4
        rows.append((i, " ".join(r.choice(words[g, s]) for _ in range(120)), g, "x", 0))
    got = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by = Counter((r.lang, (r.doc_id // 2) % 4, r.topic) for r in got)
    most = sum(max(n for (g, s, _), n in by.items() if (g, s) == key) for key in words)
    assert most >= 0.95 * len(got) and len({r.topic for r in got}) >= 4


def test_sampling_with_nulls_repeats_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, source string, k_source string, k_rate double, r_lang string, k_tokens int"
    rows = [(i if i % 3 else None, None if i % 4 == 0 else f"some longer words number{i}", "en", None if i % 5 else "s", "kept", 7.5, "r", i) for i in range(40)] + [(1, "twice", "en", "s", "kept", 7.5, "r", 1)] * 2
    df = spark.createDataFrame(rows, kind)
    out = mixing.sampled(df, mixing.Mix(source={"s": 0.5}, budget=0.6))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and got and set(got) <= set(rows) and got.count(rows[-1]) in (0, 2)


def test_raking_as_frames_equals_the_driver(spark, docs):
    for mix in (mixing.Mix(rounds=3), mixing.Mix(source={"src0": 0.3, None: 0.3}, topic={0: 0.5}, rounds=2)):
        one = {r.doc_id: r.rate for r in mixing.mixing_plan(docs, mix).collect()}
        two = {r.doc_id: r.rate for r in mixing.mixing_plan(docs, mix, cells_limit=0).collect()}
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_raking_as_frames_runs_until_it_settles(spark):
    mix, rng = mixing.Mix(), np.random.default_rng(1)
    cells = pd.DataFrame([(None if s == 5 else f"s{s}", k, t) for s in range(12) for k in ("a", "b", None) for t in range(8)], columns=["s", "l", "t"])
    cells["tokens"] = (rng.pareto(0.7, len(cells)) * 50 * np.where(cells["s"] == "s0", 300, 1)).astype(int)
    dims, powers = ["s", "l", "t"], [mix.source, mix.lang, mix.topic]
    want = mixing.rake(cells, dims, powers, mix.budget, mix.rounds)
    assert np.abs(want - mixing.rake(cells, dims, powers, mix.budget, 20)).max() > 1e-3  # not there after 20 rounds
    rows = [(None if pd.isna(r.s) else r.s, None if pd.isna(r.l) else r.l, int(r.t), int(r.tokens)) for r in cells.itertuples()]
    got = {(r.s, r.l, r.t): r.rate for r in mixing.rake_frames(spark.createDataFrame(rows, "s string, l string, t int, tokens long"), dims, powers, mix.budget, mix.rounds).collect()}
    assert len(got) == len(rows) and all(abs(got[r[:3]] - w) < 1e-6 for r, w in zip(rows, want, strict=True))


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "packing"]
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in df.collect()}
        else:
            assert out.columns == df.columns
            ids = {r.doc_id for r in out.collect()}
            assert seen is None or ids <= seen
            seen = ids
            if name == "quality_rules":
                assert ids == {v[0] for v in _verdicts(rows, quality.Limits(copies_once=True)) if v[-2]}
            if name == "near_duplicates":
                left = [(r.doc_id, r.text) for r in df.collect()]
                assert ids == {i for i, _, c in brute.jaccard(left) if i == c}
        df = out
    key = lambda x: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(df)
