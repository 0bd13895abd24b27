"""NN-descent against all pairs."""

from __future__ import annotations

import numpy as np

from foliospark.llm.embedding_dedup import Graph, near_duplicates
from tests.llm.brute import Union

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    u, n = Union([i for i, *_ in rows]), dict.fromkeys([i for i, *_ in rows], 0)
    ids = list(good)
    for a in range(len(ids)):
        for b in range(a):
            x, y = good[ids[a]], good[ids[b]]
            if len(x) == len(y) and x @ y >= 0.95:
                n[ids[a]] += 1
                n[ids[b]] += 1
                u.join(ids[a], ids[b])
    return sorted((i, n[i], u.find(i), u.find(i) == i) for i, *_ in rows)


def test_links_and_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.25, 1.0]), 0) for i in range(300)]
    dense = rng.normal(size=16)
    rows += [(1000 + i, dense + rng.normal(size=16) * 0.12, 1) for i in range(150)]  # more links than any list holds
    rows += [(2000 + i, np.ones(16) * (i + 1), 1) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [1.0] * 15 + [None], 0), (3003, [float("nan")] * 16, 0), (3004, [1.0, 2.0], 0), (3005, [], 0)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r)[:4] for r in out) == _brute(rows)
    asked = [r for r in out if r.vec_id % 20 == 0 and r.n_links]
    assert asked and all(r.audit_recall is not None and r.audit_recall >= 0.9 for r in asked if r.vec_id < 2000)
    assert all(r.audit_recall is None for r in out if r.vec_id % 20)


def test_the_graph_alone_finds_the_links(spark):
    """NN-descent before any further pass: lists are long enough here to hold all links."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(size=16) * 0.15], 0) for i in range(400)]
    got = {(r.a, r.b) for r in Graph(spark.createDataFrame(rows, SCHEMA), 0.95).descend().collect()}
    unit = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(want) > 300 and len(want & got) >= 0.98 * len(want)


def test_equal_vectors_and_repeated_ids_are_asked(spark):
    """3 stands for 40, which is asked; rows that repeat an id share their component."""
    rows = [(3, [1.0, 0.0], 0), (40, [1.0, 0.0], 0), (41, [1.0, 0.05], 0), (50, [0.0, 1.0], 0), (50, [1.0, 0.1], 0), (51, [0.02, 1.0], 0), (60, [-1.0, 0.0], 0)]
    got = {(r.vec_id, r.component_id, r.audit_recall) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(i, c) for i, c, _ in got} >= {(3, 3), (40, 3), (41, 3), (60, 60)}
    assert next(x for i, _, x in got if i == 40) == 1.0 and next(x for i, _, x in got if i == 60) is None


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], SCHEMA)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted([(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)], key=repr)
