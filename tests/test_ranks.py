"""Places in groups of any size, and what is built on them, against plain Python."""

from __future__ import annotations

import os
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.operators.corpus import quotas, round_robin, unique_ids
from foliospark.operators.evaluate import times
from foliospark.operators.ranks import prefix_sums
from foliospark.operators.render import merged, write_merged


def test_prefix_sums_of_hot_and_null_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.randint(0, 5)) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, o int, w int").repartition(5)
    got = {x.o: (x.before, x.all) for x in prefix_sums(df, ("g",), ("o",), F.col("w"), total="all").collect()}
    for g, o, _ in rows:
        assert got[o] == (sum(w for h, p, w in rows if h == g and p < o), sum(w for h, _, w in rows if h == g))
    plan = prefix_sums(df, ("g",), ("o",))._jdf.queryExecution().toString()
    assert "sum(_w#" in plan and "windowspecdefinition(_part#" in plan  # rows are summed within ranges
    assert prefix_sums(df.where("o < 0"), (), ("o",)).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 7, 40, 119, 120, 500])
def test_quotas_are_those_of_taking_turns(spark, budget):
    sizes = {("a", "x"): 60, ("a", "y"): 1, ("b", None): 30, (None, "x"): 5, ("c", "x"): 24}
    rows = [(f"{k}-{i}", *k) for k, n in sizes.items() for i in range(n)]
    left, want = dict(sizes), Counter()
    order = sorted(sizes, key=lambda k: [(x is not None, x or "") for x in k])
    for _ in range(min(budget, len(rows))):
        least = min(want[k] for k in order if left[k])
        k = next(k for k in order if left[k] and want[k] == least)
        want[k] += 1
        left[k] -= 1
    df = spark.createDataFrame(rows, "id string, f string, l string")
    assert {(q.f, q.l): q.quota for q in quotas(df, ("f", "l"), budget).collect() if q.quota} == dict(want)
    if budget == 40:
        got = round_robin(df, "f", "l", budget=budget, seed=3).collect()
        assert Counter((x.f, x.l) for x in got) == want and len({x.id for x in got}) == budget
        assert all(sorted(x.round for x in got if (x.f, x.l) == k) == list(range(1, want[k] + 1)) for k in want)


def test_names_already_taken_are_passed_over(spark):
    r = random.Random(4)
    ids = ["a", "a_2", "a", "b", "b", None, None, "", "", "x_2", "x_2", "x_2_2", "y_1", "y_01", "y"] + [r.choice(["h", "h", "h", "h_3", "h_5", "h_2_2", "h_7", "h_99"]) for _ in range(60)]
    got = [x.id for x in unique_ids(spark.createDataFrame(list(enumerate(ids)), "ord int, id string").repartition(4)).orderBy("ord").collect()]
    assert got[:3] == ["a", "a_2", "a_3"] and got[4] == "b_2" and got[5:7] == [None, None]
    named = [x for x in got if x is not None]
    assert len(set(named)) == len(named)
    taken, seen = set(ids), Counter()
    for i, x in enumerate(ids):
        if x is not None:
            free = (k for k in range(2, 999) if f"{x}_{k}" not in taken)
            want = x if not seen[x] else f"{x}_{[next(free) for _ in range(seen[x])][-1]}"
            assert got[i] == want
            seen[x] += 1


def test_times_of_one_large_group(spark):
    r = random.Random(2)
    xs = [round(r.choice([0.0, 0.0, r.random() * 100]), 1) for _ in range(5001)] + [None]
    df = spark.createDataFrame([(x,) for x in xs], "wall_s double").repartition(6)
    own = sorted(x for x in xs if x is not None)
    got = times(df, ()).head()
    assert got.median_s == statistics.median(own) and got.p95_s == own[int(len(own) * 0.95) - 1]
    assert times(df.where("wall_s is null"), ()).collect() == []


def test_merged_files_are_the_merged_text(spark, tmp_path):
    rows = [(i, f"Title {i}", "# Head\n" + "é text\n" * (i % 7) + ("" if i % 3 else "tail")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, title string, text string").repartition(5)
    index = write_merged(df, f"file://{tmp_path}/m", files=4).orderBy("at").collect()
    raw = b"".join(open(tmp_path / "m" / f, "rb").read() for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part-"))
    assert raw.decode() == merged(df).head().text
    piece = next(x for x in index if (x.part, x.n) == (1, 8))
    assert raw[piece["at"] : piece["at"] + piece["bytes"]].decode().startswith('<a id="doc-8"></a>\n\n# Title 8') and len(index) == 80
