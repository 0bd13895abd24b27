"""The registered queries run over whole tables; those with SQL give its rows."""

from __future__ import annotations

import pytest

from foliospark.llm import queries
from tests.conftest import SF
from tests.oracle import connect, difference

TABLE = {1: "documents", 2: "embeddings", 3: "documents", 4: "pages", 5: "documents", 6: "documents", 7: "documents", 8: "documents", 9: "pages", 10: "documents", 11: "documents", 12: "documents", 13: "documents"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, name):
    n = spark.read.parquet(f"{SF}/{TABLE[int(name[2:].split('_')[0])]}.parquet").count()
    got = queries.QUERIES[name](spark, SF).count()
    assert got >= n if name.startswith("op8") else got >= 0 if name.startswith("op12") else got == n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert difference(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
