"""Every base query runs; those with reference SQL give its rows."""

from __future__ import annotations

import subprocess
import sys

import pytest

from foliospark.plans import catalog
from tests.conftest import ROOT, SF
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(catalog.CASES))
def test_cases(spark, con, name):
    run, sql = catalog.CASES[name]
    assert difference(spark, con, run, sql, SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_before_any_session():
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-500:]
