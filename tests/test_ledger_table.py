"""The ledger table under replays, late rows and rival writers; the state of a watched file."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from foliospark.plans import catalog
from foliospark.sources.ledger_table import Conflict, LedgerTable, Version
from foliospark.streaming import watch
from foliospark.streaming.loop import Watch
from tests.conftest import SF

SCHEMA = "path string, seq long, note string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _held(table, number=None):
    return sorted((tuple(r) for r in table.read(number).collect()), key=str)


@pytest.fixture
def ledger(spark, tmp_path):
    return LedgerTable(spark, f"file://{tmp_path}/t", order="seq", buckets=3)


def test_merges_keep_the_newest_row_of_each_key(spark, ledger):
    with pytest.raises(ValueError, match="nothing"):
        ledger.read()
    assert ledger.merge(_rows(spark, ("a", 1, "x"), ("a", 3, "z"), ("b", 1, "y"), (None, 1, "n"), ("a", 3, "y")), "q", 0)
    assert not ledger.merge(_rows(spark, ("a", 9, "again")), "q", 0)
    assert ledger.merge(_rows(spark, ("a", 2, "late"), ("c", None, "c"), ("b", 1, "again")), "q", 1)
    assert _held(ledger) == [("a", 3, "z"), ("b", 1, "again"), ("c", None, "c"), (None, 1, "n")]
    assert _held(ledger, 1) == [("a", 3, "z"), ("b", 1, "y"), (None, 1, "n")]
    # another source starts at epoch 0, as a stream with a new checkpoint does
    assert ledger.merge(_rows(spark, ("d", 1, "new")), "r", 0) and ledger.merge(_rows(spark), "q", 2)
    assert len(_held(ledger)) == 5 and ledger.version().epochs == {"q": 2, "r": 0} and ledger.numbers() == [1, 2, 3, 4]
    before = _held(ledger)
    assert ledger.forget() > 0 and ledger.numbers() == [4] and _held(ledger) == before


def test_a_version_is_written_once(spark, ledger, monkeypatch):
    ledger.merge(_rows(spark, ("a", 1, "x")))
    with pytest.raises(Conflict):
        ledger.commit(Version(1))
    # a rival commits between this writer's reading and its commit: neither merge is lost
    real, rival = ledger.commit, [True]

    def commit(new):
        if rival.pop() if rival else False:
            LedgerTable(spark, ledger.path, order="seq", buckets=7).merge(_rows(spark, ("b", 1, "rival")))
        real(new)

    monkeypatch.setattr(ledger, "commit", commit)
    assert ledger.merge(_rows(spark, ("c", 1, "mine"), ("a", 0, "old")))
    assert _held(ledger) == [("a", 1, "x"), ("b", 1, "rival"), ("c", 1, "mine")] and ledger.numbers() == [1, 2, 3]


def test_sink_without_a_stream(spark, tmp_path):
    save = watch.ledger_sink(f"file://{tmp_path}/t")
    batch = _rows(spark, ("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y"))
    save(batch, 1)
    save(batch, 1)
    save(_rows(spark, ("a", 0, "later merge wins without an order")), 2)
    assert [r[1] for r in _held(LedgerTable(spark, f"file://{tmp_path}/t"))] == [0, 2]


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


def _poll(n, size, server=False):
    return Row(path="a", poll=n, mtime=1.0, size=size, server_ok=server, ok=None, needs_ocr=None, ocr_attempts=None)


def _result(n, size, ok=True, needs=False, tries=0):
    return Row(path="a", poll=n, mtime=1.0, size=size, server_ok=None, ok=ok, needs_ocr=needs, ocr_attempts=tries)


def _watch(*entry):
    w = Watch("sig")
    w.seen, w.done = _Value(), _Value()
    if entry:
        w.handleInitialState(("a",), Row(poll=entry[0], mtime=1.0, size=entry[1], signature=entry[2], needs_ocr=entry[3], ocr_attempts=entry[4]), None)
    return lambda *rows: [(r.poll, r.size, r.tries) for r in w.handleInputRows(("a",), iter(rows), None)]


def test_files_are_due_after_two_equal_polls():
    step = _watch()
    assert step(_poll(1, 5)) == [] and step(_poll(2, 6)) == []
    assert step(_poll(1, 6)) == []  # a late poll is not the newest
    assert step(_poll(3, 6)) == [(3, 6, 0)]
    assert step(_result(3, 6, ok=False), _poll(4, 6)) == [(4, 6, 0)]  # failures stay due
    assert step(_poll(5, 6), _result(4, 6)) == [] and step(_poll(6, 7), _poll(7, 7)) == [(7, 7, 0)]


def test_recognition_is_tried_again_twice_when_it_is_there():
    step = _watch()
    step(_poll(1, 5))
    assert step(_poll(2, 5)) == [(2, 5, 0)]
    assert step(_result(2, 5, needs=True), _poll(3, 5)) == []
    assert step(_poll(4, 5, True)) == [(4, 5, 0)]
    assert step(_result(4, 5, needs=True, tries=1), _poll(5, 5, True)) == [(5, 5, 1)]
    assert step(_result(5, 5, needs=True, tries=2), _poll(6, 5, True)) == []


def test_state_starts_from_the_ledger():
    assert _watch(3, 5, "sig", False, 0)(_poll(2, 9), _poll(3, 9), _poll(4, 5), _poll(5, 5)) == []
    assert _watch(3, 5, "other options", True, 2)(_poll(4, 5), _poll(5, 5)) == [(5, 5, 0)]
    assert _watch(3, 5, "sig", True, 1)(_poll(4, 5, True), _poll(5, 5, True)) == [(5, 5, 1)]


def test_the_loop_meets_every_case(spark):
    rows = catalog.QUERIES["q_watch_loop"](spark, SF).collect()
    assert {r.ocr_attempts for r in rows} >= {None, 0, 2} and max(r.conversions for r in rows) > 2
    assert {r.poll is None for r in rows} == {True, False}
