"""Stored carries: closed once, also by two at a time, and carried on from cycle to cycle."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from unittest import mock

import pytest
from pyspark.sql import functions as F
from tally.operators import budgets as B
from tally.operators import closing

MAY, JUNE, JULY = dt.date(2026, 4, 25), dt.date(2026, 5, 25), dt.date(2026, 6, 25)
LATER = dt.datetime(2026, 8, 1)
BUDGETS = "category_id int, cycle_start date, amount decimal(14,2), rollover boolean, carry_in decimal(14,2), carry_closed_at timestamp"


def _budgets(spark, *rows):
    return spark.createDataFrame([(c, cycle, Decimal(a), rolls, Decimal(0), None) for c, cycle, a, rolls in rows], BUDGETS)


def _spent(spark, *rows):
    """A stand-in for the view: spend() of it gives these (cycle_start, category_id, spent)."""
    return spark.createDataFrame([(cycle, c, Decimal(x)) for cycle, c, x in rows], "cycle_start date, category_id int, spent decimal(14,2)")


@pytest.fixture(autouse=True)
def plain_spend():
    with mock.patch.object(B, "spend", lambda view: view):
        yield


def _now(spark, budgets, path):
    return {(r["category_id"], r["cycle_start"]): (r["amount"], r["carry_in"], r["carry_closed_at"] is not None) for r in closing.with_carries(budgets, closing.carries(spark, path)).collect()}


def test_a_carry_goes_on_and_is_written_once(spark, tmp_path):
    path = str(tmp_path / "carries")
    budgets = _budgets(spark, (1, MAY, 100, True), (1, JUNE, 100, True), (2, MAY, 50, False))
    assert closing.close_cycle(budgets, _spent(spark, (MAY, 1, 70), (MAY, 2, 10)), MAY, LATER, path)
    assert _now(spark, budgets, path) == {(1, MAY): (100, 0, False), (1, JUNE): (100, 30, True), (2, MAY): (50, 0, False), (2, JUNE): (50, 0, True)}
    assert not closing.close_cycle(budgets, _spent(spark, (MAY, 1, 0)), MAY, LATER, path)
    assert closing.close_cycle(budgets, _spent(spark, (JUNE, 1, 150)), JUNE, LATER, path)
    assert _now(spark, budgets, path)[1, JULY] == (100, -20, True)
    assert not list((tmp_path / "carries").glob("_closing-*"))


def test_two_closings_at_once_leave_one_carry(spark, tmp_path):
    path, budgets = str(tmp_path / "carries"), _budgets(spark, (1, MAY, 100, True))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda x: closing.close_cycle(budgets, _spent(spark, (MAY, 1, x)), MAY, LATER, path), [10, 20, 30, 40]))
    rows = closing.carries(spark, path).collect()
    assert sorted(done) == [False, False, False, True] and len(rows) == 1
    assert rows[0]["carry_in"] == 100 - [10, 20, 30, 40][done.index(True)]


def test_a_cycle_that_runs_is_refused_and_drafts_are_no_carries(spark, tmp_path):
    path, budgets = str(tmp_path / "carries"), _budgets(spark, (1, JULY, 100, True))
    with pytest.raises(ValueError, match="ends on"):
        closing.close_cycle(budgets, _spent(spark), JULY, dt.datetime(2026, 7, 24), path)
    budgets.write.parquet(f"{path}/_closing-dead")  # left by one that died
    assert closing.carries(spark, path).count() == 0
    assert closing.close_cycle(budgets.where(F.lit(False)), _spent(spark), MAY, LATER, path) and closing.carries(spark, path).count() == 0
    assert not closing.close_cycle(budgets, _spent(spark), MAY, LATER, path)
