"""Holds and the messages that settle them, one to one."""

from __future__ import annotations

import datetime as dt

from tally.operators import lifecycle

AT = dt.datetime(2026, 3, 1, 12)
SCHEMA = "id long, account_id long, merchant string, amount decimal(14,2), posted_at timestamp_ntz"


def _rows(spark, *rows):
    return spark.createDataFrame([(k, account, "shop", amount, AT + dt.timedelta(seconds=seconds)) for k, account, amount, seconds in rows], SCHEMA)


def _pairs(spark, holds, finals):
    from decimal import Decimal

    money = lambda rows: [(k, a, Decimal(str(x)), s) for k, a, x, s in rows]
    return {tuple(r) for r in lifecycle.settlements(_rows(spark, *money(holds)), _rows(spark, *money(finals))).collect()}


def test_each_hold_finds_a_message(spark):
    """Two holds and two settlements of one amount, a second apart: both are settled."""
    assert _pairs(spark, [(1, 1, 50, 0), (2, 1, 50, 1)], [(11, 1, 50, 2), (12, 1, 50, 3)]) == {(2, 11), (1, 12)}


def test_chains_of_ten(spark):
    """Ten holds, ten settlements: each round settles the nearest, none is left over, none is used twice."""
    found = _pairs(spark, [(k, 1, 50, k) for k in range(10)], [(100 + k, 1, 50, 20 + k) for k in range(10)])
    assert found == {(9 - k, 100 + k) for k in range(10)}


def test_limits_of_a_settlement(spark):
    """A quarter off and seven days after are within, a message before the hold or of another account is not; a token hold takes any amount."""
    day = 86_400
    holds = [(1, 1, 100, 0), (2, 2, 100, 0), (3, 3, 1, 0), (4, 4, 100, 0), (5, 5, 100, 0)]
    finals = [(11, 1, 125, 7 * day), (12, 2, 126, 5), (13, 3, 900, 5), (14, 4, 100, -5), (15, 6, 100, 5)]
    assert _pairs(spark, holds, finals) == {(1, 11), (3, 13)}


def test_more_holds_than_messages(spark):
    assert _pairs(spark, [(1, 1, 50, 0), (2, 1, 50, 1), (3, 1, 50, 2)], [(11, 1, 50, 3)]) == {(3, 11)}
