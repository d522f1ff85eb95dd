"""Pairs nearest first in blocks of time, held against one pass over all candidates; none of them is a join of candidates."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

from tally.operators import lifecycle, linking, pairing

AT = dt.datetime(2026, 3, 1)


def _greedy(candidates):
    pairs, gone = set(), set()
    for _, a, b in sorted(candidates):
        if not {("o", a), ("i", b)} & gone:
            pairs.add((a, b))
            gone |= {("o", a), ("i", b)}
    return pairs


@pytest.mark.parametrize("block_reaches", [9, 32])
def test_strict_pairs_over_blocks(spark, monkeypatch, block_reaches):
    """1200 legs over hours, many at one time: edges of blocks change nothing."""
    rng = random.Random(block_reaches)
    rows = [(k, "transfer", rng.choice("ABC"), rng.choice(["debit", "credit"]), Decimal(rng.choice([5, 6])), AT + dt.timedelta(seconds=rng.randrange(0, 20_000, 10)), rng.choice(["A", "B", "C", None])) for k in range(1200)]
    monkeypatch.setattr(linking, "nearest_in_time", lambda *args, **more: pairing.nearest_in_time(*args, **more, block_reaches=block_reaches, task_rows=100))
    legs = spark.createDataFrame(rows, "id long, kind string, account string, direction string, amount decimal(14,2), ts timestamp_ntz, counterparty string")
    apart = lambda o, i: abs((o[5] - i[5]).total_seconds())
    met = [(apart(o, i), o[0], i[0]) for o in rows for i in rows if o[3] == "debit" and i[3] == "credit" and o[4] == i[4] and o[2] != i[2] and (o[6] == i[2] or i[6] == o[2]) and apart(o, i) <= 300]
    assert {tuple(r) for r in linking.strict_pairs(legs).collect()} == _greedy(met)


def _bought(spark, rows):
    return spark.createDataFrame(rows, "id long, account_id long, merchant string, amount decimal(14,2), posted_at timestamp_ntz, category_id int")


def test_settlements_over_blocks(spark):
    """Random amounts and tokens over three years, in hours: limits by date and amount, ties by the ids."""
    rng = random.Random(7)
    row = lambda k: (k, 1, "shop", Decimal(rng.choice([1, 80, 100, 120, 125, 0, rng.randrange(50, 200)])), AT + dt.timedelta(hours=rng.randrange(0, 26_000)), None)
    holds, finals = [row(k) for k in range(500)], [row(1000 + k) for k in range(1500)]
    day = lambda x: x[4].date().toordinal()
    met = [((f[4] - h[4]).total_seconds(), h[0], f[0]) for h in holds for f in finals if f[4] >= h[4] and day(f) - day(h) <= 7 and (abs(f[3] - h[3]) * 4 <= h[3] or h[3] == 1)]
    assert {tuple(r) for r in lifecycle.settlements(_bought(spark, holds), _bought(spark, finals)).collect()} == _greedy(met)


def test_a_chain_of_four_hundred(spark):
    """Each hold's message hangs on the one before: that took a round a hold, of three jobs each."""
    holds = [(k, 1, "shop", Decimal(50), AT + dt.timedelta(seconds=k), None) for k in range(400)]
    finals = [(1000 + k, 1, "shop", Decimal(50), AT + dt.timedelta(seconds=1000 + k), None) for k in range(400)]
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    found = {tuple(r) for r in lifecycle.settlements(_bought(spark, holds), _bought(spark, finals)).collect()}
    assert found == {(399 - k, 1000 + k) for k in range(400)}
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 100
    sc.setLocalProperty("spark.jobGroup.id", None)
