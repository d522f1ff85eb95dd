"""Balances kept up by deltas against balances added up anew, over random chains of changes."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tally.operators import balances, maintenance

LEGS = "id long, account_id long, direction string, amount decimal(14,2), state string, superseded_by long, posted_at timestamp"
AT = dt.datetime(2026, 1, 1)


def _random_leg(rng, k):
    return (k, rng.randrange(6), rng.choice(["credit", "debit"]), Decimal(rng.randrange(1, 999)) / 100, rng.choice(["posted", "posted", "pending"]), rng.choice([None, None, None, 5]), AT + dt.timedelta(days=rng.randrange(20)))


def _balances(spark, legs):
    accounts = spark.createDataFrame([(k, Decimal(10 * k)) for k in range(8)], "id long, opening_balance decimal(14,2)")
    return balances.derived(accounts, spark.createDataFrame(legs, LEGS)).select("id", "current_balance", "balance_as_of")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_equal_what_is_added_up_anew(spark, seed):
    """Edits, moves to other accounts, deletions, new legs; accounts 6 and 7 have none."""
    rng = random.Random(seed)
    legs = {k: _random_leg(rng, k) for k in range(40)}
    stored = _balances(spark, list(legs.values()))
    for step in range(3):
        ids = rng.sample(sorted(legs), 6)
        before, after = [legs[k] for k in ids], [_random_leg(rng, k) for k in ids[:3]] + [_random_leg(rng, 100 * step + 100 + k) for k in range(2)]
        for k in ids:
            del legs[k]
        legs |= {x[0]: x for x in after}
        now, asked = spark.createDataFrame(list(legs.values()), LEGS), []

        def legs_of(accounts, now=now, asked=asked):
            asked.append({r[0] for r in accounts.collect()})
            return now.join(accounts, "account_id", "left_semi")

        change = maintenance.deltas(spark.createDataFrame(before, LEGS), spark.createDataFrame(after, LEGS))
        touched = maintenance.touched_balances(stored, change, legs_of)
        accounts = {x[1] for x in [*before, *after] if x[4] == "posted" and x[5] is None}
        assert {r["id"] for r in touched.collect()} == accounts and asked[0] <= accounts
        stored = spark.createDataFrame(maintenance.merged(stored, touched).collect(), stored.schema)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, _balances(spark, list(legs.values())).collect()))


def test_an_account_that_loses_all_legs(spark):
    leg = (1, 3, "debit", Decimal(5), "posted", None, AT)
    stored = _balances(spark, [leg])
    change = maintenance.deltas(spark.createDataFrame([leg], LEGS), spark.createDataFrame([], LEGS))
    touched = maintenance.touched_balances(stored, change, lambda ids: spark.createDataFrame([], LEGS)).collect()
    assert [tuple(r) for r in touched] == [(3, Decimal("30.00"), None)]


def test_alerts_follow_touched_balances_only(spark):
    alert = "account_id long, computed decimal(14,2), reported decimal(14,2), delta decimal(14,2), closed boolean, note string"
    rows = [(1, Decimal(10), Decimal(12), Decimal(-2), False, None), (2, Decimal(5), Decimal(9), Decimal(-4), False, None), (3, Decimal(1), Decimal(2), Decimal(-1), True, "seen")]
    touched = spark.createDataFrame([(1, Decimal(12), AT), (3, Decimal(99), AT)], "id long, current_balance decimal(14,2), balance_as_of timestamp")
    found = {r["account_id"]: r for r in maintenance.touched_alerts(spark.createDataFrame(rows, alert), touched).collect()}
    assert (found[1]["closed"], float(found[1]["delta"])) == (True, 0.0) and found[1]["note"]
    assert tuple(found[2]) == rows[1] and tuple(found[3]) == rows[2]


def test_empty_changes_move_nothing(spark):
    stored = _balances(spark, [(1, 3, "debit", Decimal(5), "posted", None, AT)])
    none = spark.createDataFrame([], LEGS)
    assert maintenance.touched_balances(stored, maintenance.deltas(none, none), lambda ids: none).isEmpty()
    assert stored.where(F.col("current_balance") < 0).isEmpty()


def test_a_chain_of_steps_reads_its_legs_once(spark):
    """before, each step read all legs twice, those it changes and the others, so that five steps read them 32 times."""
    from tally.plans import upkeep

    tx = spark.range(400).selectExpr("id", "id % 5 AS account_id", "'credit' AS direction", "cast(1 as decimal(14,2)) AS amount", "if(id % 2 = 0, 'pending', 'posted') AS state", "cast(null as bigint) AS superseded_by", "timestamp'2026-01-01' AS posted_at")
    for which, now in upkeep.STEPS:
        tx = upkeep.changed(tx, which, now)
    assert tx._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert tx.count() == 400 - 37
    row = tx.where("id = 38 * 7").first()
    assert (row.amount, row.state, row.account_id) == (2, "posted", 1)
    assert tx.where("superseded_by = id - 1 AND id % 17 = 0").count() == tx.where("superseded_by IS NOT NULL").count() == 21
