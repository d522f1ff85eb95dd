"""Refunds and their purchases, without a join of candidates."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from tally.operators import lifecycle

AT = dt.datetime(2026, 3, 1)


def _bought(spark, rows):
    return spark.createDataFrame(rows, "id long, account_id long, merchant string, amount decimal(14,2), posted_at timestamp_ntz, category_id int")


def test_refunds_meet_no_table_of_candidates(spark):
    rng = random.Random(3)
    row = lambda k: (k, 1, rng.choice(["shop", None]), Decimal(rng.randrange(1, 40)), AT + dt.timedelta(hours=rng.randrange(0, 9000)), rng.choice([3, None]))
    bought, back = [row(k) for k in range(600)], [row(1000 + k) for k in range(300)]
    found = lifecycle.refunds(_bought(spark, bought), _bought(spark, back))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for r in back:
        fit = [(p[4], p[0]) for p in bought if r[2] and p[2] == r[2] and p[4] < r[4] and (r[4].date() - p[4].date()).days <= 90 and r[3] <= p[3]]
        if fit:
            wanted[r[0]] = max(fit)[1]
    kinds = {p[0]: p[5] for p in bought}
    assert {(r.refund_id, r.purchase_id, r.category_id) for r in found.collect()} == {(a, b, kinds[b]) for a, b in wanted.items()}
