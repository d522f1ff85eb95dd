"""Queries on balances and alerts that are kept up through a chain of edits, deletions, replays and supersedings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import balances as B
from tally.operators import maintenance as M
from tally.operators.lineage import settled
from tally.plans.accounts import _DRIFT, _ISO, current
from tally.plans.registry import query
from tally.sources import tables as S

#: Each step: which legs it changes, and the columns that they have after it; None: they are gone.
STEPS = (
    ("id % 7 = 0", {"amount": "cast(amount + 1 as decimal(14,2))"}),
    ("id % 11 = 0", None),
    ("id % 13 = 0", {"account_id": "if(account_id > 1, account_id - 1, account_id)"}),
    ("id % 17 = 0", {"superseded_by": "id - 1"}),
    ("id % 19 = 0", {"state": "if(state = 'pending', 'posted', state)"}),
)

_AFTER = """tx2 AS (SELECT id, CASE WHEN id % 13 = 0 AND account_id > 1 THEN account_id - 1 ELSE account_id END AS account_id, direction, posted_at, amount + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS amount,
    CASE WHEN id % 19 = 0 AND state = 'pending' THEN 'posted' ELSE state END AS state, CASE WHEN id % 17 = 0 THEN id - 1 ELSE superseded_by END AS superseded_by FROM tx WHERE id % 11 <> 0),
bal2 AS (SELECT a.id, a.opening_balance + coalesce(m.moved, 0) AS current_balance, m.as_of AS balance_as_of FROM acc a LEFT JOIN (SELECT account_id, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS moved, max(posted_at) AS as_of FROM tx2 WHERE state = 'posted' AND superseded_by IS NULL GROUP BY 1) m ON m.account_id = a.id)"""


def changed(tx: DataFrame, which: str, now: dict[str, str] | None) -> DataFrame:
    """All legs after a step, in one pass: a union of those it changes and the others would read everything twice a step."""
    if now is None:
        return tx.where(f"NOT ({which})")
    return tx.withColumns({c: F.when(F.expr(which), F.expr(value)).otherwise(F.col(c)) for c, value in now.items()})


def chained(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balances before and after the steps, the latter by the legs that each step changes, and the ids of the accounts touched."""
    tx = S.transactions(spark, d).select("id", "account_id", "direction", "amount", "state", "superseded_by", "posted_at")
    stored = settled(current(spark, d).select("id", "is_active", "reconcilable", "current_balance", "balance_as_of"))
    first, hit = stored, stored.select("id").limit(0)
    for which, now in STEPS:
        before, tx = tx.where(which), changed(tx, which, now)
        legs = tx  # as it is after this step
        touched = settled(M.touched_balances(stored, M.deltas(before, tx.where(which)), lambda ids, legs=legs: legs.join(ids, "account_id", "left_semi")))
        stored, hit = settled(M.merged(stored, touched)), hit.union(touched.select("id"))
    return first, stored, hit.distinct()


@query("kept_balances", f"WITH {S.TX}, {S.ACCOUNTS}, {_AFTER} SELECT id AS account_id, current_balance::DOUBLE AS current_balance, strftime(balance_as_of, {_ISO}) AS balance_as_of FROM bal2")
def kept_balances(spark, d):
    """Balances after five steps of changes, each moved by its deltas only; they equal those added up anew."""
    return chained(spark, d)[1].select(F.col("id").alias("account_id"), F.col("current_balance").cast("double"), F.date_format("balance_as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("balance_as_of"))


@query("kept_alerts", f"{_DRIFT}, {_AFTER} SELECT account_id, b.current_balance::DOUBLE AS computed, reported::DOUBLE AS reported, (b.current_balance - reported)::DOUBLE AS delta, abs(b.current_balance - reported) <= 0.01 AS closed FROM dr JOIN bal2 b ON b.id = dr.account_id")
def kept_alerts(spark, d):
    """Drift alerts after the same steps: the delta follows the balance, and one that agrees is closed.

    They are told once, at the end: one that agrees halfway and then differs again would stay closed.
    """
    first, last, hit = chained(spark, d)
    money = lambda c: F.col(c).cast("decimal(38,2)").alias(c)
    alerts = B.drift(first, S.snapshots(spark, d)).select("account_id", money("computed"), money("reported"), money("delta"), F.lit(False).alias("closed"), F.lit(None).cast("string").alias("note"))
    found = M.touched_alerts(settled(alerts), last.join(hit, "id", "left_semi"))
    return found.select("account_id", *(F.col(c).cast("double").alias(c) for c in ("computed", "reported", "delta")), "closed")
