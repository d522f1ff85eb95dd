"""Balances and drift alerts kept up by what changed, instead of added up anew from all legs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import balances as B
from tally.operators import predicates as P

COUNTS = "state = 'posted' AND superseded_by IS NULL"


def _moved(rows: DataFrame, moved: str, newest: str) -> DataFrame:
    return rows.where(COUNTS).groupBy("account_id").agg(F.sum(P.signed_amount()).alias(moved), F.max("posted_at").alias(newest))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(account_id, delta, given_at, taken_at) of the accounts that changed legs touch.

    before and after are the changed legs only, as they were and as they are: an edit has its leg in both, a deletion
    in before, a new leg in after; a leg that changes its account touches two. given_at and taken_at are the newest
    leg that counts after and before. A leg that counts in neither moves nothing.
    """
    both = _moved(after, "given", "given_at").join(_moved(before, "taken", "taken_at"), "account_id", "full")
    return both.select("account_id", (F.coalesce("given", F.lit(0)) - F.coalesce("taken", F.lit(0))).alias("delta"), "given_at", "taken_at")


def touched_balances(stored: DataFrame, change: DataFrame, legs_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, current_balance, balance_as_of) of the stored accounts that a change touches, as they are after it.

    Sums go on by their delta. The date goes on too, unless the leg it came from may be gone and none as new came:
    then legs_of is asked for the legs after the change of these accounts (account_id), and of no others.
    """
    both = stored.select("id", "current_balance", "balance_as_of").join(change, F.col("id") == F.col("account_id"))
    sure = F.col("taken_at").isNull() | (F.col("taken_at") < F.col("balance_as_of")) | F.coalesce(F.col("given_at") >= F.col("balance_as_of"), F.lit(False))
    both = both.withColumn("sure", F.coalesce(sure, F.lit(False)))
    asked = both.where("NOT sure").select("account_id")
    again = legs_of(asked).where(COUNTS).groupBy("account_id").agg(F.max("posted_at").alias("again"))
    both = both.join(again, "account_id", "left")
    as_of = F.when(F.col("sure"), F.greatest("balance_as_of", "given_at")).otherwise(F.col("again"))
    return both.select("id", (F.col("current_balance") + F.col("delta")).alias("current_balance"), as_of.alias("balance_as_of"))


def merged(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """stored with the touched accounts' balances; its other columns and rows as they are."""
    now = touched.select(F.col("id").alias("__id"), F.struct("current_balance", "balance_as_of").alias("__now"))
    both = stored.join(now, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return both.withColumns({c: F.when(hit, F.col(f"__now.{c}")).otherwise(F.col(c)) for c in ("current_balance", "balance_as_of")}).select(*stored.columns)


def touched_alerts(alerts: DataFrame, touched: DataFrame) -> DataFrame:
    """The open alerts (account_id, computed, reported, delta, closed, note) of touched accounts with their new delta; others as they are."""
    open_ = alerts.where("NOT closed")
    now = B.refreshed_alerts(open_.withColumn("resolved_at", F.lit(None).cast("timestamp")), touched)
    now = now.select(F.col("account_id").alias("__id"), F.struct("computed", "delta", "closed", "note").alias("__now"))
    both = alerts.join(now, F.col("account_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull() & ~F.col("closed")
    return both.withColumns({c: F.when(hit, F.col(f"__now.{c}")).otherwise(F.col(c)) for c in ("computed", "delta", "closed", "note")}).select(*alerts.columns)
