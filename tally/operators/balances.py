"""Derived balances, what the bank reported, drift between them, coverage, and the master invariant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods
from tally.operators import predicates as P

TOLERANCE = 0.01


def derived(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """accounts with current_balance = opening + signed posted legs, and balance_as_of; accounts without legs stay."""
    moved = tx.where("state = 'posted' AND superseded_by IS NULL").groupBy(F.col("account_id").alias("id")).agg(F.sum(P.signed_amount()).alias("moved"), F.max("posted_at").alias("balance_as_of"))
    return accounts.join(moved, "id", "left").withColumn("current_balance", F.col("opening_balance") + F.coalesce("moved", F.lit(0))).drop("moved")


def latest_snapshots(snapshots: DataFrame, source: str = "sms") -> DataFrame:
    """One aggregate with partial sums, not a window: the last snapshot of each account."""
    return snapshots.where(F.col("source") == source).groupBy("account_id").agg(F.max_by(F.struct("balance", "as_of"), F.struct("as_of", "id")).alias("s")).select("account_id", F.col("s.balance").alias("reported"), F.col("s.as_of").alias("as_of"))


def drift(balances: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Active, reconcilable accounts whose derived balance is not what the bank last said."""
    rows = balances.where("is_active AND reconcilable").join(latest_snapshots(snapshots).withColumnRenamed("account_id", "id"), "id")
    rows = rows.withColumn("delta", F.col("current_balance") - F.col("reported"))
    return rows.where(F.abs("delta") > F.lit("0.01").cast("decimal(14,2)")).select(F.col("id").alias("account_id"), F.col("current_balance").cast("double").alias("computed"), F.col("reported").cast("double"), F.col("delta").cast("double"), "as_of")


def alert_steps(found: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """(account_id, action): open a drift without an open alert of its delta, close an alert without drift, keep the rest."""
    both = found.select("account_id", "delta").alias("f").join(open_alerts.select("account_id", "delta").alias("o"), (F.col("f.account_id") == F.col("o.account_id")) & (F.abs(F.col("f.delta") - F.col("o.delta")) <= TOLERANCE), "full")
    action = F.when(F.col("o.account_id").isNull(), "open").when(F.col("f.account_id").isNull(), "close").otherwise("keep")
    return both.select(F.coalesce("f.account_id", "o.account_id").alias("account_id"), action.alias("action"), F.coalesce("f.delta", "o.delta").alias("delta"))


def refreshed_alerts(alerts: DataFrame, balances: DataFrame, note: str = "balance agrees after an edit by hand") -> DataFrame:
    """Open alerts (account_id, reported, resolved_at) with the balance as it is now: one that agrees is closed with a note; closed ones stay."""
    now = balances.select(F.col("id").alias("account_id"), "current_balance")
    both = alerts.where("resolved_at IS NULL").join(now, "account_id")
    delta = F.col("current_balance") - F.col("reported")
    agrees = F.abs(delta) <= F.lit(str(TOLERANCE)).cast("decimal(14,2)")
    return both.select("account_id", F.col("current_balance").alias("computed"), delta.alias("delta"), agrees.alias("closed"), F.when(agrees, F.lit(note)).alias("note"))


def second_latest(alerts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each alert (account_id, detected_at) the last but one snapshot before it: since then the drift can have come."""
    seen = alerts.join(snapshots.where("source = 'sms'").select("account_id", "as_of", "id"), "account_id").where("as_of <= detected_at")
    rank = Window.partitionBy("account_id", "detected_at").orderBy(F.col("as_of").desc(), F.col("id").desc())
    second = seen.withColumn("rn", F.row_number().over(rank)).where("rn = 2").select("account_id", "detected_at", F.col("as_of").alias("window_from"))
    return alerts.join(second, ["account_id", "detected_at"], "left")


def coverage(accounts: DataFrame, tx: DataFrame, snapshots: DataFrame, since: dt.date) -> DataFrame:
    """Per active account: parsed messages, those that stated a balance, and how far that checks the account."""
    parsed = tx.where((F.col("origin") == "parsed") & F.col("superseded_by").isNull() & (periods.local_date("posted_at") >= F.lit(since)))
    counts = parsed.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("messages"), F.count("reported_balance").alias("with_balance"))
    last = snapshots.groupBy(F.col("account_id").alias("id")).agg(F.max(F.when(F.col("source") == "sms", F.col("as_of"))).alias("last_reported_at"), F.max(F.when(F.col("source") == "manual", F.col("as_of"))).alias("last_manual_at"))
    rows = accounts.where("is_active").join(counts, "id", "left").join(last, "id", "left")
    rows = rows.withColumns({"messages": F.coalesce("messages", F.lit(0)), "with_balance": F.coalesce("with_balance", F.lit(0))})
    share = F.when(F.col("reconcilable") & (F.col("messages") > 0), F.col("with_balance") / F.col("messages"))
    rows = rows.withColumn("share", share)
    level = F.when(F.col("share").isNull() | (F.col("with_balance") == 0), "none").when((F.col("share") < 0.35) | (F.col("messages") < 5), "weak").when(F.col("share") < 0.9, "partial").otherwise("full")
    return rows.select(F.col("id").alias("account_id"), "messages", "with_balance", F.round("share", 6).alias("share"), level.alias("level"), F.date_format("last_reported_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_reported_at"), F.date_format("last_manual_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_manual_at"))


def _card() -> Column:
    return F.col("is_liability") & (F.col("balance_semantics") == "available_credit") & F.col("credit_limit").isNotNull()


def net_value(balance: Column) -> Column:
    """What an account adds to net worth: a card that reports what is left to spend owes limit - balance."""
    return F.when(_card(), balance - F.col("credit_limit")).when(F.col("is_liability"), -balance).otherwise(balance)


def account_views(balances: DataFrame) -> DataFrame:
    balance = F.col("current_balance")
    debt = F.when(_card(), F.col("credit_limit") - balance).when(F.col("is_liability"), balance)
    return balances.withColumns({"net": net_value(balance), "debt": debt, "available": F.when(_card(), balance), "utilisation": F.when(_card() & (F.col("credit_limit") > 0), debt.cast("double") / F.col("credit_limit").cast("double"))})


def by_institution(views: DataFrame) -> DataFrame:
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return views.groupBy("institution").agg(F.count("*").alias("accounts"), money(F.when(F.col("net") > 0, F.col("net"))).alias("assets"), money(F.when(F.col("net") < 0, -F.col("net"))).alias("debt"), money("net").alias("net"))


def movements(view: DataFrame) -> DataFrame:
    """Signed sums of each cycle and account: posted, those of them that analytics exclude, and legs not yet posted."""
    signed = P.signed_amount()
    part = lambda when: F.coalesce(F.sum(F.when(when, signed)), F.lit(0))
    posted = F.col("state") == "posted"
    return view.groupBy("cycle_start", "account_id").agg(part(posted).alias("posted"), part(posted & F.col("excluded")).alias("excluded_posted"), part(F.col("state").isin("pending", "reversed") & ~F.col("excluded")).alias("unposted"))


def master_invariant(view: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per cycle: the change of net worth against income less expense, after the two items that explain a difference.

    Net worth moves with a balance by +1 for an asset or a card that reports available credit and by -1 for another
    liability, so an account's movement is its own with that sign.
    """
    sign = F.when(F.col("is_liability") & ~_card(), F.lit(-1)).otherwise(F.lit(1))
    moved = movements(view).join(accounts.select(F.col("id").alias("account_id"), sign.alias("sign")), "account_id")
    worth = moved.groupBy("cycle_start").agg(*(F.sum(F.col(c) * F.col("sign")).alias(a) for c, a in (("posted", "observed"), ("excluded_posted", "adjustments"), ("unposted", "unposted"))))
    flows = view.groupBy("cycle_start").agg(F.coalesce(F.sum(F.when(P.is_earned() | P.is_passive(), F.col("amount"))), F.lit(0)).alias("income"), F.coalesce(F.sum(F.when(P.is_expense(), F.col("amount"))), F.lit(0)).alias("expense"))
    rows = worth.join(flows, "cycle_start").withColumn("expected", F.col("income") - F.col("expense"))
    rows = rows.withColumn("unexplained", F.col("observed") - F.col("expected") - F.col("adjustments") + F.col("unposted"))
    d = lambda c: F.col(c).cast("double").alias(c)
    return rows.select(F.col("cycle_start").cast("string").alias("cycle"), d("observed"), d("expected"), d("income"), d("expense"), d("adjustments"), d("unposted"), d("unexplained"), (F.abs("unexplained") <= TOLERANCE).alias("ok"))


def net_worth_series(accounts: DataFrame, snapshots: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(day, value): each account's balance as last reported up to the day, its opening balance before any report.

    Instead of a row for each account and day, a row for each change: an account's reports become steps against the
    one before, steps add up per day, and days without one carry the sum on. What comes before the first day is a
    step of the first day.
    """
    days = snapshots.withColumn("day", periods.local_date("as_of")).where(F.col("day") <= F.lit(last))
    daily = days.groupBy("account_id", "day").agg(F.max_by("balance", F.struct("as_of", "id")).alias("balance"))
    rows = daily.join(accounts.select(F.col("id").alias("account_id"), "opening_balance", "is_liability", "balance_semantics", "credit_limit"), "account_id").withColumn("net", net_value(F.col("balance")))
    before = F.coalesce(F.lag("net").over(Window.partitionBy("account_id").orderBy("day")), net_value(F.col("opening_balance")))
    steps = rows.select(F.greatest(F.col("day"), F.lit(first)).alias("day"), (F.col("net") - before).alias("step"))
    opening = accounts.select(F.lit(first).alias("day"), net_value(F.col("opening_balance")).alias("step"))
    sums = steps.unionByName(opening).groupBy("day").agg(F.sum("step").alias("step"))
    spine = accounts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("day"))
    along = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(sums, "day", "left").select(F.col("day").cast("string").alias("day"), F.sum(F.coalesce("step", F.lit(0))).over(along).cast("double").alias("value"))
