"""Savings by cycle, projections, payouts, and the schedules of loans and cards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods

CYCLES_PER_YEAR = 12


def leg_class() -> Column:
    profit = (F.col("type") == "profit") & (F.col("direction") == "credit") & ~F.col("excluded")
    return F.when(F.col("is_internal") & (F.col("direction") == "credit"), "deposit").when(F.col("is_internal"), "withdrawal").when(profit, "profit").otherwise("other")


def savings_by_cycle(accounts: DataFrame, legs: DataFrame, first: dt.date, last: dt.date, today: dt.date, expenses: DataFrame | None = None) -> DataFrame:
    """Per account and cycle: what came and went, balances and yields. legs have local_day and cycle_start.

    The average daily balance needs no row for each day: a leg raises it by its amount times the days from it to
    the cycle's last day, so one sum per cycle and one running sum of closing balances give it exactly.
    """
    spine = accounts.select(F.col("id").alias("account_id"), F.col("opening_balance")).crossJoin(accounts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))).alias("cycle")))
    end = F.least(periods.period_end("cycle"), F.lit(today))
    spine = spine.withColumns({"days": F.greatest(F.lit(0), F.datediff(end, "cycle") + 1), "partial": F.lit(today) < periods.period_end("cycle")})
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    kind = leg_class()
    part = lambda k, value: F.coalesce(F.sum(F.when(F.col("kind") == k, value)), F.lit(0))
    classed = legs.withColumns({"kind": kind, "signed": signed})
    counters = classed.groupBy("account_id", F.col("cycle_start").alias("cycle")).agg(part("deposit", F.col("amount")).alias("deposits"), part("withdrawal", F.col("amount")).alias("withdrawals"), part("profit", F.col("amount")).alias("profit"), part("other", F.col("signed")).alias("other"))
    on_day = classed.withColumn("cycle", periods.period_start("local_day")).where((F.col("local_day") >= F.lit(first)) & (F.col("local_day") <= F.lit(today)))
    left = F.datediff(F.least(periods.period_end("cycle"), F.lit(today)), "local_day") + 1
    daily = on_day.groupBy("account_id", "cycle").agg(F.sum("signed").alias("moved"), F.sum(F.col("signed") * left).alias("moved_days"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = spine.join(counters, ["account_id", "cycle"], "left").join(daily, ["account_id", "cycle"], "left").select("account_id", "cycle", "opening_balance", "days", "partial", *map(zero, ("deposits", "withdrawals", "profit", "other", "moved", "moved_days")))
    along = Window.partitionBy("account_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    closing = F.col("opening_balance") + F.sum("moved").over(along)
    rows = rows.withColumns({"closing": closing, "principal": F.col("opening_balance") + F.sum(F.col("deposits") - F.col("withdrawals")).over(along), "all_profit": F.sum("profit").over(along), "all_other": F.sum("other").over(along)})
    average = F.when(F.col("days") > 0, ((F.col("closing") - F.col("moved")) * F.col("days") + F.col("moved_days")).cast("double") / F.nullif(F.col("days"), F.lit(0))).otherwise(0.0)
    rows = rows.withColumn("average_daily", average)
    rate = lambda base: F.when(base > 0, F.col("profit").cast("double") / F.nullif(base, F.lit(0.0)) * CYCLES_PER_YEAR)
    rows = rows.withColumns({"realized_yield": rate(F.col("average_daily")), "closing_yield": rate(F.col("closing").cast("double")), "residual": F.col("principal") + F.col("all_profit") + F.col("all_other") - F.col("closing")})
    rows = rows.withColumn("trailing_yield", F.avg("realized_yield").over(Window.partitionBy("account_id").orderBy("cycle").rowsBetween(-2, 0)))
    if expenses is not None:
        rows = rows.join(expenses.select("cycle", "expense"), "cycle", "left").withColumn("passive_coverage", F.when(F.col("expense") > 0, F.col("profit").cast("double") / F.nullif(F.col("expense"), F.lit(0.0))))
    return rows


def projection(history: DataFrame, cycles: int = 24) -> DataFrame:
    """(account_id, ahead, low, mid, high): balance compounding at the mean yield and a standard deviation to each side.

    history has account_id, balance, contribution and the observed yields' mean and deviation.
    """
    low, high = F.greatest(F.lit(0.0), F.col("mean") - F.col("deviation")), F.col("mean") + F.col("deviation")

    def grown(rate: Column) -> Column:
        start = F.array(F.col("balance").cast("double"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(cycles)), start, lambda done, _: F.concat(done, F.array(F.element_at(done, -1) * (1 + rate / CYCLES_PER_YEAR) + F.col("contribution"))))

    rows = history.select("account_id", F.arrays_zip(grown(low).alias("low"), grown(F.col("mean")).alias("mid"), grown(high).alias("high")).alias("points"))
    return rows.select("account_id", F.posexplode("points").alias("ahead", "p")).select("account_id", F.col("ahead").cast("long"), "p.low", "p.mid", "p.high")


def payout_status(payouts: DataFrame, today: dt.date, grace: int = 5) -> DataFrame:
    """(account_id, day) of profits -> cadence, when the next is due, and whether it is on time, late or missing."""
    days = payouts.select("account_id", "day").distinct()
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("account_id").orderBy("day"))))
    rows = gaps.groupBy("account_id").agg(F.count("*").alias("n"), F.max("day").alias("last_at"), F.floor(F.median("gap") + 0.5).cast("int").alias("cadence"))
    rows = rows.withColumn("expected_by", F.when(F.col("n") >= 2, F.date_add("last_at", F.col("cadence"))))
    overdue = F.datediff(F.lit(today), F.col("expected_by"))
    rows = rows.withColumn("days_late", F.coalesce(F.greatest(F.lit(0), overdue - grace), F.lit(0)))
    state = F.when(F.col("n") < 2, "unknown").when(F.col("days_late") == 0, "on-time").when(overdue >= F.col("cadence"), "missing").otherwise("late")
    return rows.select("account_id", "n", F.when(F.col("n") >= 2, F.col("cadence")).alias("cadence"), "last_at", "expected_by", "days_late", state.alias("state"))


def normalised_apr(apr: Column) -> Column:
    """A rate above 1 was given in percent; none or a negative one is 0."""
    return F.when(apr > 1, apr / 100).when(apr > 0, apr).otherwise(F.lit(0.0))


_ROW = "array<struct<n: int, payment: double, interest: double, principal: double, balance: double>>"


def schedule(balance: Column, rate: Column, payment: Column, months: int = 600) -> Column:
    """Payments until the balance is gone, the last one clipped; empty if a payment doesn't cover the first interest.

    The formula of an annuity says how many months that takes at most, two more for rounding; the rows come from the payments themselves.
    """
    whole = F.when(rate > 0, -F.log1p(-balance * rate / payment) / F.log1p(rate)).otherwise(balance / payment)
    most = F.least(F.lit(months), F.coalesce(F.when(whole < months, F.ceil(whole) + 2), F.lit(months))).cast("int")

    def step(done: Column, n: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["balance"], balance)
        interest = before * rate
        paid = F.least(payment, before + interest)
        row = F.struct(n.alias("n"), paid.alias("payment"), interest.alias("interest"), (paid - interest).alias("principal"), F.greatest(F.lit(0.0), before - (paid - interest)).alias("balance"))
        return F.when(before > 0.005, F.concat(done, F.array(row))).otherwise(done)

    none = F.array().cast(_ROW)
    return F.when((balance <= 0) | (payment <= balance * rate + 0.01), none).otherwise(F.aggregate(F.sequence(F.lit(1), most), none, step))


def schedule_summary(rows: Column) -> dict[str, Column]:
    total = lambda field: F.aggregate(rows, F.lit(0.0), lambda t, r: t + r[field])
    cleared = (F.size(rows) > 0) & (F.try_element_at(rows, F.lit(-1))["balance"] <= 0.005)
    return {"months": F.when(cleared, F.size(rows)).cast("long"), "interest": total("interest"), "paid": total("payment")}


def minimum_payments(balance: Column, share: Column, monthly_rate: float = 0.025, floor: float = 100.0, months: int = 600) -> Column:
    """(months, interest, paid, balance) of paying only the minimum; it never ends if a payment is no more than the interest."""

    def step(state: Column, _: Column) -> Column:
        interest = state["balance"] * monthly_rate
        due = state["balance"] + interest
        paid = F.least(due, F.greatest(due * share, F.lit(floor)))
        stuck = paid <= interest + 0.01
        later = F.struct((due - paid).alias("balance"), (state["interest"] + interest).alias("interest"), (state["paid"] + paid).alias("paid"), (state["months"] + 1).alias("months"), F.lit(False).alias("stuck"))
        held = F.struct(state["balance"].alias("balance"), state["interest"].alias("interest"), state["paid"].alias("paid"), state["months"].alias("months"), (state["stuck"] | stuck).alias("stuck"))
        return F.when(state["stuck"] | (state["balance"] <= 0.01) | stuck, F.when(state["balance"] <= 0.01, state).otherwise(held)).otherwise(later)

    start = F.struct(balance.alias("balance"), F.lit(0.0).alias("interest"), F.lit(0.0).alias("paid"), F.lit(0).alias("months"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(months)), start, step)


def statement_state(paid_at: Column, due: Column, today: dt.date) -> Column:
    left = F.datediff(due, F.lit(today))
    return F.when(paid_at.isNotNull(), "paid").when(due.isNull(), "unknown").when(left < 0, "overdue").when(left <= 3, "due-soon").otherwise("scheduled")
