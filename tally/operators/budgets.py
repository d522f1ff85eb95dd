"""Pacing, carry and goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import predicates as P

TOLERANCE = 0.05


def pace(budget: Column, spent: Column, elapsed: Column, total: Column, week_days: Column | None = None) -> dict[str, Column]:
    """Columns of a budget's pace. A share over a zero budget is infinite; without a budget the shares are null."""
    days = F.greatest(total, F.lit(1)).cast("double")
    gone = F.least(F.greatest(elapsed, F.lit(0)), days).cast("double")
    week_days = F.lit(7) if week_days is None else week_days
    elapsed_share, weeks_left = gone / days, (days - gone) / 7
    share = F.when(budget.isNull(), None).when(budget > 0, spent / F.nullif(budget, F.lit(0.0))).when(spent > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    verdict = F.when(budget.isNull(), None).when((spent > budget) | (share == float("inf")) | (share > elapsed_share + TOLERANCE), "Over").when(share < elapsed_share - TOLERANCE, "Ahead").otherwise("On pace")
    return {
        "spent_share": share,
        "elapsed_share": elapsed_share,
        "verdict": verdict,
        "weeks_left": weeks_left,
        "remaining_pace": F.when(weeks_left >= 0.5, (budget - spent) / F.nullif(weeks_left, F.lit(0.0))),
        "fair_share": budget * week_days / days,
        "projected": F.when(gone > 0, spent / F.nullif(gone, F.lit(0.0)) * days).otherwise(spent),
    }


def carry_forward(amount: Column, carry_in: Column, spent: Column, rollover: Column) -> Column:
    return F.when(rollover, amount + carry_in - spent).otherwise(F.lit(0))


def spend(view: DataFrame) -> DataFrame:
    return view.where(P.is_expense() & F.col("category_id").isNotNull()).groupBy("cycle_start", "category_id").agg(F.sum("amount").alias("spent"))


def close_cycles(budgets: DataFrame, view: DataFrame, today) -> DataFrame:
    """The budgets after every ended cycle was closed once into the next one.

    The carry of a closed cycle is written to the next cycle's row, which is made if there is none; a row that was
    settled before keeps its carry. Carries don't cascade: each is from the carry_in that its cycle has now.
    """
    ended = budgets.where(F.datediff(F.lit(today), periods.period_end("cycle_start")) > 0)
    closing = ended.join(spend(view), ["cycle_start", "category_id"], "left")
    carry = carry_forward(F.col("amount"), F.col("carry_in"), F.coalesce("spent", F.lit(0)), F.col("rollover"))
    into = closing.select("category_id", F.add_months("cycle_start", 1).alias("cycle_start"), F.col("amount").alias("base"), F.col("rollover").alias("rolls"), carry.alias("carry"))
    both = budgets.join(into, ["category_id", "cycle_start"], "full")
    settled, written = F.col("carry_closed_at").isNotNull(), F.col("carry").isNotNull()
    action = F.when(written & settled, "settled").when(written & F.col("amount").isNull(), "created").when(written, "carried").otherwise("kept")
    return both.select("category_id", "cycle_start", F.coalesce("amount", "base").alias("amount"), F.coalesce("rollover", "rolls").alias("rollover"), F.when(written & ~settled, F.col("carry")).otherwise(F.col("carry_in")).alias("carry_in"), action.alias("action"))


#: Fixed value: cycles of carries that a budget's history shows, the one looked at included.
HISTORY_CYCLES = 6


def history(budgets: DataFrame, cycle, cycles: int = HISTORY_CYCLES) -> DataFrame:
    """The budgets of the last cycles up to the one given (any day of it), with the place of each from the newest on, 1 first."""
    last = periods.period_start(F.lit(cycle))
    rows = budgets.where(F.col("cycle_start").between(F.add_months(last, 1 - cycles), last))
    return rows.withColumn("place", F.months_between(last, F.col("cycle_start")).cast("int") + 1)


def unclosed_cycles(budgets: DataFrame, today, limit: int = 6) -> DataFrame:
    """The first cycles that have ended and whose next cycle has no settled carry."""
    ended = budgets.where(F.col("cycle_start") < periods.period_start(F.lit(today))).select("cycle_start").distinct()
    closed = budgets.where("carry_closed_at IS NOT NULL").select(F.add_months("cycle_start", -1).alias("cycle_start")).distinct()
    return ended.join(closed, "cycle_start", "left_anti").orderBy("cycle_start").limit(limit)


def cycles_until(target: Column, now: Column) -> Column:
    """Cycles from this one to the target's, both counted; 0 if the target is past."""
    here, there = periods.period_start(now), periods.period_start(target)
    return F.when(target < now, 0).otherwise(F.months_between(there, here).cast("int") + 1)


def goal_buckets(goals: DataFrame, balances: DataFrame) -> DataFrame:
    """Per linked account: what its goals have been allotted against what it holds."""
    allotted = goals.where("account_id IS NOT NULL").groupBy("account_id").agg(F.sum("allocation").alias("allocated"))
    rows = allotted.join(balances.select(F.col("id").alias("account_id"), F.col("current_balance").alias("held")), "account_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    held, allocated = F.col("held").cast("double"), F.col("allocated").cast("double")
    covered = F.when(allocated <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), held) / F.nullif(allocated, F.lit(0.0))))
    return rows.select("account_id", held.alias("balance"), allocated.alias("allocated"), (F.col("held") - F.col("allocated")).cast("double").alias("remainder"), covered.alias("coverage"), (F.col("allocated") > F.col("held")).alias("over_allocated"))


def goal_views(goals: DataFrame, buckets: DataFrame, run_rates: DataFrame, now) -> DataFrame:
    rows = goals.join(buckets.select("account_id", "allocated", "coverage"), "account_id", "left").join(run_rates.select("account_id", "run_rate"), "account_id", "left")
    linked, allocation, target = F.col("account_id").isNotNull(), F.col("allocation").cast("double"), F.col("target_amount").cast("double")
    rows = rows.withColumn("funded", F.greatest(F.lit(0.0), allocation * F.coalesce("coverage", F.when(linked, 0.0).otherwise(1.0))))
    rows = rows.withColumns({"remaining": F.greatest(F.lit(0.0), target - F.col("funded")), "cycles_left": F.when(F.col("target_date").isNotNull(), cycles_until(F.col("target_date"), F.lit(now)))})
    share = F.when(F.col("allocated") > 0, allocation / F.nullif(F.col("allocated"), F.lit(0.0))).otherwise(F.when(linked, 0.0).otherwise(1.0))
    rows = rows.withColumns({"required": F.when(F.col("cycles_left") > 0, F.col("remaining") / F.nullif(F.col("cycles_left"), F.lit(0))).when(F.col("cycles_left") == 0, F.col("remaining")), "rate": F.col("run_rate") * share})
    on_track = F.when(F.col("required").isNull() | F.col("rate").isNull(), None).otherwise((F.col("remaining") == 0) | (F.col("rate") >= F.col("required")))
    return rows.select("goal_id", "funded", (F.col("funded") / target).alias("progress"), "remaining", F.col("cycles_left").cast("long"), F.col("required").alias("required_per_cycle"), ((F.col("cycles_left") == 0) & (F.col("remaining") > 0)).alias("overdue"), F.col("rate").alias("run_rate"), on_track.alias("on_track"))
