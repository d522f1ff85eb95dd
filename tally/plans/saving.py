"""Queries on savings, payouts, loans and cards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import savings as V
from tally.operators import view
from tally.plans.accounts import BAL, current
from tally.plans.registry import query
from tally.sources import tables as S

FIRST, LAST, TODAY = dt.date(1996, 1, 25), dt.date(1997, 7, 25), dt.date(1997, 8, 11)
_SIGNED = "CASE WHEN direction = 'credit' THEN amount ELSE -amount END"
_CYCLES = f"""{S.VIEW}, {S.ACCOUNTS}, lg AS (SELECT v.*, CASE WHEN is_internal AND direction = 'credit' THEN 'deposit' WHEN is_internal THEN 'withdrawal' WHEN type = 'profit' AND direction = 'credit' AND NOT excluded THEN 'profit' ELSE 'other' END AS kind, {_SIGNED} AS signed FROM v WHERE state = 'posted'),
cy AS (SELECT unnest(range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 1 MONTH))::DATE AS cycle), sa AS (SELECT id AS account_id, opening_balance, cycle, least((cycle + INTERVAL 1 MONTH)::DATE - 1, DATE '{TODAY}') AS last_day, DATE '{TODAY}' < (cycle + INTERVAL 1 MONTH)::DATE - 1 AS partial FROM acc, cy WHERE is_profit_bearing),
ct AS (SELECT account_id, cycle_start AS cycle, coalesce(sum(amount) FILTER (kind = 'deposit'), 0) AS deposits, coalesce(sum(amount) FILTER (kind = 'withdrawal'), 0) AS withdrawals, coalesce(sum(amount) FILTER (kind = 'profit'), 0) AS profit, coalesce(sum(signed) FILTER (kind = 'other'), 0) AS other FROM lg GROUP BY 1, 2),
dd AS (SELECT sa.account_id, sa.cycle, opening_balance, unnest(range(cycle, last_day + 1, INTERVAL 1 DAY))::DATE AS day FROM sa), dm AS (SELECT account_id, local_day AS day, sum(signed) AS moved FROM lg WHERE local_day >= DATE '{FIRST}' GROUP BY 1, 2),
db AS (SELECT dd.*, opening_balance + sum(coalesce(moved, 0)) OVER (PARTITION BY dd.account_id ORDER BY dd.day) AS balance FROM dd LEFT JOIN dm USING (account_id, day)), av AS (SELECT account_id, cycle, count(*) AS days, (sum(balance)::DOUBLE / count(*)) AS average_daily, arg_max(balance, day) AS closing FROM db GROUP BY 1, 2),
j AS (SELECT sa.account_id, sa.cycle, sa.partial, opening_balance, coalesce(deposits, 0) AS deposits, coalesce(withdrawals, 0) AS withdrawals, coalesce(profit, 0) AS profit, coalesce(other, 0) AS other, days, average_daily, closing FROM sa JOIN av USING (account_id, cycle) LEFT JOIN ct USING (account_id, cycle)),
sv AS (SELECT *, opening_balance + sum(deposits - withdrawals) OVER w AS principal, sum(profit) OVER w AS all_profit, sum(other) OVER w AS all_other, CASE WHEN average_daily > 0 THEN profit::DOUBLE / average_daily * 12 END AS realized_yield, CASE WHEN closing > 0 THEN profit::DOUBLE / closing::DOUBLE * 12 END AS closing_yield FROM j WINDOW w AS (PARTITION BY account_id ORDER BY cycle))"""


def _savers(spark, d) -> DataFrame:
    return S.accounts(spark, d).where("is_profit_bearing")


def _history(spark, d) -> DataFrame:
    legs = view.categorized_amounts(S.transactions(spark, d), S.splits(spark, d)).where("state = 'posted'")
    savers = _savers(spark, d)
    return V.savings_by_cycle(savers, legs.join(savers.select(F.col("id").alias("account_id")), "account_id", "left_semi"), FIRST, LAST, TODAY)


@query("savings_by_cycle", f"WITH {_CYCLES} SELECT account_id, cycle::VARCHAR AS cycle, partial, days, deposits::DOUBLE AS deposits, withdrawals::DOUBLE AS withdrawals, profit::DOUBLE AS profit, other::DOUBLE AS other, round(average_daily, 3) AS average_daily, closing::DOUBLE AS closing, principal::DOUBLE AS principal, all_profit::DOUBLE AS all_profit, (principal + all_profit + all_other - closing)::DOUBLE AS residual FROM sv")
def savings_by_cycle(spark, d):
    c = lambda n: F.col(n).cast("double").alias(n)
    return _history(spark, d).select("account_id", F.col("cycle").cast("string"), "partial", F.col("days").cast("long"), c("deposits"), c("withdrawals"), c("profit"), c("other"), F.round("average_daily", 3).alias("average_daily"), c("closing"), c("principal"), c("all_profit"), c("residual"))


@query("savings_trailing_yield", f"WITH {_CYCLES} SELECT account_id, cycle::VARCHAR AS cycle, round(realized_yield, 8) AS realized_yield, round(closing_yield, 8) AS closing_yield, round(avg(realized_yield) OVER (PARTITION BY account_id ORDER BY cycle ROWS 2 PRECEDING), 8) AS trailing_yield FROM sv")
def savings_trailing_yield(spark, d):
    return _history(spark, d).select("account_id", F.col("cycle").cast("string"), F.round("realized_yield", 8).alias("realized_yield"), F.round("closing_yield", 8).alias("closing_yield"), F.round("trailing_yield", 8).alias("trailing_yield"))


@query(
    "yield_projection_band",
    f"""WITH RECURSIVE {_CYCLES}, h AS (SELECT account_id, arg_max(closing, cycle)::DOUBLE AS balance, avg(realized_yield) AS mean, coalesce(stddev_samp(realized_yield), 0) AS dev FROM (SELECT account_id, cycle, closing, realized_yield FROM sv) GROUP BY 1 HAVING count(realized_yield) > 0),
p AS (SELECT account_id, 0 AS ahead, balance AS low, balance AS mid, balance AS high, mean, dev FROM h UNION ALL SELECT account_id, ahead + 1, low * (1 + greatest(0, mean - dev) / 12) + 100, mid * (1 + mean / 12) + 100, high * (1 + (mean + dev) / 12) + 100, mean, dev FROM p WHERE ahead < 24)
SELECT account_id, ahead::BIGINT AS ahead, format('{{:.9e}}', low)::DOUBLE AS low, format('{{:.9e}}', mid)::DOUBLE AS mid, format('{{:.9e}}', high)::DOUBLE AS high FROM p""",
)
def yield_projection_band(spark, d):
    """From each account's history, as it is: a year's yield on a balance near zero is a large one. Ten digits are told."""
    seen = _history(spark, d)
    history = seen.groupBy("account_id").agg(F.max_by("closing", "cycle").alias("balance"), F.avg("realized_yield").alias("mean"), F.coalesce(F.stddev_samp("realized_yield"), F.lit(0.0)).alias("deviation")).where("mean IS NOT NULL").withColumn("contribution", F.lit(100.0))
    return V.projection(history).select("account_id", "ahead", *(F.format_string("%.9e", c).cast("double").alias(c) for c in ("low", "mid", "high")))


@query(
    "payout_status",
    f"""WITH {S.TX}, p AS (SELECT DISTINCT account_id, {S.LOCAL.format('posted_at')} AS day FROM tx WHERE type IN ('profit', 'income') AND superseded_by IS NULL), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY account_id ORDER BY day), day) AS gap FROM p), m AS (SELECT account_id, count(*) AS n, max(day) AS last_at, floor(median(gap) + 0.5)::INTEGER AS cadence FROM g GROUP BY 1),
e AS (SELECT *, CASE WHEN n >= 2 THEN last_at + cadence END AS eb FROM m), l AS (SELECT *, date_diff('day', eb, DATE '1999-06-01') AS od FROM e) SELECT account_id, n, CASE WHEN n >= 2 THEN cadence END AS cadence, last_at::VARCHAR AS last_at, eb::VARCHAR AS expected_by, coalesce(greatest(0, od - 5), 0)::INTEGER AS days_late, CASE WHEN n < 2 THEN 'unknown' WHEN greatest(0, od - 5) = 0 THEN 'on-time' WHEN od >= cadence THEN 'missing' ELSE 'late' END AS state FROM l""",
)
def payout_status(spark, d):
    from tally.functions import periods

    rows = S.transactions(spark, d).where("type IN ('profit', 'income') AND superseded_by IS NULL").select("account_id", periods.local_date("posted_at").alias("day"))
    t = lambda c: F.col(c).cast("string").alias(c)
    return V.payout_status(rows, dt.date(1999, 6, 1)).select("account_id", "n", "cadence", t("last_at"), t("expected_by"), "days_late", "state")


#: Loans whose schedules a task works out.
LOANS_A_TASK = 2000


def loans(spark, d) -> DataFrame:
    """One loan for each liability: principal from the balance, a yearly rate in percent or as a share, a payment.

    Dealt over tasks: a loan is a few bytes that a small file holds many of, but its schedule is up to 600 rows.
    """
    rows = S.accounts(spark, d).where("is_liability")
    rows = rows.repartition(1 + rows.count() // LOANS_A_TASK, "id")
    return rows.select(F.col("id").alias("loan_id"), (F.abs("opening_balance") + 1000).cast("double").alias("balance"), F.when(F.col("id") % 24 == 0, (F.col("id") % 9 + 2).cast("double")).otherwise((F.col("id") % 9 + 2) / 100.0).alias("apr"), (50 + F.col("id") % 7 * 100).cast("double").alias("payment"))


_LOANS = "loans AS (SELECT c_custkey AS loan_id, (abs(CAST(c_acctbal AS DECIMAL(14,2))) + 1000)::DOUBLE AS balance, CASE WHEN c_custkey % 24 = 0 THEN (c_custkey % 9 + 2)::DOUBLE ELSE (c_custkey % 9 + 2) / 100.0::DOUBLE END AS apr, (50 + c_custkey % 7 * 100)::DOUBLE AS payment FROM customer WHERE c_custkey % 4 = 0)"
_RATE = "CASE WHEN apr > 1 THEN apr / 100 WHEN apr > 0 THEN apr ELSE 0 END / 12"


def _amortized(extra: str) -> str:
    return f"""SELECT loan_id, 0 AS n, balance AS b, 0::DOUBLE AS pay, 0::DOUBLE AS i, {_RATE} AS rate, payment + {extra} AS payment FROM loans WHERE payment + {extra} > balance * ({_RATE}) + 0.01
UNION ALL SELECT loan_id, n + 1, greatest(0, b - (least(payment, b + b * rate) - b * rate)), least(payment, b + b * rate), b * rate, rate, payment FROM {{0}} WHERE b > 0.005 AND n < 600"""


@query("loan_amortization", f"WITH RECURSIVE {_LOANS}, am AS ({_amortized('0').format('am')}) SELECT loan_id, n::INTEGER AS n, pay AS payment, i AS interest, pay - i AS principal, b AS balance FROM am WHERE n > 0")
def loan_amortization(spark, d):
    rate = V.normalised_apr(F.col("apr")) / 12
    rows = loans(spark, d).select("loan_id", F.explode(V.schedule(F.col("balance"), rate, F.col("payment"))).alias("r"))
    return rows.select("loan_id", "r.n", *(F.col(f"r.{c}").alias(c) for c in ("payment", "interest", "principal", "balance")))


@query(
    "extra_payment",
    f"WITH RECURSIVE {_LOANS}, am AS ({_amortized('0').format('am')}), ax AS ({_amortized('150').format('ax')}), ba AS (SELECT loan_id, max(n) AS m, sum(i) AS t, min(b) <= 0.005 AS c FROM am GROUP BY 1), bx AS (SELECT loan_id, max(n) AS m, sum(i) AS t, min(b) <= 0.005 AS c FROM ax GROUP BY 1) SELECT l.loan_id, CASE WHEN ba.c AND bx.c THEN ba.m - bx.m END::BIGINT AS months_saved, round(coalesce(ba.t, 0) - coalesce(bx.t, 0), 3) AS interest_saved FROM loans l LEFT JOIN ba USING (loan_id) LEFT JOIN bx USING (loan_id)",
)
def extra_payment(spark, d):
    rate = V.normalised_apr(F.col("apr")) / 12
    rows = loans(spark, d).withColumns({"base": V.schedule(F.col("balance"), rate, F.col("payment")), "more": V.schedule(F.col("balance"), rate, F.col("payment") + 150)})
    a, b = V.schedule_summary(F.col("base")), V.schedule_summary(F.col("more"))
    return rows.select("loan_id", (a["months"] - b["months"]).alias("months_saved"), F.round(a["interest"] - b["interest"], 3).alias("interest_saved"))


@query(
    "minimum_vs_full",
    f"""WITH RECURSIVE {BAL}, cards AS (SELECT id, (abs(credit_limit - current_balance) % 9000)::DOUBLE AS debt, (0.02 + id % 5 * 0.01)::DOUBLE AS share FROM bal WHERE credit_limit IS NOT NULL),
m AS (SELECT id, debt AS b, 0::DOUBLE AS i, 0::DOUBLE AS p, 0 AS n, share, false AS stuck FROM cards UNION ALL SELECT id, CASE WHEN s THEN b ELSE b + int - pay END, CASE WHEN s THEN i ELSE i + int END, CASE WHEN s THEN p ELSE p + pay END, CASE WHEN s THEN n ELSE n + 1 END, share, s FROM (SELECT *, b * 0.025::DOUBLE AS int, least(b + b * 0.025::DOUBLE, greatest((b + b * 0.025::DOUBLE) * share, 100)) AS pay, least(b + b * 0.025::DOUBLE, greatest((b + b * 0.025::DOUBLE) * share, 100)) <= b * 0.025::DOUBLE + 0.01 AS s FROM m WHERE b > 0.01 AND NOT stuck AND n < 600)),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, stuck DESC) = 1)
SELECT id AS account_id, CASE WHEN b <= 0.01 THEN n END::BIGINT AS months, round(i, 3) AS interest, round(p, 3) AS paid, b <= 0.01 AS cleared FROM l""",
)
def minimum_vs_full(spark, d):
    cards = current(spark, d).where("credit_limit IS NOT NULL").select("id", (F.abs(F.col("credit_limit") - F.col("current_balance")) % 9000).cast("double").alias("debt"), (F.lit(0.02).cast("decimal(10,2)") + F.col("id") % 5 * F.lit(0.01).cast("decimal(10,2)")).cast("double").alias("share"))
    rows = cards.withColumn("m", V.minimum_payments(F.col("debt"), F.col("share")))
    cleared = F.col("m.balance") <= 0.01
    return rows.select(F.col("id").alias("account_id"), F.when(cleared, F.col("m.months")).cast("long").alias("months"), F.round("m.interest", 3).alias("interest"), F.round("m.paid", 3).alias("paid"), cleared.alias("cleared"))


@query(
    "statement_states",
    "SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 4 = 0 THEN 'paid' WHEN o_orderkey % 10 = 1 THEN 'unknown' WHEN date_diff('day', DATE '1997-08-11', o_orderdate::DATE + 20) < 0 THEN 'overdue' WHEN date_diff('day', DATE '1997-08-11', o_orderdate::DATE + 20) <= 3 THEN 'due-soon' ELSE 'scheduled' END AS state FROM orders",
)
def statement_states(spark, d):
    rows = S.table(spark, d, "orders")
    due = F.when(F.col("o_orderkey") % 10 != 1, F.date_add(F.to_date("o_orderdate"), 20))
    return rows.select(F.col("o_orderkey").alias("statement_id"), V.statement_state(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")), due, TODAY).alias("state"))
