"""Queries on settlements, reversals, refunds, fees, counterparties, and balances at the first and the last report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import lifecycle as C
from tally.operators import metrics
from tally.operators import predicates as P
from tally.plans.registry import query
from tally.plans.spending import EXPENSE, canonical
from tally.sources import tables as S

# ten accounts, so that merchants meet again within days
_TX = f"{S.TX}, t AS (SELECT id, account_id % 10 AS account_id, lower(trim(coalesce(merchant_raw, biller))) AS merchant, category_id, amount, posted_at, direction, type FROM tx WHERE superseded_by IS NULL)"


def _tx(spark, d):
    return S.transactions(spark, d).where("superseded_by IS NULL").withColumns({"account_id": F.col("account_id") % 10, "merchant": C.merchant_key()})


@query(
    "settlement_pairs",
    f"""WITH RECURSIVE {_TX}, h AS (SELECT * FROM t WHERE id % 4 = 0), f AS (SELECT * FROM t WHERE id % 4 <> 0), c AS (SELECT h.id AS pending_id, f.id AS posted_id, date_diff('second', h.posted_at, f.posted_at) AS apart FROM h JOIN f ON h.account_id = f.account_id AND h.merchant = f.merchant AND f.posted_at >= h.posted_at AND date_diff('day', h.posted_at::DATE, f.posted_at::DATE) <= 7 AND abs(f.amount - h.amount) <= h.amount * 0.25),
g AS (SELECT pending_id, posted_id, apart, false AS sure FROM c UNION ALL SELECT pending_id, posted_id, apart, s FROM (SELECT *, bool_or(s) OVER (PARTITION BY pending_id) AS x, bool_or(s) OVER (PARTITION BY posted_id) AS y FROM (SELECT *, row_number() OVER (PARTITION BY pending_id ORDER BY apart, pending_id, posted_id) = 1 AND row_number() OVER (PARTITION BY posted_id ORDER BY apart, pending_id, posted_id) = 1 AS s FROM g WHERE NOT sure)) WHERE s OR NOT (x OR y))
SELECT pending_id, posted_id FROM g WHERE sure""",
)
def settlement_pairs(spark, d):
    """Each fourth transaction is a hold here; the nearest later one of its account, merchant and about its amount settles it."""
    tx = _tx(spark, d)
    return C.settlements(tx.where("id % 4 = 0"), tx.where("id % 4 <> 0"))


@query("reversals_net", f"WITH {S.TX}, r AS (SELECT *, CASE WHEN id % 6 = 1 THEN id - 1 END AS rev, CASE WHEN id % 6 = 1 THEN (CASE WHEN (id - 1) % 5 = 0 THEN 'debit' ELSE 'credit' END) ELSE direction END AS dir FROM tx), b AS (SELECT rev AS id, sum(CASE WHEN dir = 'credit' THEN amount ELSE -amount END) AS back FROM r WHERE rev IS NOT NULL GROUP BY 1) SELECT r.id, (CASE WHEN rev IS NOT NULL THEN 0 ELSE CASE WHEN dir = 'credit' THEN amount ELSE -amount END + coalesce(back, 0) END)::DOUBLE AS net FROM r LEFT JOIN b ON b.id = r.id")
def reversals_net(spark, d):
    """Each sixth transaction reverses the one before it."""
    k = F.col("id")
    rows = S.transactions(spark, d).withColumns({"reverses_transaction_id": F.when(k % 6 == 1, k - 1), "direction": F.when(k % 6 == 1, F.when((k - 1) % 5 == 0, "debit").otherwise("credit")).otherwise(F.col("direction"))})
    return C.net_of_reversals(rows).select("id", F.col("net").cast("double"))


@query(
    "refund_matches",
    f"""WITH {_TX}, p AS (SELECT * FROM t WHERE direction = 'debit'), q AS (SELECT * FROM t WHERE direction = 'credit'), m AS (SELECT q.id AS refund_id, q.amount, q.posted_at, p.id AS purchase_id, p.category_id, p.amount AS price, row_number() OVER (PARTITION BY q.id ORDER BY p.posted_at DESC, p.id DESC) AS r FROM q JOIN p ON p.account_id = q.account_id AND p.merchant = q.merchant AND p.posted_at < q.posted_at AND date_diff('day', p.posted_at::DATE, q.posted_at::DATE) <= 90 AND q.amount <= p.amount),
s AS (SELECT *, sum(amount) OVER (PARTITION BY purchase_id ORDER BY posted_at, refund_id ROWS UNBOUNDED PRECEDING) AS refunded FROM m WHERE r = 1)
SELECT refund_id, purchase_id, category_id, (-amount)::DOUBLE AS amount, refunded::DOUBLE AS refunded, CASE WHEN refunded > price THEN 'review' ELSE 'booked' END AS outcome FROM s""",
)
def refund_matches(spark, d):
    tx = _tx(spark, d)
    found = C.refunds(tx.where("direction = 'debit'"), tx.where("direction = 'credit'"))
    return found.withColumns({"amount": F.col("amount").cast("double"), "refunded": F.col("refunded").cast("double")})


@query("foreign_fee_splits", f"WITH {S.TX}, f AS (SELECT *, CASE WHEN id % 8 = 3 THEN CAST(2.3 AS DECIMAL(14,2)) WHEN id % 8 = 5 THEN CAST(0 AS DECIMAL(14,2)) END AS fee FROM tx) SELECT id AS transaction_id, 1 AS n, category_id, (amount - fee)::DOUBLE AS amount FROM f WHERE fee > 0 AND fee < amount UNION ALL SELECT id, 2, 24, fee::DOUBLE FROM f WHERE fee > 0 AND fee < amount")
def foreign_fee_splits(spark, d):
    fee = F.when(F.col("id") % 8 == 3, F.lit("2.30")).when(F.col("id") % 8 == 5, F.lit("0")).cast("decimal(14,2)")
    return C.fee_splits(S.transactions(spark, d).withColumn("fee_amount", fee), 24).withColumn("amount", F.col("amount").cast("double"))


@query(
    "counterparty_memory",
    f"WITH {S.TX}, c AS (SELECT *, CASE WHEN id % 3 <> 0 THEN account_id % 20 END AS cp, CASE WHEN id % 4 = 1 THEN NULL ELSE category_id END AS cat FROM tx) SELECT id, coalesce(cat, CASE WHEN cp IS NOT NULL THEN last_value(CASE WHEN list_contains(locked_fields, 'category_id') THEN cat END IGNORE NULLS) OVER (PARTITION BY cp ORDER BY posted_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS category_id FROM c",
)
def counterparty_memory(spark, d):
    k = F.col("id")
    rows = S.transactions(spark, d).withColumns({"counterparty": F.when(k % 3 != 0, F.col("account_id") % 20), "category_id": F.when(k % 4 != 1, F.col("category_id"))})
    return C.remembered(rows).select("id", "category_id")


@query("transfer_classes", f"WITH {S.TX} SELECT CASE WHEN id % 3 = 0 THEN 'internal' WHEN direction = 'debit' THEN 'expense' ELSE 'income' END AS class, count(*) AS n, sum(amount)::DOUBLE AS total FROM tx WHERE type = 'transfer' GROUP BY 1")
def transfer_classes(spark, d):
    rows = S.transactions(spark, d).where("type = 'transfer'").withColumn("owned", F.col("id") % 3 == 0)
    return rows.groupBy(C.transfer_class().alias("class")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


_MOVED = f"{S.TX}, {S.ACCOUNTS}, {S.SNAPSHOTS}, lg AS (SELECT id, account_id, posted_at, CASE WHEN direction = 'credit' THEN amount ELSE -amount END AS signed FROM tx WHERE state = 'posted' AND superseded_by IS NULL)"


def _posted(spark, d):
    return S.transactions(spark, d).where("state = 'posted' AND superseded_by IS NULL").select("id", "account_id", "posted_at", "direction", "amount")


@query("opening_from_first_report", f"WITH {_MOVED}, f AS (SELECT account_id, balance, as_of FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of, id) = 1) SELECT f.account_id, (f.balance - coalesce((SELECT sum(signed) FROM lg WHERE lg.account_id = f.account_id AND lg.posted_at <= f.as_of), 0))::DOUBLE AS opening FROM f")
def opening_from_first_report(spark, d):
    return C.first_balances(S.snapshots(spark, d), _posted(spark, d)).withColumn("opening", F.col("opening").cast("double"))


@query(
    "running_reconciliation",
    f"WITH {_MOVED}, l AS (SELECT account_id, balance, as_of FROM snap QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC, id DESC) = 1), c AS (SELECT l.account_id, l.balance AS reported, (SELECT opening_balance FROM acc WHERE acc.id = l.account_id) + sum(signed) AS computed FROM l JOIN lg ON lg.account_id = l.account_id AND lg.posted_at <= l.as_of GROUP BY l.account_id, l.balance) SELECT account_id, computed::DOUBLE AS computed, reported::DOUBLE AS reported, abs(computed - reported) > 0.01 AS off FROM c",
)
def running_reconciliation(spark, d):
    legs = _posted(spark, d).join(S.accounts(spark, d).select(F.col("id").alias("account_id"), "opening_balance"), "account_id")
    rows = C.running_reconciliation(legs, S.snapshots(spark, d))
    return rows.withColumns({"computed": F.col("computed").cast("double"), "reported": F.col("reported").cast("double")})


_ON = dt.date(1997, 8, 11)


@query("normalised_weeks", f"WITH {S.VIEW}, w AS (SELECT week_start, sum(amount)::DOUBLE AS total FROM v WHERE {EXPENSE} AND week_start <= DATE '{_ON}' GROUP BY 1) SELECT week_start::VARCHAR AS week, total, round(total / least(7, date_diff('day', week_start, DATE '{_ON}') + 1), 6) AS a_day FROM w")
def normalised_weeks(spark, d):
    """Spending a day: the week that is still on divides by the days it has had."""
    rows = canonical(spark, d).where(P.is_expense() & (F.col("week_start") <= F.lit(_ON))).groupBy("week_start").agg(F.sum("amount").cast("double").alias("total"))
    days = periods.days_elapsed("week_start", F.date_add("week_start", 6), F.lit(_ON))
    return rows.select(metrics.text("week_start").alias("week"), "total", F.round(C.daily_average(F.col("total"), days), 6).alias("a_day"))


@query("weekly_income_line", f"WITH {S.VIEW}, i AS (SELECT cycle_start, sum(amount)::DOUBLE AS income FROM v WHERE direction = 'credit' AND state = 'posted' AND NOT is_internal AND NOT excluded GROUP BY 1) SELECT cycle_start::VARCHAR AS cycle, round(income / (date_diff('day', cycle_start, (cycle_start + INTERVAL 1 MONTH)::DATE) / 7.0::DOUBLE), 6) AS a_week FROM i")
def weekly_income_line(spark, d):
    """A cycle's income as a line over its weeks: what it is for seven of its days."""
    rows = canonical(spark, d).where("direction = 'credit' AND state = 'posted' AND NOT is_internal AND NOT excluded").groupBy("cycle_start").agg(F.sum("amount").cast("double").alias("income"))
    return rows.select(metrics.text("cycle_start").alias("cycle"), F.round(F.col("income") / (periods.days_in_cycle("cycle_start") / F.lit(7.0)), 6).alias("a_week"))


@query("cashback_wallet", f"WITH {S.VIEW} SELECT account_id, coalesce(sum(amount) FILTER (type = 'profit' AND direction = 'credit' AND NOT excluded AND NOT is_internal), 0)::DOUBLE AS earned, coalesce(sum(amount) FILTER (is_internal AND direction = 'debit'), 0)::DOUBLE AS redeemed FROM v WHERE state = 'posted' GROUP BY 1")
def cashback_wallet(spark, d):
    """What came into an account as profit, and what was moved out of it to others of one's own."""
    from tally.operators.savings import leg_class

    rows = canonical(spark, d).where("state = 'posted'").withColumn("class", leg_class())
    part = lambda k: F.coalesce(F.sum(F.when(F.col("class") == k, F.col("amount"))), F.lit(0)).cast("double")
    return rows.groupBy("account_id").agg(part("profit").alias("earned"), part("withdrawal").alias("redeemed"))


@query("card_spend_average", f"WITH {S.VIEW}, s AS (SELECT account_id, cycle_start, sum(amount)::DOUBLE AS spent FROM v WHERE {EXPENSE} AND cycle_start BETWEEN DATE '1997-02-25' AND DATE '1997-07-25' GROUP BY 1, 2) SELECT account_id, coalesce(sum(spent) FILTER (cycle_start = DATE '1997-07-25'), 0) AS this_cycle, round(avg(spent) FILTER (cycle_start < DATE '1997-07-25'), 6) AS average FROM s GROUP BY 1")
def card_spend_average(spark, d):
    """An account's spending in this cycle against the average of its cycles before that had any."""
    first, this = dt.date(1997, 2, 25), dt.date(1997, 7, 25)
    spent = canonical(spark, d).where(P.is_expense() & F.col("cycle_start").between(F.lit(first), F.lit(this))).groupBy("account_id", "cycle_start").agg(F.sum("amount").cast("double").alias("spent"))
    now = F.col("cycle_start") == F.lit(this)
    return spent.groupBy("account_id").agg(F.coalesce(F.sum(F.when(now, F.col("spent"))), F.lit(0.0)).alias("this_cycle"), F.round(F.avg(F.when(~now, F.col("spent"))), 6).alias("average"))


@query("loan_anchors", f"WITH {S.ACCOUNTS} SELECT id AS loan_id, ({S.cycle_sql('(DATE ' + chr(39) + '1997-08-11' + chr(39) + ' + (id % 40)::INTEGER)')} + INTERVAL 1 MONTH)::DATE::VARCHAR AS first_due FROM acc WHERE is_liability")
def loan_anchors(spark, d):
    """A loan's first payment is due when the cycle after its day begins."""
    day = F.date_add(F.lit(_ON), (F.col("id") % 40).cast("int"))
    return S.accounts(spark, d).where("is_liability").select(F.col("id").alias("loan_id"), F.add_months(periods.period_start(day), 1).cast("string").alias("first_due"))
