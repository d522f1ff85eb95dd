"""Queries on balances, drift, coverage, net worth and the invariant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tally.operators import balances, metrics
from tally.operators import predicates as P
from tally.plans.registry import query
from tally.plans.spending import CYCLE, EARNED, EXPENSE, PASSIVE, canonical, total
from tally.sources import tables as S

BAL = f"{S.TX}, {S.ACCOUNTS}, bal AS (SELECT a.*, a.opening_balance + coalesce(m.moved, 0) AS current_balance, m.as_of AS balance_as_of FROM acc a LEFT JOIN (SELECT account_id, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS moved, max(posted_at) AS as_of FROM tx WHERE state = 'posted' AND superseded_by IS NULL GROUP BY 1) m ON m.account_id = a.id)"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def current(spark, d):
    return balances.derived(S.accounts(spark, d), S.transactions(spark, d))


@query("derived_balances", f"WITH {BAL} SELECT id AS account_id, current_balance::DOUBLE AS current_balance, strftime(balance_as_of, {_ISO}) AS balance_as_of FROM bal")
def derived_balances(spark, d):
    return current(spark, d).select(F.col("id").alias("account_id"), F.col("current_balance").cast("double"), F.date_format("balance_as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("balance_as_of"))


_DRIFT = f"WITH {BAL}, {S.SNAPSHOTS}, l AS (SELECT * FROM snap WHERE source = 'sms' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC, id DESC) = 1), dr AS (SELECT b.id AS account_id, b.current_balance AS computed, l.balance AS reported, b.current_balance - l.balance AS delta, l.as_of FROM bal b JOIN l ON l.account_id = b.id WHERE b.is_active AND b.reconcilable AND abs(b.current_balance - l.balance) > 0.01)"


@query("latest_snapshot_drift", f"{_DRIFT} SELECT account_id, computed::DOUBLE AS computed, reported::DOUBLE AS reported, delta::DOUBLE AS delta, as_of::VARCHAR AS as_of FROM dr")
def latest_snapshot_drift(spark, d):
    return balances.drift(current(spark, d), S.snapshots(spark, d)).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


@query(
    "drift_alert_steps",
    f"{_DRIFT}, o AS (SELECT account_id, CASE WHEN account_id % 4 = 0 THEN delta + 5 ELSE delta END AS delta FROM dr WHERE account_id % 3 = 0 UNION ALL SELECT id, 7.77 FROM acc WHERE id % 50 = 1 AND id NOT IN (SELECT account_id FROM dr)) SELECT coalesce(f.account_id, o.account_id) AS account_id, CASE WHEN o.account_id IS NULL THEN 'open' WHEN f.account_id IS NULL THEN 'close' ELSE 'keep' END AS action, round(coalesce(f.delta, o.delta)::DOUBLE, 2) AS delta FROM dr f FULL JOIN o ON f.account_id = o.account_id AND abs(f.delta - o.delta) <= 0.01",
)
def drift_alert_steps(spark, d):
    """Alerts stand open for a third of the drifting accounts, a quarter of them of another delta, and for some that agree."""
    found = balances.drift(current(spark, d), S.snapshots(spark, d))
    standing = found.where("account_id % 3 = 0").select("account_id", F.when(F.col("account_id") % 4 == 0, F.col("delta") + 5).otherwise(F.col("delta")).alias("delta"))
    stale = S.accounts(spark, d).where("id % 50 = 1").select(F.col("id").alias("account_id"), F.lit(7.77).alias("delta")).join(found, "account_id", "left_anti")
    return balances.alert_steps(found, standing.unionByName(stale)).withColumn("delta", F.round("delta", 2))


@query(
    "alert_window_second_latest",
    f"{_DRIFT}, a AS (SELECT account_id, as_of AS detected_at FROM dr), s AS (SELECT a.account_id, s.as_of FROM a JOIN snap s ON s.account_id = a.account_id AND s.source = 'sms' AND s.as_of <= a.detected_at QUALIFY row_number() OVER (PARTITION BY a.account_id ORDER BY s.as_of DESC, s.id DESC) = 2) SELECT a.account_id, a.detected_at::VARCHAR AS detected_at, s.as_of::VARCHAR AS window_from FROM a LEFT JOIN s USING (account_id)",
)
def alert_window_second_latest(spark, d):
    reported = S.snapshots(spark, d)
    alerts = balances.drift(current(spark, d), reported).select("account_id", F.col("as_of").alias("detected_at"))
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return balances.second_latest(alerts, reported).select("account_id", t("detected_at"), t("window_from"))


_SINCE = dt.date(1997, 1, 1)


@query(
    "balance_coverage_level",
    f"""WITH {S.TX}, {S.ACCOUNTS}, {S.SNAPSHOTS}, m AS (SELECT account_id, count(*) AS messages, count(*) FILTER (id % 4 <> 0) AS wb FROM tx WHERE origin = 'parsed' AND superseded_by IS NULL AND {S.LOCAL.format('posted_at')} >= DATE '{_SINCE}' GROUP BY 1),
s AS (SELECT account_id, max(as_of) FILTER (source = 'sms') AS ls, max(as_of) FILTER (source = 'manual') AS lm FROM snap GROUP BY 1), r AS (SELECT a.id, coalesce(messages, 0) AS messages, coalesce(wb, 0) AS with_balance, CASE WHEN reconcilable AND messages > 0 THEN wb / messages END AS share, ls, lm FROM acc a LEFT JOIN m ON m.account_id = a.id LEFT JOIN s ON s.account_id = a.id WHERE is_active)
SELECT id AS account_id, messages, with_balance, round(share, 6) AS share, CASE WHEN share IS NULL OR with_balance = 0 THEN 'none' WHEN share < 0.35 OR messages < 5 THEN 'weak' WHEN share < 0.9 THEN 'partial' ELSE 'full' END AS level, strftime(ls, {_ISO}) AS last_reported_at, strftime(lm, {_ISO}) AS last_manual_at FROM r""",
)
def balance_coverage_level(spark, d):
    tx = S.transactions(spark, d).withColumn("reported_balance", F.when(F.col("id") % 4 != 0, F.col("amount")))
    return balances.coverage(S.accounts(spark, d), tx, S.snapshots(spark, d), _SINCE)


_NET = "CASE WHEN is_liability AND balance_semantics = 'available_credit' AND credit_limit IS NOT NULL THEN {0} - credit_limit WHEN is_liability THEN -{0} ELSE {0} END"


@query(
    "net_worth_views",
    f"WITH {BAL} SELECT id AS account_id, ({_NET.format('current_balance')})::DOUBLE AS net, (CASE WHEN is_liability AND balance_semantics = 'available_credit' THEN credit_limit - current_balance WHEN is_liability THEN current_balance END)::DOUBLE AS debt, (CASE WHEN is_liability AND balance_semantics = 'available_credit' THEN current_balance END)::DOUBLE AS available, CASE WHEN is_liability AND balance_semantics = 'available_credit' THEN (credit_limit - current_balance)::DOUBLE / credit_limit::DOUBLE END AS utilisation FROM bal",
)
def net_worth_views(spark, d):
    seen = balances.account_views(current(spark, d))
    return seen.select(F.col("id").alias("account_id"), *(F.col(c).cast("double").alias(c) for c in ("net", "debt", "available")), "utilisation")


@query("net_worth_by_institution", f"WITH {BAL}, n AS (SELECT institution, {_NET.format('current_balance')} AS net FROM bal) SELECT institution, count(*) AS accounts, coalesce(sum(net) FILTER (net > 0), 0)::DOUBLE AS assets, coalesce(-sum(net) FILTER (net < 0), 0)::DOUBLE AS debt, sum(net)::DOUBLE AS net FROM n GROUP BY 1")
def net_worth_by_institution(spark, d):
    return balances.by_institution(balances.account_views(current(spark, d)))


@query("net_worth_total", f"WITH {BAL} SELECT coalesce(sum({_NET.format('current_balance')}), 0)::DOUBLE AS net_worth, count(*) AS accounts FROM bal WHERE is_active")
def net_worth_total(spark, d):
    active = current(spark, d).where("is_active")
    return active.agg(F.coalesce(F.sum(balances.net_value(F.col("current_balance"))), F.lit(0)).cast("double").alias("net_worth"), F.count("*").alias("accounts"))


@query(
    "net_worth_series_locf",
    f"""WITH {S.TX}, {S.ACCOUNTS}, {S.SNAPSHOTS}, dl AS (SELECT account_id, {S.LOCAL.format('as_of')} AS day, balance FROM snap QUALIFY row_number() OVER (PARTITION BY account_id, {S.LOCAL.format('as_of')} ORDER BY as_of DESC, id DESC) = 1),
days AS (SELECT unnest(range(DATE '1997-05-25', DATE '1997-08-25', INTERVAL 1 DAY))::DATE AS day), g AS (SELECT acc.*, days.day FROM acc, days),
b AS (SELECT g.day, g.is_liability, g.balance_semantics, g.credit_limit, coalesce(dl.balance, g.opening_balance) AS balance FROM g ASOF LEFT JOIN dl ON dl.account_id = g.id AND dl.day <= g.day)
SELECT day::VARCHAR AS day, sum({_NET.format('balance')})::DOUBLE AS value FROM b GROUP BY 1""",
)
def net_worth_series_locf(spark, d):
    return balances.net_worth_series(S.accounts(spark, d), S.snapshots(spark, d), dt.date(1997, 5, 25), dt.date(1997, 8, 24))


@query(
    "snapshot_daily_last",
    f"WITH {S.TX}, {S.ACCOUNTS}, {S.SNAPSHOTS}, x AS (SELECT account_id, {S.LOCAL.format('as_of')} AS day, balance, as_of, id FROM snap), i AS (SELECT account_id, day, balance FROM x WHERE day BETWEEN DATE '1997-07-25' AND DATE '1997-08-24' QUALIFY row_number() OVER (PARTITION BY account_id, day ORDER BY as_of DESC, id DESC) = 1), s AS (SELECT account_id, day, balance FROM x WHERE day < DATE '1997-07-25' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY as_of DESC, id DESC) = 1) SELECT account_id, day::VARCHAR AS day, balance::DOUBLE AS balance FROM (SELECT * FROM i UNION ALL SELECT * FROM s)",
)
def snapshot_daily_last(spark, d):
    """The last snapshot of each account and day of a window, and the one that the window starts from."""
    from tally.functions import periods

    rows = S.snapshots(spark, d).withColumn("day", periods.local_date("as_of")).where(F.col("day") <= F.lit(dt.date(1997, 8, 24)))
    slot = F.when(F.col("day") >= F.lit(dt.date(1997, 7, 25)), F.col("day"))
    last = rows.groupBy("account_id", slot.alias("slot")).agg(F.max_by(F.struct("day", "balance"), F.struct("as_of", "id")).alias("s"))
    return last.select("account_id", F.col("s.day").cast("string").alias("day"), F.col("s.balance").cast("double").alias("balance"))


_SIGNED = "CASE WHEN direction = 'credit' THEN amount ELSE -amount END"


@query("cycle_movements", f"WITH {S.VIEW} SELECT cycle_start::VARCHAR AS cycle, account_id, coalesce(sum({_SIGNED}) FILTER (state = 'posted'), 0)::DOUBLE AS posted, coalesce(sum({_SIGNED}) FILTER (state = 'posted' AND excluded), 0)::DOUBLE AS excluded_posted, coalesce(sum({_SIGNED}) FILTER (state IN ('pending', 'reversed') AND NOT excluded), 0)::DOUBLE AS unposted FROM v WHERE cycle_start = DATE '{CYCLE}' GROUP BY cycle_start, account_id")
def cycle_movements(spark, d):
    rows = balances.movements(canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)))
    return rows.select(F.col("cycle_start").cast("string").alias("cycle"), "account_id", *(F.col(c).cast("double").alias(c) for c in ("posted", "excluded_posted", "unposted")))


@query(
    "master_invariant",
    f"""WITH {S.VIEW}, {S.ACCOUNTS}, m AS (SELECT v.*, CASE WHEN is_liability AND NOT (balance_semantics = 'available_credit' AND credit_limit IS NOT NULL) THEN -1 ELSE 1 END AS sg FROM v JOIN acc ON acc.id = v.account_id),
w AS (SELECT cycle_start, coalesce(sum(sg * {_SIGNED}) FILTER (state = 'posted'), 0) AS observed, coalesce(sum(sg * {_SIGNED}) FILTER (state = 'posted' AND excluded), 0) AS adjustments, coalesce(sum(sg * {_SIGNED}) FILTER (state IN ('pending', 'reversed') AND NOT excluded), 0) AS unposted,
 coalesce(sum(amount) FILTER (({EARNED}) OR ({PASSIVE})), 0) AS income, coalesce(sum(amount) FILTER ({EXPENSE}), 0) AS expense FROM m GROUP BY 1)
SELECT cycle_start::VARCHAR AS cycle, observed::DOUBLE AS observed, (income - expense)::DOUBLE AS expected, income::DOUBLE AS income, expense::DOUBLE AS expense, adjustments::DOUBLE AS adjustments, unposted::DOUBLE AS unposted, (observed - (income - expense) - adjustments + unposted)::DOUBLE AS unexplained, abs(observed - (income - expense) - adjustments + unposted) <= 0.01 AS ok FROM w""",
)
def master_invariant(spark, d):
    return balances.master_invariant(canonical(spark, d), S.accounts(spark, d))


@query("account_flow_per_cycle", f"WITH {S.VIEW} SELECT cycle_start::VARCHAR AS cycle, account_id, coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DOUBLE AS money_in, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DOUBLE AS money_out FROM v WHERE state = 'posted' GROUP BY cycle_start, account_id")
def account_flow_per_cycle(spark, d):
    rows = canonical(spark, d).where("state = 'posted'")
    return rows.groupBy(F.col("cycle_start").cast("string").alias("cycle"), "account_id").agg(P.total(F.col("direction") == "credit").alias("money_in"), P.total(F.col("direction") == "debit").alias("money_out"))


@query("opening_before_window", f"WITH {S.TX}, {S.ACCOUNTS} SELECT a.id AS account_id, (a.opening_balance + coalesce(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END), 0))::DOUBLE AS opening FROM acc a LEFT JOIN tx ON tx.account_id = a.id AND state = 'posted' AND superseded_by IS NULL AND {S.LOCAL.format('posted_at')} < DATE '{CYCLE}' GROUP BY a.id, a.opening_balance")
def opening_before_window(spark, d):
    from tally.functions import periods

    before = S.transactions(spark, d).where(periods.local_date("posted_at") < F.lit(CYCLE))
    return balances.derived(S.accounts(spark, d), before).select(F.col("id").alias("account_id"), F.col("current_balance").cast("double").alias("opening"))


@query("expenses_per_cycle", f"WITH {S.VIEW} SELECT cycle_start::VARCHAR AS cycle, {total(EXPENSE)} AS expense FROM v WHERE {EXPENSE} GROUP BY cycle_start")
def expenses_per_cycle(spark, d):
    return canonical(spark, d).where(P.is_expense()).groupBy(metrics.text("cycle_start").alias("cycle")).agg(F.sum("amount").cast("double").alias("expense"))


@query("run_rate_contributions", f"WITH {S.VIEW} SELECT account_id, sum({_SIGNED})::DOUBLE AS net, round(sum({_SIGNED})::DOUBLE / 3, 4) AS run_rate FROM v WHERE is_internal AND state <> 'declined' AND cycle_start BETWEEN DATE '1997-04-25' AND DATE '1997-06-25' GROUP BY account_id")
def run_rate_contributions(spark, d):
    """Net contribution of each account over the three closed cycles before this one; the divisor is three, always."""
    rows = canonical(spark, d).where(F.col("is_internal") & (F.col("state") != "declined") & F.col("cycle_start").between(F.lit(dt.date(1997, 4, 25)), F.lit(dt.date(1997, 6, 25))))
    net = F.sum(P.signed_amount()).cast("double")
    return rows.groupBy("account_id").agg(net.alias("net"), F.round(net / 3, 4).alias("run_rate"))
