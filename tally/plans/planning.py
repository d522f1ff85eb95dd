"""Queries on budgets, goals and recurring series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import budgets, recurring
from tally.operators import predicates as P
from tally.plans.accounts import BAL, current
from tally.plans.registry import query
from tally.plans.spending import CYCLE, EXPENSE, WEEK, canonical
from tally.sources import tables as S

TODAY = dt.date(1997, 8, 11)
_ELAPSED, _DAYS = (TODAY - CYCLE).days + 1, 31
_SPENT = f"SELECT cycle_start, category_id, sum(amount) AS spent FROM v WHERE {EXPENSE} AND category_id IS NOT NULL GROUP BY 1, 2"


def _pace_sql(budget: str, spent: str, elapsed: float, days: float, week_days: float = 7) -> str:
    share, es, wl = f"CASE WHEN {budget} IS NULL THEN NULL WHEN {budget} > 0 THEN {spent} / {budget} WHEN {spent} > 0 THEN 'inf'::DOUBLE ELSE 0 END", f"({elapsed}::DOUBLE / {days})", f"(({days} - {elapsed})::DOUBLE / 7)"
    return f"""({share}) AS spent_share, {es} AS elapsed_share, CASE WHEN {budget} IS NULL THEN NULL WHEN {spent} > {budget} OR ({share}) > {es} + 0.05 THEN 'Over' WHEN ({share}) < {es} - 0.05 THEN 'Ahead' ELSE 'On pace' END AS verdict,
  {wl} AS weeks_left, CASE WHEN {wl} >= 0.5 THEN ({budget} - {spent}) / {wl} END AS remaining_pace, {budget} * {week_days} / {days}::DOUBLE AS fair_share, {spent} / {elapsed}::DOUBLE * {days}::DOUBLE AS projected"""


@query(
    "budget_pace",
    f"""WITH {S.VIEW}, {S.BUDGETS}, s AS ({_SPENT}), b AS (SELECT coalesce(b.category_id, s.category_id) AS category_id, (b.amount + b.carry_in)::DOUBLE AS budget, coalesce(s.spent, 0)::DOUBLE AS spent FROM (SELECT * FROM bud WHERE cycle_start = DATE '{CYCLE}') b FULL JOIN (SELECT * FROM s WHERE cycle_start = DATE '{CYCLE}') s ON s.category_id = b.category_id)
SELECT category_id, budget, spent, {_pace_sql('budget', 'spent', _ELAPSED, _DAYS)} FROM b""",
)
def budget_pace(spark, d):
    """Budgeted and spent categories of the cycle with their pace on one day of it."""
    spent = budgets.spend(canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE))).select("category_id", "spent")
    base = S.budgets(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).select("category_id", (F.col("amount") + F.col("carry_in")).cast("double").alias("budget"))
    rows = base.join(spent, "category_id", "full").select("category_id", "budget", F.coalesce("spent", F.lit(0)).cast("double").alias("spent"))
    return rows.select("category_id", "budget", "spent", *(c.alias(n) for n, c in budgets.pace(F.col("budget"), F.col("spent"), F.lit(_ELAPSED), F.lit(_DAYS)).items()))


@query(
    "plan_headline",
    f"WITH {S.VIEW}, {S.BUDGETS}, s AS (SELECT * FROM ({_SPENT}) WHERE cycle_start = DATE '{CYCLE}') SELECT sum(b.amount + b.carry_in)::DOUBLE AS budget, sum(coalesce(s.spent, 0))::DOUBLE AS spent, count(*) AS categories FROM bud b LEFT JOIN s USING (category_id) WHERE b.cycle_start = DATE '{CYCLE}'",
)
def plan_headline(spark, d):
    """Only what is budgeted counts here: its budgets with their carries, and the spend against them."""
    spent = budgets.spend(canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE))).select("category_id", "spent")
    rows = S.budgets(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).join(spent, "category_id", "left")
    return rows.agg(F.sum(F.col("amount") + F.col("carry_in")).cast("double").alias("budget"), F.sum(F.coalesce("spent", F.lit(0))).cast("double").alias("spent"), F.count("*").alias("categories"))


@query(
    "budget_week_rows",
    f"""WITH {S.VIEW}, {S.BUDGETS}, s AS (SELECT category_id, sum(amount) AS spent FROM v WHERE {EXPENSE} AND cycle_start = DATE '{CYCLE}' AND week_start = DATE '{WEEK}' GROUP BY 1), b AS (SELECT category_id, (amount + carry_in)::DOUBLE * 7 / 31::DOUBLE AS fair FROM bud WHERE cycle_start = DATE '{CYCLE}')
SELECT b.category_id, fair AS fair_share, coalesce(spent, 0)::DOUBLE AS spent, coalesce(spent, 0)::DOUBLE > fair AS over_fair FROM b LEFT JOIN s USING (category_id)""",
)
def budget_week_rows(spark, d):
    spent = canonical(spark, d).where(P.is_expense() & (F.col("cycle_start") == F.lit(CYCLE)) & (F.col("week_start") == F.lit(WEEK))).groupBy("category_id").agg(F.sum("amount").alias("spent"))
    rows = S.budgets(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).join(spent, "category_id", "left")
    fair, used = (F.col("amount") + F.col("carry_in")).cast("double") * 7 / F.lit(31.0), F.coalesce("spent", F.lit(0)).cast("double")
    return rows.select("category_id", fair.alias("fair_share"), used.alias("spent"), (used > fair).alias("over_fair"))


@query(
    "budget_carry_close",
    f"""WITH {S.VIEW}, {S.BUDGETS}, s AS ({_SPENT}), i AS (SELECT b.category_id, (b.cycle_start + INTERVAL 1 MONTH)::DATE AS cycle_start, b.amount, b.rollover, CASE WHEN b.rollover THEN b.amount + b.carry_in - coalesce(s.spent, 0) ELSE 0 END AS carry FROM bud b LEFT JOIN s ON s.cycle_start = b.cycle_start AND s.category_id = b.category_id WHERE (b.cycle_start + INTERVAL 1 MONTH)::DATE - 1 < DATE '{TODAY}')
SELECT coalesce(b.category_id, i.category_id) AS category_id, coalesce(b.cycle_start, i.cycle_start)::VARCHAR AS cycle_start, coalesce(b.amount, i.amount)::DOUBLE AS amount, coalesce(b.rollover, i.rollover) AS rollover, (CASE WHEN i.carry IS NOT NULL AND b.carry_closed_at IS NULL THEN i.carry ELSE b.carry_in END)::DOUBLE AS carry_in,
 CASE WHEN i.carry IS NOT NULL AND b.carry_closed_at IS NOT NULL THEN 'settled' WHEN i.carry IS NOT NULL AND b.amount IS NULL THEN 'created' WHEN i.carry IS NOT NULL THEN 'carried' ELSE 'kept' END AS action FROM bud b FULL JOIN i ON i.category_id = b.category_id AND i.cycle_start = b.cycle_start""",
)
def budget_carry_close(spark, d):
    rows = budgets.close_cycles(S.budgets(spark, d), canonical(spark, d), TODAY)
    return rows.select("category_id", F.col("cycle_start").cast("string"), F.col("amount").cast("double"), "rollover", F.col("carry_in").cast("double"), "action")


@query("unclosed_cycles", f"WITH {S.BUDGETS}, c AS (SELECT DISTINCT cycle_start FROM bud) SELECT cycle_start::VARCHAR AS cycle_start FROM c WHERE cycle_start < DATE '1997-12-25' AND (cycle_start + INTERVAL 1 MONTH)::DATE NOT IN (SELECT cycle_start FROM bud WHERE carry_closed_at IS NOT NULL AND category_id = 0) ORDER BY 1 LIMIT 6")
def unclosed_cycles(spark, d):
    """Of one category's settlements, so that some cycles are open."""
    rows = S.budgets(spark, d).withColumn("carry_closed_at", F.when(F.col("category_id") == 0, F.col("carry_closed_at")))
    return budgets.unclosed_cycles(rows, dt.date(1998, 1, 10)).select(F.col("cycle_start").cast("string"))


def goals(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    rows = S.table(spark, d, "customer")
    return rows.select(k.alias("goal_id"), F.when(k % 7 != 2, k - k % 7 + 1).alias("account_id"), (1000 + k % 13 * 500).cast("decimal(14,2)").alias("target_amount"), F.when(k % 5 != 0, F.date_add(F.lit(TODAY), ((k % 11) * 40 - 60).cast("int"))).alias("target_date"), ((k % 9) * 400).cast("decimal(14,2)").alias("allocation"))


_GOALS = f"goals AS (SELECT c_custkey AS goal_id, CASE WHEN c_custkey % 7 <> 2 THEN c_custkey - c_custkey % 7 + 1 END AS account_id, CAST(1000 + c_custkey % 13 * 500 AS DECIMAL(14,2)) AS target_amount, CASE WHEN c_custkey % 5 <> 0 THEN DATE '{TODAY}' + (c_custkey % 11 * 40 - 60)::INTEGER END AS target_date, CAST(c_custkey % 9 * 400 AS DECIMAL(14,2)) AS allocation FROM customer)"
_BUCKETS = f"{BAL}, {_GOALS}, g AS (SELECT account_id, sum(allocation) AS allocated FROM goals WHERE account_id IS NOT NULL GROUP BY 1), buckets AS (SELECT g.account_id, coalesce(b.current_balance, 0)::DOUBLE AS balance, g.allocated::DOUBLE AS allocated, (coalesce(b.current_balance, 0) - g.allocated)::DOUBLE AS remainder, CASE WHEN g.allocated <= 0 THEN 1 ELSE least(1, greatest(0, coalesce(b.current_balance, 0)::DOUBLE) / g.allocated::DOUBLE) END::DOUBLE AS coverage, g.allocated > coalesce(b.current_balance, 0) AS over_allocated FROM g LEFT JOIN bal b ON b.id = g.account_id)"


@query("goal_buckets", f"WITH {_BUCKETS} SELECT * FROM buckets")
def goal_buckets(spark, d):
    return budgets.goal_buckets(goals(spark, d), current(spark, d))


@query(
    "goal_views",
    f"""WITH {_BUCKETS}, rr AS (SELECT id AS account_id, opening_balance::DOUBLE / 10 AS run_rate FROM acc), j AS (SELECT q.*, b.allocated, greatest(0, q.allocation::DOUBLE * coalesce(b.coverage, CASE WHEN q.account_id IS NOT NULL THEN 0 ELSE 1 END)) AS funded, rr.run_rate, CASE WHEN target_date IS NULL THEN NULL WHEN target_date < DATE '{TODAY}' THEN 0 ELSE date_diff('month', {S.cycle_sql(f"DATE '{TODAY}'")}, {S.cycle_sql('target_date')}) + 1 END AS cl FROM goals q LEFT JOIN buckets b USING (account_id) LEFT JOIN rr USING (account_id)),
k AS (SELECT *, greatest(0, target_amount::DOUBLE - funded) AS remaining, run_rate * CASE WHEN allocated > 0 THEN allocation::DOUBLE / allocated WHEN account_id IS NOT NULL THEN 0 ELSE 1 END AS rate FROM j), l AS (SELECT *, CASE WHEN cl > 0 THEN remaining / cl WHEN cl = 0 THEN remaining END AS req FROM k)
SELECT goal_id, funded, funded / target_amount::DOUBLE AS progress, remaining, cl AS cycles_left, req AS required_per_cycle, cl = 0 AND remaining > 0 AS overdue, rate AS run_rate, CASE WHEN req IS NULL OR rate IS NULL THEN NULL ELSE remaining = 0 OR rate >= req END AS on_track FROM l""",
)
def goal_views(spark, d):
    rates = S.accounts(spark, d).select(F.col("id").alias("account_id"), (F.col("opening_balance").cast("double") / 10).alias("run_rate"))
    return budgets.goal_views(goals(spark, d), budgets.goal_buckets(goals(spark, d), current(spark, d)), rates, TODAY)


_OCC = f"""{S.TX}, {S.MERCHANTS}, occ0 AS (SELECT tx.*, CASE type WHEN 'purchase' THEN 'subscription' WHEN 'bill_payment' THEN 'bill' WHEN 'fee' THEN 'bill' WHEN 'income' THEN 'salary' WHEN 'profit' THEN 'profit' END AS kind, coalesce(lower(m.display_name), lower(biller), lower(merchant_raw), CASE WHEN type IN ('income', 'profit') THEN type || ':' || account_id END) AS mk FROM tx LEFT JOIN mer m ON m.id = tx.merchant_id WHERE state = 'posted' AND superseded_by IS NULL AND NOT is_internal AND NOT excluded AND type IN ('purchase', 'bill_payment', 'fee', 'income', 'profit')),
occ AS (SELECT kind || '|' || mk || '|' || account_id AS detect_key, kind, id AS transaction_id, {S.LOCAL.format('posted_at')} AS day, amount FROM occ0 WHERE mk IS NOT NULL)"""
# the events give shorter cadences than the orders: one account a user, one merchant a type
_EVENTS = "ev AS (SELECT 'subscription|' || event_type || '|' || user_id AS detect_key, 'subscription' AS kind, event_id AS transaction_id, ts::DATE AS day, CAST(value AS DECIMAL(14,2)) AS amount FROM events)"


def _series_sql(rows: str) -> str:
    names = " ".join(f"WHEN abs(mg - {g}) <= {t} THEN '{n}'" for n, g, t in recurring.CADENCES)
    ideal = " ".join(f"WHEN abs(mg - {g}) <= {t} THEN {g}" for n, g, t in recurring.CADENCES)
    return f"""dy AS (SELECT detect_key, kind, day, sum(amount)::DOUBLE AS amount FROM {rows} GROUP BY ALL),
gp AS (SELECT *, date_diff('day', lag(day) OVER w, day) AS gap, count(*) OVER (PARTITION BY detect_key) AS n, last_value(amount) OVER (PARTITION BY detect_key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM dy WINDOW w AS (PARTITION BY detect_key ORDER BY day)),
md AS (SELECT *, median(gap) OVER p AS mg, median(amount) OVER p AS ma, max(CASE WHEN abs(amount - latest) > greatest(0.5, abs(latest) * 0.01) THEN day END) OVER p AS old_until FROM gp WHERE n >= 3 WINDOW p AS (PARTITION BY detect_key)),
ag AS (SELECT detect_key, kind, first(n) AS n, first(mg) AS mg, first(ma) AS ma, first(latest) AS latest, avg(abs(gap - mg)) AS gd, avg(abs(amount - ma)) AS ad, avg(amount) AS avg_amount, min(day) AS fs, max(day) AS ls,
  median(amount) FILTER (day <= old_until) AS pf, median(amount) FILTER (NOT coalesce(day <= old_until, false)) AS pt, min(day) FILTER (NOT coalesce(day <= old_until, false)) AS pd FROM md GROUP BY detect_key, kind),
cd AS (SELECT *, CASE {names} END AS cadence, CASE {ideal} END::DOUBLE AS ideal FROM ag),
cf AS (SELECT *, least(1, greatest(0, 1 - gd / ideal)) AS reg, CASE WHEN kind = 'profit' OR ma <= 0 THEN 1 ELSE least(1, greatest(0, 1 - ad / ma)) END AS stab, least(1, 0.5::DOUBLE + (n - 3)::DOUBLE / 8) AS vol FROM cd WHERE cadence IS NOT NULL),
se AS (SELECT *, least(1, greatest(0, CASE WHEN kind = 'profit' THEN vol * reg ELSE vol * (0.65::DOUBLE * reg + 0.35::DOUBLE * stab) END)) AS confidence, kind <> 'profit' AND pf > 0 AND abs(pt - pf) >= 1 AND abs((pt - pf) / pf) >= 0.05 AS changed,
  CASE cadence WHEN 'weekly' THEN ls + 7 WHEN 'biweekly' THEN ls + 14 WHEN 'monthly' THEN (ls + INTERVAL 1 MONTH)::DATE WHEN 'quarterly' THEN (ls + INTERVAL 3 MONTH)::DATE ELSE (ls + INTERVAL 12 MONTH)::DATE END AS nx FROM cf)"""


def _found(spark, d) -> DataFrame:
    return recurring.series(recurring.occurrences(S.transactions(spark, d), S.merchants(spark, d)))


def _event_occurrences(spark, d) -> DataFrame:
    rows = S.table(spark, d, "events")
    return rows.select(F.concat_ws("|", F.lit("subscription"), "event_type", F.col("user_id").cast("string")).alias("detect_key"), F.lit("subscription").alias("kind"), F.col("event_id").alias("transaction_id"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(14,2)").alias("amount"))


_COLUMNS = "detect_key, kind, cadence, floor(mg + 0.5)::BIGINT AS interval_days, n AS occurrences, round(avg_amount, 4) AS amount_avg, latest AS amount_last, CASE WHEN changed THEN pf END AS amount_prev, CASE WHEN changed THEN pd END::VARCHAR AS price_change_at, fs::VARCHAR AS first_seen, ls::VARCHAR AS last_seen, nx::VARCHAR AS next_expected_at, round(confidence, 5) AS confidence"


def _shown(found: DataFrame) -> DataFrame:
    t = lambda c: F.col(c).cast("string").alias(c)
    return found.select("detect_key", "kind", "cadence", "interval_days", "occurrences", F.round("amount_avg", 4).alias("amount_avg"), "amount_last", "amount_prev", t("price_change_at"), t("first_seen"), t("last_seen"), t("next_expected_at"), F.round("confidence", 5).alias("confidence"))


@query("recurring_series", f"WITH {_OCC}, {_series_sql('occ')} SELECT {_COLUMNS} FROM se")
def recurring_series(spark, d):
    return _shown(_found(spark, d))


@query("recurring_event_series", f"WITH {_EVENTS}, {_series_sql('ev')} SELECT {_COLUMNS} FROM se")
def recurring_event_series(spark, d):
    return _shown(recurring.series(_event_occurrences(spark, d)))


@query("recurring_price_changes", f"WITH {_OCC}, {_series_sql('occ')} SELECT detect_key, pf AS price_from, pt AS price_to, round(pt - pf, 4) AS delta, pd::VARCHAR AS changed_on FROM (SELECT *, latest FROM se WHERE changed)")
def recurring_price_changes(spark, d):
    """The change is to the median of the amounts at the new price, which is near the latest one."""
    occ = recurring.occurrences(S.transactions(spark, d), S.merchants(spark, d))
    found = recurring.series(occ).where("price_change_at IS NOT NULL")
    days = occ.groupBy("detect_key", "day").agg(F.sum("amount").cast("double").alias("amount"))
    now = days.join(found.select("detect_key", "price_change_at", "amount_prev"), "detect_key").where("day >= price_change_at")
    rows = now.groupBy("detect_key", "amount_prev", "price_change_at").agg(F.median("amount").alias("price_to"))
    return rows.select("detect_key", F.col("amount_prev").alias("price_from"), "price_to", F.round(F.col("price_to") - F.col("amount_prev"), 4).alias("delta"), F.col("price_change_at").cast("string").alias("changed_on"))


_LATER = dt.date(2001, 8, 10)


@query(
    "recurring_upcoming",
    f"WITH {_OCC}, {_series_sql('occ')}, pn AS (SELECT *, date_diff('day', ls, DATE '{_LATER}') > floor(mg + 0.5) * 3 AS dormant, date_diff('day', DATE '{_LATER}', nx) AS away FROM se) SELECT detect_key, CASE WHEN dormant THEN 'dormant' WHEN confidence >= 0.4 THEN 'trusted' ELSE 'possible' END AS part, away AS days_away, NOT dormant AND confidence >= 0.4 AND away BETWEEN 0 AND 42 AS upcoming, changed AND date_diff('day', pd, DATE '{_LATER}') <= 365 AS price_alert, CASE WHEN kind <> 'profit' THEN latest END AS expected_amount FROM pn",
)
def recurring_upcoming(spark, d):
    return recurring.panel(_found(spark, d), _LATER).select("detect_key", "part", "days_away", "upcoming", "price_alert", "expected_amount")


@query("bills_calendar", f"WITH {_OCC}, {_series_sql('occ')} SELECT {S.week_sql('nx')}::VARCHAR AS week, nx < DATE '{_LATER}' AS overdue, count(*) AS bills, round(sum(CASE WHEN kind <> 'profit' THEN latest END), 2) AS total FROM se WHERE nx >= DATE '{_LATER}' - 60 GROUP BY ALL")
def bills_calendar(spark, d):
    """What is expected by week; a week in which every amount varies has no total."""
    rows = recurring.panel(_found(spark, d), _LATER).where(F.col("next_expected_at") >= F.date_sub(F.lit(_LATER), 60))
    return rows.groupBy(periods.week_start("next_expected_at").cast("string").alias("week"), (F.col("next_expected_at") < F.lit(_LATER)).alias("overdue")).agg(F.count("*").alias("bills"), F.round(F.sum("expected_amount"), 2).alias("total"))


@query(
    "recurring_upsert",
    f"WITH {_OCC}, {_series_sql('occ')}, st AS (SELECT detect_key, cadence, latest + 1 AS amount_last, 'dismissed' AS status, n % 2 = 0 AS ex FROM se WHERE n % 3 = 0 UNION ALL SELECT 'bill|gone|0', 'monthly', 5, 'paused', false) SELECT coalesce(st.detect_key, se.detect_key) AS detect_key, CASE WHEN se.detect_key IS NOT NULL AND NOT coalesce(ex, false) THEN se.latest ELSE st.amount_last END AS amount_last, coalesce(st.status, 'active') AS status FROM st FULL JOIN se ON se.detect_key = st.detect_key",
)
def recurring_upsert(spark, d):
    found = _found(spark, d).select("detect_key", "cadence", "amount_last", "occurrences")
    stored = found.where("occurrences % 3 = 0").select("detect_key", "cadence", (F.col("amount_last") + 1).alias("amount_last"), F.lit("dismissed").alias("status"), (F.col("occurrences") % 2 == 0).alias("excluded_from_detection"))
    gone = spark.createDataFrame([("bill|gone|0", "monthly", 5.0, "paused", False)], stored.schema)
    stored = stored.union(gone).withColumns({"confirmed_at": F.lit(None).cast("date"), "dismissed_at": F.lit(None).cast("date")})
    return recurring.merged(stored, found.drop("occurrences")).select("detect_key", "amount_last", "status")
