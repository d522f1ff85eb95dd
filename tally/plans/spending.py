"""Queries on periods, the canonical relation and totals over it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods
from tally.operators import metrics, view
from tally.plans.registry import query
from tally.sources import tables as S

CYCLE, WEEK = dt.date(1997, 7, 25), dt.date(1997, 8, 3)
EXPENSE = "direction = 'debit' AND NOT is_internal AND NOT excluded AND type NOT IN ('card_payment', 'loan_payment') AND state <> 'declined'"
FLOW = "NOT is_internal AND NOT excluded AND type NOT IN ('card_payment', 'loan_payment') AND state <> 'declined'"
EARNED = "direction = 'credit' AND NOT is_internal AND NOT excluded AND type = 'income'"
PASSIVE = "direction = 'credit' AND NOT is_internal AND NOT excluded AND type = 'profit'"
MONTH_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def canonical(spark, d):
    return view.categorized_amounts(S.transactions(spark, d), S.splits(spark, d))


def total(predicate: str) -> str:
    return f"coalesce(sum(amount) FILTER ({predicate}), 0)::DOUBLE"


_END = f"({S.cycle_sql('ld')} + INTERVAL 1 MONTH)::DATE - 1"


@query(
    "period_bucket_columns",
    f"""WITH {S.TX}, l AS (SELECT id, cycle_override, {S.LOCAL.format('posted_at')} AS ld FROM tx)
SELECT id, ld::VARCHAR AS local_day, {S.cycle_sql('ld')}::VARCHAR AS cycle_start, ({_END})::VARCHAR AS cycle_end, {MONTH_NAMES}[month({_END})] || ' ' || year({_END}) AS label,
  {S.week_sql('ld')}::VARCHAR AS week_start, coalesce(cycle_override, {S.cycle_sql('ld')})::VARCHAR AS effective_cycle, extract(dow FROM ld)::BIGINT AS dow, date_diff('day', {S.cycle_sql('ld')}, {_END}) + 1 AS cycle_days, day(ld) || ' ' || {MONTH_NAMES}[month(ld)][1:3] AS short_label FROM l""",
)
def period_bucket_columns(spark, d):
    rows = S.transactions(spark, d).select("id", "cycle_override", periods.local_date("posted_at").alias("ld"), "posted_at")
    start = periods.period_start("ld")
    t = lambda c: c.cast("string")
    return rows.select("id", t(F.col("ld")).alias("local_day"), t(start).alias("cycle_start"), t(periods.period_end("ld")).alias("cycle_end"), periods.period_label("ld").alias("label"), t(periods.week_start("ld")).alias("week_start"), t(periods.effective_cycle("posted_at", "cycle_override")).alias("effective_cycle"), periods.day_of_week("ld").cast("long").alias("dow"), periods.days_in_cycle(start).cast("long").alias("cycle_days"), periods.short_label("ld").alias("short_label"))


@query(
    "period_invariants",
    f"""WITH s AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), b AS (SELECT d, {S.cycle_sql('d')} AS c FROM s),
g AS (SELECT c, (c + INTERVAL 1 MONTH)::DATE - 1 AS e, count(*) AS seen FROM b GROUP BY 1, 2)
SELECT c::VARCHAR AS cycle_start, e::VARCHAR AS cycle_end, date_diff('day', c, e) + 1 AS days, seen, coalesce(lag(e) OVER (ORDER BY c) + 1 = c, true) AS contiguous FROM g""",
)
def period_invariants(spark, d):
    """Every day with an order lies in one cycle, and the cycles follow each other without a gap."""
    days = S.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    cycles = days.groupBy(periods.period_start("d").alias("c")).agg(F.count("*").alias("seen")).withColumn("e", periods.period_end("c"))
    before = F.lag("e").over(Window.orderBy("c"))
    return cycles.select(F.col("c").cast("string").alias("cycle_start"), F.col("e").cast("string").alias("cycle_end"), periods.days_in_cycle("c").cast("long").alias("days"), "seen", F.coalesce(F.date_add(before, 1) == F.col("c"), F.lit(True)).alias("contiguous"))


@query(
    "week_buckets_in_cycle",
    f"""WITH {S.TX}, c AS (SELECT DISTINCT {S.cycle_sql(S.LOCAL.format('posted_at'))} AS c FROM tx), e AS (SELECT c, (c + INTERVAL 1 MONTH)::DATE - 1 AS e FROM c),
w AS (SELECT c, e, unnest(range({S.week_sql('c')}, e + 1, INTERVAL 7 DAY))::DATE AS w FROM e)
SELECT c::VARCHAR AS cycle, w::VARCHAR AS week, greatest(w, c)::VARCHAR AS first_day, least(w + 6, e)::VARCHAR AS last_day, date_diff('day', greatest(w, c), least(w + 6, e)) + 1 AS days, w < c OR w + 6 > e AS partial FROM w""",
)
def week_buckets_in_cycle(spark, d):
    """The weeks that touch each cycle, clipped to it."""
    cycles = S.transactions(spark, d).select(periods.period_start(periods.local_date("posted_at")).alias("c")).distinct().withColumn("e", periods.period_end("c"))
    weeks = cycles.withColumn("w", F.explode(F.sequence(periods.week_start("c"), F.col("e"), F.expr("interval 7 days"))))
    first, last = F.greatest("w", "c"), F.least(F.date_add("w", 6), F.col("e"))
    return weeks.select(F.col("c").cast("string").alias("cycle"), F.col("w").cast("string").alias("week"), first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), (F.datediff(last, first) + 1).cast("long").alias("days"), ((F.col("w") < F.col("c")) | (F.date_add("w", 6) > F.col("e"))).alias("partial"))


@query("categorized_view", f"WITH {S.VIEW} SELECT transaction_id, split_n, category_id, amount::DOUBLE AS amount, is_split, direction, type, state, cycle_start::VARCHAR AS cycle_start, week_start::VARCHAR AS week_start, local_day::VARCHAR AS local_day FROM v")
def categorized_view(spark, d):
    t = lambda c: F.col(c).cast("string").alias(c)
    return canonical(spark, d).select("transaction_id", "split_n", "category_id", F.col("amount").cast("double"), "is_split", "direction", "type", "state", t("cycle_start"), t("week_start"), t("local_day"))


@query(
    "split_integrity_violations",
    f"WITH {S.TX}, bad AS (SELECT transaction_id, n, CASE WHEN transaction_id % 70 = 3 AND n = 2 THEN amount + 0.01 ELSE amount END AS amount FROM splits), g AS (SELECT transaction_id, sum(amount) AS s, count(*) AS n FROM bad GROUP BY 1) SELECT g.transaction_id, tx.amount::DOUBLE AS amount, g.s::DOUBLE AS split_total, g.n FROM g JOIN tx ON tx.id = g.transaction_id WHERE g.s <> tx.amount",
)
def split_integrity_violations(spark, d):
    """Splits of which some were made wrong by a cent, so that there is something to find."""
    wrong = F.when((F.col("transaction_id") % 70 == 3) & (F.col("n") == 2), F.col("amount") + F.lit("0.01").cast("decimal(14,2)")).otherwise(F.col("amount"))
    found = view.split_violations(S.transactions(spark, d), S.splits(spark, d).withColumn("amount", wrong))
    return found.select("transaction_id", F.col("amount").cast("double"), F.col("split_total").cast("double"), "n")


def _totals_sql(column: str, start: dt.date) -> str:
    return f"WITH {S.VIEW} SELECT {total(EXPENSE)} AS expense, {total(EARNED)} AS earned, {total(PASSIVE)} AS passive, {total('category_id IS NULL AND ' + EXPENSE)} AS uncategorized, count(*) FILTER (category_id IS NULL AND {EXPENSE}) AS uncategorized_rows, count(DISTINCT transaction_id) AS transactions FROM v WHERE {column} = DATE '{start}'"


@query("period_totals_cycle", _totals_sql("cycle_start", CYCLE))
def period_totals_cycle(spark, d):
    return metrics.period_totals(canonical(spark, d), "cycle", CYCLE)


@query("period_totals_week", _totals_sql("week_start", WEEK))
def period_totals_week(spark, d):
    return metrics.period_totals(canonical(spark, d), "week", WEEK)


def _flow_sql(column: str) -> str:
    return f"WITH {S.VIEW} SELECT {column}::VARCHAR AS bucket, {total(EARNED)} AS earned, {total(PASSIVE)} AS passive, {total(EXPENSE)} AS expense FROM v GROUP BY {column}"


@query("flow_by_cycle", _flow_sql("cycle_start"))
def flow_by_cycle(spark, d):
    return metrics.flow_by_bucket(canonical(spark, d), "cycle")


@query("flow_by_week", _flow_sql("week_start"))
def flow_by_week(spark, d):
    return metrics.flow_by_bucket(canonical(spark, d), "week")


_FIRST, _LAST = periods.shifted(CYCLE, -5), CYCLE
_SPEND = f"SELECT cycle_start::VARCHAR AS bucket, category_id, sum(amount)::DOUBLE AS total FROM v WHERE {EXPENSE} AND cycle_start BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}' GROUP BY cycle_start, category_id"


@query("spend_by_cycle_category", f"WITH {S.VIEW} {_SPEND}")
def spend_by_cycle_category(spark, d):
    return metrics.spend_by_category(canonical(spark, d), "cycle", _FIRST, _LAST)


@query(
    "category_trend_top",
    f"WITH {S.VIEW}, s AS ({_SPEND}), r AS (SELECT category_id, row_number() OVER (ORDER BY sum(total) DESC, category_id NULLS LAST) AS rank FROM s GROUP BY 1) SELECT bucket, CASE WHEN rank <= 5 THEN coalesce(s.category_id::VARCHAR, 'Uncategorized') ELSE 'Other' END AS category, round(sum(total), 2) AS total FROM s JOIN r ON s.category_id IS NOT DISTINCT FROM r.category_id GROUP BY 1, 2",
)
def category_trend_top(spark, d):
    return metrics.top_categories(metrics.spend_by_category(canonical(spark, d), "cycle", _FIRST, _LAST))


_COLUMNS = [*range(25), None]


@query("category_trend_pivot", f"WITH {S.VIEW} SELECT cycle_start::VARCHAR AS bucket, " + ", ".join(f"round(coalesce(sum(amount) FILTER (category_id {'IS NULL' if k is None else f'= {k}'}), 0)::DOUBLE, 2) AS {'uncategorized' if k is None else f'c{k}'}" for k in _COLUMNS) + f" FROM v WHERE {EXPENSE} AND cycle_start BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}' GROUP BY cycle_start")
def category_trend_pivot(spark, d):
    """A column for each category there is, and one for what has none."""
    spent = metrics.spend_by_category(canonical(spark, d), "cycle", _FIRST, _LAST)
    wide = spent.groupBy("bucket").pivot("category_id", _COLUMNS).agg(F.round(F.sum("total"), 2))
    name = lambda k: "uncategorized" if k is None else f"c{k}"
    return wide.select("bucket", *(F.coalesce(F.col("null" if k is None else str(k)), F.lit(0.0)).alias(name(k)) for k in _COLUMNS))


@query(
    "daily_spend_heatmap",
    f"WITH {S.VIEW}, d AS (SELECT local_day, sum(amount)::DOUBLE AS total, count(DISTINCT transaction_id) AS n FROM v WHERE {EXPENSE} AND local_day BETWEEN DATE '1997-02-25' AND DATE '1997-08-24' GROUP BY 1) SELECT local_day::VARCHAR AS day, total, n, CASE WHEN total <= 0 THEN 0 ELSE least(4, floor(total / (SELECT max(total) FROM d) * 4)::BIGINT + 1) END::BIGINT AS step FROM d",
)
def daily_spend_heatmap(spark, d):
    return metrics.daily_spend(canonical(spark, d), dt.date(1997, 2, 25), dt.date(1997, 8, 24))


_NAMED = f"SELECT v.transaction_id, v.amount, v.local_day, coalesce(m.display_name, t.merchant_raw, t.biller, t.type) AS name FROM v JOIN tx t ON t.id = v.transaction_id LEFT JOIN mer m ON m.id = v.merchant_id WHERE cycle_start = DATE '{CYCLE}' AND " + EXPENSE.replace("direction", "v.direction").replace("is_internal", "v.is_internal").replace("excluded", "v.excluded").replace("AND type", "AND v.type").replace("state", "v.state")


@query("merchant_leaderboard", f"WITH {S.VIEW}, {S.MERCHANTS} SELECT name, sum(amount)::DOUBLE AS total, count(DISTINCT transaction_id) AS n FROM ({_NAMED}) GROUP BY name ORDER BY sum(amount) DESC, name LIMIT 8")
def merchant_leaderboard(spark, d):
    return metrics.merchant_ranking(canonical(spark, d), S.transactions(spark, d), S.merchants(spark, d), "cycle", CYCLE)


@query("biggest_expense", f"WITH {S.VIEW}, {S.MERCHANTS} SELECT name AS label, sum(amount)::DOUBLE AS total, min(local_day)::VARCHAR AS day FROM ({_NAMED}) GROUP BY transaction_id, name ORDER BY sum(amount) DESC, transaction_id LIMIT 1")
def biggest_expense(spark, d):
    return metrics.biggest_expense(canonical(spark, d), S.transactions(spark, d), S.merchants(spark, d), "cycle", CYCLE)


@query(
    "income_sources",
    f"""WITH {S.VIEW}, {S.MERCHANTS}, {S.ACCOUNTS}, i AS (SELECT *, CASE WHEN {PASSIVE} THEN 'passive' ELSE 'earned' END AS income_class FROM v WHERE cycle_start = DATE '{CYCLE}' AND (({EARNED}) OR ({PASSIVE})))
SELECT coalesce(m.display_name, t.merchant_raw, t.biller, CASE WHEN income_class = 'earned' THEN 'Salary' ELSE a.name END) AS source, income_class, sum(i.amount)::DOUBLE AS total FROM i JOIN tx t ON t.id = i.transaction_id JOIN acc a ON a.id = i.account_id LEFT JOIN mer m ON m.id = i.merchant_id GROUP BY 1, 2""",
)
def income_sources(spark, d):
    return metrics.income_sources(canonical(spark, d), S.transactions(spark, d), S.accounts(spark, d), S.merchants(spark, d), CYCLE)


_WEEKS_FROM = WEEK - dt.timedelta(days=49)


@query("weekday_profile", f"WITH {S.VIEW}, s AS (SELECT extract(dow FROM local_day)::BIGINT AS dow, sum(amount)::DOUBLE AS total FROM v WHERE {EXPENSE} AND local_day BETWEEN DATE '{_WEEKS_FROM}' AND DATE '{WEEK}' + 6 GROUP BY 1) SELECT r.dow, coalesce(total, 0)::DOUBLE AS total, coalesce(total, 0)::DOUBLE / 8 AS average FROM range(7) r(dow) LEFT JOIN s USING (dow)")
def weekday_profile(spark, d):
    return metrics.weekday_profile(canonical(spark, d), _WEEKS_FROM)


_ROLL_FROM = WEEK - dt.timedelta(days=7 * 19)


@query(
    "rolling_four_bucket_mean",
    f"WITH {S.VIEW}, s AS (SELECT week_start, sum(amount)::DOUBLE AS total FROM v WHERE {EXPENSE} GROUP BY 1), b AS (SELECT unnest(range(DATE '{_ROLL_FROM}', DATE '{WEEK}' + 1, INTERVAL 7 DAY))::DATE AS week_start) SELECT week_start::VARCHAR AS bucket, coalesce(total, 0)::DOUBLE AS total, round(avg(coalesce(total, 0)) OVER (ORDER BY week_start ROWS 3 PRECEDING), 4) AS rolling FROM b LEFT JOIN s USING (week_start)",
)
def rolling_four_bucket_mean(spark, d):
    return metrics.rolling_mean(canonical(spark, d), "week", _ROLL_FROM, 20)


@query(
    "week_over_week",
    f"""WITH {S.VIEW}, s AS (SELECT category_id, coalesce(sum(amount) FILTER (week_start = DATE '{WEEK}'), 0)::DOUBLE AS current, coalesce(sum(amount) FILTER (week_start = DATE '{WEEK}' - 7), 0)::DOUBLE AS previous, coalesce(sum(amount) FILTER (week_start < DATE '{WEEK}'), 0)::DOUBLE / 4 AS a FROM v WHERE {EXPENSE} AND week_start BETWEEN DATE '{WEEK}' - 28 AND DATE '{WEEK}' GROUP BY 1)
SELECT category_id, current, previous, a AS four_week_average, round(current - previous, 2) AS delta FROM s WHERE current > 0 OR previous > 0 ORDER BY abs(round(current - previous, 2)) DESC, category_id NULLS LAST LIMIT 6""",
)
def week_over_week(spark, d):
    return metrics.week_over_week(canonical(spark, d), WEEK)


@query(
    "week_category_in_cycle",
    f"WITH {S.VIEW} SELECT week_start::VARCHAR AS week, category_id, sum(amount)::DOUBLE AS total FROM v WHERE {EXPENSE} AND cycle_start = DATE '{CYCLE}' GROUP BY week_start, category_id",
)
def week_category_in_cycle(spark, d):
    from tally.operators import predicates as P

    return canonical(spark, d).where(P.is_expense() & (F.col("cycle_start") == F.lit(CYCLE))).groupBy(F.col("week_start").cast("string").alias("week"), "category_id").agg(F.sum("amount").cast("double").alias("total"))


_SAVED = "SELECT v.cycle_start, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END)::DOUBLE AS net FROM v JOIN acc a ON a.id = v.account_id WHERE a.is_profit_bearing AND v.is_internal AND v.state <> 'declined' GROUP BY 1"


@query("net_to_savings", f"WITH {S.VIEW}, {S.ACCOUNTS} SELECT cycle_start::VARCHAR AS cycle, net FROM ({_SAVED})")
def net_to_savings(spark, d):
    return metrics.net_to_savings(canonical(spark, d), S.accounts(spark, d))


@query(
    "cycle_flow_rates",
    f"""WITH {S.VIEW}, {S.ACCOUNTS}, f AS (SELECT cycle_start, {total(EARNED)} AS earned, {total(PASSIVE)} AS passive, {total(EXPENSE)} AS expense FROM v GROUP BY 1), n AS ({_SAVED}), b AS (SELECT f.*, coalesce(n.net, 0) AS sv FROM f LEFT JOIN n USING (cycle_start))
SELECT cycle_start::VARCHAR AS bucket, round(earned + passive, 2) AS income, expense, sv::DOUBLE AS to_savings, round(earned + passive - expense - sv, 2) AS retained, round((earned + passive - expense) / nullif(earned + passive, 0), 6) AS savings_rate, round((earned - expense) / nullif(earned, 0), 6) AS earned_savings_rate, round(passive / nullif(expense, 0), 6) AS passive_coverage FROM b""",
)
def cycle_flow_rates(spark, d):
    seen = canonical(spark, d)
    return metrics.retained(metrics.flow_by_bucket(seen, "cycle"), metrics.net_to_savings(seen, S.accounts(spark, d)))
