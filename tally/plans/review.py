"""Queries on the review: health, alerts, replay, forms, and the scans of a user's screens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import text
from tally.operators import budgets, recurring
from tally.operators import review as V
from tally.operators import savings as savings_
from tally.plans.accounts import BAL, current
from tally.plans.messages import _NOW, _QUEUE, _queued
from tally.plans.planning import _DAYS, _ELAPSED, _GOALS, _OCC, _SPENT, goals
from tally.plans.registry import query
from tally.plans.spending import CYCLE, canonical
from tally.sources import sinks
from tally.sources import tables as S

_AT = "2024-01-31 00:00:00"
_HEALTH = f"{_QUEUE}, h AS (SELECT id, received_at, CASE WHEN id % 11 = 0 THEN 'needs_review' WHEN id % 13 = 0 THEN 'ignored' ELSE status END AS status, CASE id % 6 WHEN 0 THEN 'llm' WHEN 1 THEN 'manual' WHEN 2 THEN NULL ELSE 'template' END AS method FROM q)"


def _messages(spark, d):
    k = F.col("id")
    rows = _queued(spark, d)
    return rows.withColumns({"status": F.when(k % 11 == 0, "needs_review").when(k % 13 == 0, "ignored").otherwise(F.col("status")), "method": F.when(k % 6 == 0, "llm").when(k % 6 == 1, "manual").when(k % 6 > 2, "template")})


@query(
    "parser_health",
    f"""WITH {_HEALTH}, a AS (SELECT count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status IN ('pending', 'processing')) AS queued,
 count(*) FILTER (status = 'parsed' AND method = 'template') AS template, count(*) FILTER (status = 'parsed' AND method = 'llm') AS llm, count(*) FILTER (status = 'parsed' AND method = 'manual') AS manual, count(*) FILTER (status = 'parsed' AND method IS NULL) AS unattributed, count(*) FILTER (method = 'llm' AND received_at >= TIMESTAMP '2024-01-15 00:00:00') AS llm_calls, max(received_at) AS lr, min(received_at) FILTER (status IN ('pending', 'processing')) AS oq FROM h)
SELECT * EXCLUDE (lr, oq), strftime(lr, '%Y-%m-%d %H:%M:%S') AS last_received, strftime(oq, '%Y-%m-%d %H:%M:%S') AS oldest_queued, round(parsed / nullif(parsed + needs_review + failed, 0), 6) AS parse_rate, round(template / nullif(template + llm + manual + unattributed, 0), 6) AS template_hit_rate, coalesce(date_diff('second', lr, {_NOW}) > 86400, false) AS stale, coalesce(date_diff('second', oq, {_NOW}) > 900, false) AS stalled FROM a""",
)
def parser_health(spark, d):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    found = V.health(_messages(spark, d), ts(_AT), ts("2024-01-15 00:00:00"))
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.withColumns({"last_received": clock("last_received"), "oldest_queued": clock("oldest_queued")})


@query("backup_states", f"WITH b AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN TIMESTAMP '{_AT}' - to_hours(event_id % 1500) END AS ex FROM events), s AS (SELECT id, ex, date_diff('second', ex, TIMESTAMP '{_AT}') // 86400 AS days FROM b) SELECT id, days, ex IS NULL AS never, ex IS NULL OR days >= 30 AS due FROM s")
def backup_states(spark, d):
    """Whether a dump of the raw messages is due, by when the last one was taken."""
    last = F.when(F.col("event_id") % 10 != 0, F.lit(_AT).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("event_id") % 1500).cast("int")))
    state = V.backup_state(last, F.lit(_AT).cast("timestamp_ntz"))
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), *(c.alias(n) for n, c in state.items()))


_SEV = "['info', 'critical', 'warning'][id % 3 + 1]"


@query(
    "alert_ranking",
    f"WITH a AS (SELECT n_nationkey AS id, {_SEV.replace('id', 'n_nationkey')} AS severity, TIMESTAMP '{_AT}' - to_hours(n_nationkey * 7 % 10) AS created_at, 1 AS source FROM nation UNION ALL SELECT r_regionkey + 100, {_SEV.replace('id', 'r_regionkey')}, NULL, 0 FROM region) SELECT id::VARCHAR AS id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, source, created_at DESC, id::VARCHAR)::INTEGER AS place FROM a",
)
def alert_ranking(spark, d):
    """Stored alerts of the nations and derived ones of the regions, in the order a screen shows them."""
    severity = lambda k: F.get(F.array(*map(F.lit, ("info", "critical", "warning"))), (F.col(k) % 3).cast("int"))
    stored = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), severity("n_nationkey").alias("severity"), (F.lit(_AT).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("n_nationkey") * 7 % 10).cast("int"))).alias("created_at"))
    derived = S.table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), severity("r_regionkey").alias("severity"))
    listed = V.ranked_alerts(stored, derived).agg(F.collect_list("id").alias("ids"))
    return listed.select(F.posexplode("ids").alias("at", "id")).select("id", (F.col("at") + 1).alias("place"))


@query("open_drift_alerts", f"WITH {BAL} SELECT id, id % 3 <> 0 AS open FROM bal ORDER BY (id % 3 <> 0) DESC, DATE '1997-01-01' + (id * 13 % 97)::INTEGER DESC, id LIMIT 12")
def open_drift_alerts(spark, d):
    """The twelve that a screen lists: open ones first."""
    k = F.col("id")
    rows = current(spark, d).select("id", F.when(k % 3 == 0, F.lit(_AT)).alias("resolved_at"), F.date_add(F.lit(dt.date(1997, 1, 1)), (k * 13 % 97).cast("int")).alias("detected_at"))
    return V.open_first(rows, 12).select("id", F.col("resolved_at").isNull().alias("open"))


_TODAY = dt.date(1997, 8, 11)
_PACE = f"SELECT b.category_id, (b.amount + b.carry_in)::DOUBLE AS budget, coalesce(s.spent, 0)::DOUBLE AS spent, coalesce(s.spent, 0)::DOUBLE / {float(_ELAPSED)}::DOUBLE * {float(_DAYS)}::DOUBLE AS projected FROM bud b LEFT JOIN (SELECT * FROM ({_SPENT}) WHERE cycle_start = DATE '{CYCLE}') s USING (category_id) WHERE b.cycle_start = DATE '{CYCLE}'"


@query(
    "generated_alerts",
    f"""WITH {S.VIEW}, {S.BUDGETS}, pc AS ({_PACE}), p AS (SELECT DISTINCT account_id, {S.LOCAL.format('posted_at')} AS day FROM tx WHERE type = 'profit' AND superseded_by IS NULL), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY account_id ORDER BY day), day) AS gap FROM p), m AS (SELECT account_id, count(*) AS n, max(day) AS last_at, floor(median(gap) + 0.5)::INTEGER AS cadence FROM g GROUP BY 1),
l AS (SELECT *, date_diff('day', last_at + cadence, DATE '1999-06-01') AS od FROM m WHERE n >= 2)
SELECT CASE WHEN spent > budget THEN 'budget_overspend' ELSE 'budget_projected_overspend' END AS type, category_id::VARCHAR AS key, round(CASE WHEN spent > budget THEN spent ELSE projected END - budget, 4) AS amount FROM pc WHERE spent > budget OR projected > budget
UNION ALL SELECT 'missed_profit', account_id::VARCHAR, (od - 5)::DOUBLE FROM l WHERE od > 5
UNION ALL SELECT 'card_due', o_orderkey::VARCHAR, date_diff('day', DATE '{_TODAY}', o_orderdate::DATE + 20)::DOUBLE FROM orders WHERE o_orderkey % 4 <> 0 AND date_diff('day', DATE '{_TODAY}', o_orderdate::DATE + 20) BETWEEN 0 AND 3""",
)
def generated_alerts(spark, d):
    """What the day's figures raise: budgets over or on the way, profits that didn't come, cards due."""
    from tally.functions import periods

    spent = budgets.spend(canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE))).select("category_id", "spent")
    base = S.budgets(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).select("category_id", (F.col("amount") + F.col("carry_in")).cast("double").alias("budget"))
    rows = base.join(spent, "category_id", "left").select("category_id", "budget", F.coalesce("spent", F.lit(0)).cast("double").alias("spent"))
    paces = rows.withColumn("projected", budgets.pace(F.col("budget"), F.col("spent"), F.lit(_ELAPSED), F.lit(_DAYS))["projected"])
    profits = S.transactions(spark, d).where("type = 'profit' AND superseded_by IS NULL").select("account_id", periods.local_date("posted_at").alias("day"))
    statements = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("paid_at"), F.date_add(F.to_date("o_orderdate"), 20).alias("due"))
    found = V.budget_alerts(paces).unionByName(V.payout_alerts(savings_.payout_status(profits, dt.date(1999, 6, 1)), "missed_profit")).unionByName(V.card_alerts(statements, _TODAY))
    return found.select("type", "key", F.round("amount", 4).alias("amount"))


@query(
    "replayable_messages",
    f"WITH {S.TX}, m AS (SELECT DISTINCT id // 2 AS id FROM tx), t AS (SELECT *, id // 2 AS raw FROM tx) SELECT m.id FROM m WHERE m.id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.raw = m.id AND origin = 'manual') AND EXISTS (SELECT 1 FROM t WHERE t.raw = m.id AND t.account_id = 1)",
)
def replayable_messages(spark, d):
    """The parsed messages of one account that a replay may touch."""
    tx = S.transactions(spark, d).withColumn("raw_message_id", F.floor(F.col("id") / 2))
    messages = tx.select(F.col("raw_message_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 7 == 0, "ignored").otherwise("parsed"))
    return V.replayable(messages, tx, account=1).select("id")


@query(
    "loans_of_accounts",
    "WITH l AS (SELECT s_suppkey AS loan_id, CASE WHEN s_suppkey % 2 = 0 THEN 'customer#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') ELSE 'SLUG-' || (s_suppkey * 3) END AS name FROM supplier) SELECT c_custkey AS account_id, loan_id FROM customer JOIN l ON lower(l.name) IN (lower(c_name), 'slug-' || c_custkey) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY (lower(l.name) = 'slug-' || c_custkey) DESC, loan_id) = 1",
)
def loans_of_accounts(spark, d):
    """Loans are found by an account's slug or its name, however they are spelled; a lookup by key, not a cross join."""
    k = F.col("s_suppkey")
    loans = S.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("customer#"), F.lpad((k * 3).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("SLUG-"), (k * 3).cast("string"))).alias("name"))
    accounts = S.accounts(spark, d).withColumn("slug", F.concat(F.lit("slug-"), F.col("id").cast("string")))
    return V.loans_of_accounts(loans, accounts)


_SHAPED = "s AS (SELECT event_id AS id, substr(sha256(event_type || ' #'), 1, 16) AS new, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE substr(sha256(event_type || ' #'), 1, 16) END AS old FROM events)"


def _shaped(spark, d):
    """A word and a number each; a quarter of the messages still have an old shape."""
    body = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    shape = F.when(F.col("event_id") % 4 == 0, "old").otherwise(F.substring(F.sha2(F.concat("event_type", F.lit(" #")), 256), 1, 16))
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), body.alias("body"), shape.alias("shape"))


@query("rehashed_shapes", f"WITH {_SHAPED} SELECT id, old, new FROM s WHERE old <> new")
def rehashed_shapes(spark, d):
    return V.rehashed(_shaped(spark, d))


@query("shape_counts", f"WITH {_SHAPED} SELECT count(DISTINCT old) AS before, count(DISTINCT new) AS after FROM s")
def shape_counts(spark, d):
    rows = _shaped(spark, d).select("shape", text.shape_hash(text.normalized(F.col("body"))).alias("new"))
    return rows.agg(F.count_distinct("shape").alias("before"), F.count_distinct("new").alias("after"))


@query("stale_forms", f"WITH {_SHAPED} SELECT n_name AS name FROM nation WHERE CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'gone ' || n_nationkey END NOT IN (SELECT old FROM s)")
def stale_forms(spark, d):
    k = F.col("n_nationkey")
    forms = S.table(spark, d, "nation").select("n_name", F.when(k % 2 == 0, "old").otherwise(F.concat(F.lit("gone "), k.cast("string"))).alias("shape"))
    return V.stale_forms(forms, _shaped(spark, d)).select(F.col("n_name").alias("name"))


@query("saved_forms", "WITH f AS (SELECT n_nationkey AS id, 'shape ' || (n_nationkey % 7) AS shape, n_nationkey * 5 % 11 AS created_at FROM nation) SELECT shape, id FROM f QUALIFY row_number() OVER (PARTITION BY shape ORDER BY created_at DESC, id DESC) = 1")
def saved_forms(spark, d):
    """One form a shape, the newest, of those stored and those that come."""
    k = F.col("n_nationkey")
    rows = S.table(spark, d, "nation").select(k.alias("id"), F.concat(F.lit("shape "), (k % 7).cast("string")).alias("shape"), (k * 5 % 11).alias("created_at"))
    return V.saved_forms(rows.where("id < 12"), rows.where("id >= 12")).select("shape", "id")


@query("parked_scan", f"WITH {_HEALTH} SELECT id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at, status FROM h WHERE status IN ('needs_review', 'failed') ORDER BY h.received_at DESC, id LIMIT 500")
def parked_scan(spark, d):
    """The 500 newest messages that wait for a review: the limit is the feature."""
    rows = _messages(spark, d).where("status IN ('needs_review', 'failed')").orderBy(F.col("received_at").desc(), "id").limit(500)
    return rows.select("id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "status")


@query("recent_payouts", f"WITH {S.TX}, p AS (SELECT DISTINCT account_id, {S.LOCAL.format('posted_at')} AS day FROM tx WHERE type = 'profit' AND direction = 'credit' AND state = 'posted' AND superseded_by IS NULL AND NOT is_internal) SELECT account_id, day::VARCHAR AS day FROM p QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY day DESC) <= 24")
def recent_payouts(spark, d):
    """The last 24 different days on which each account was paid a profit."""
    from pyspark.sql.window import Window
    from tally.functions import periods

    days = S.transactions(spark, d).where("type = 'profit' AND direction = 'credit' AND state = 'posted' AND superseded_by IS NULL AND NOT is_internal").select("account_id", periods.local_date("posted_at").alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("day").desc()))
    return days.withColumn("rank", rank).where("rank <= 24").select("account_id", F.col("day").cast("string"))


@query("week_digest", f"WITH {S.VIEW}, e AS (SELECT category_id, amount FROM v WHERE week_start = DATE '1997-08-03' AND direction = 'debit' AND state IN ('posted', 'pending') AND NOT is_internal AND NOT excluded AND type <> 'adjustment') SELECT coalesce(category_id::VARCHAR, 'Uncategorized') AS category, sum(amount)::DOUBLE AS total FROM e GROUP BY 1 ORDER BY total DESC, category LIMIT 3")
def week_digest(spark, d):
    """The three largest categories of a week."""
    rows = canonical(spark, d).where("week_start = DATE '1997-08-03' AND direction = 'debit' AND state IN ('posted', 'pending') AND NOT is_internal AND NOT excluded AND type <> 'adjustment'")
    spent = rows.groupBy(F.coalesce(F.col("category_id").cast("string"), F.lit("Uncategorized")).alias("category")).agg(F.sum("amount").alias("total"))
    return spent.orderBy(F.col("total").desc(), "category").limit(3).withColumn("total", F.col("total").cast("double"))


@query("series_merchants", f"WITH {_OCC}, k AS (SELECT DISTINCT detect_key FROM occ) SELECT detect_key, split_part(detect_key, '|', 2) AS merchant, m.id AS merchant_id FROM k LEFT JOIN (SELECT lower(display_name) AS name, min(id) AS id FROM mer WHERE display_name IS NOT NULL GROUP BY 1) m ON m.name = split_part(detect_key, '|', 2)")
def series_merchants(spark, d):
    """The merchant that the middle part of a series' key names, and its id where it is a known one."""
    keys = recurring.occurrences(S.transactions(spark, d), S.merchants(spark, d)).select("detect_key").distinct().withColumn("merchant", F.split_part("detect_key", F.lit("|"), F.lit(2)))
    known = S.merchants(spark, d).where("display_name IS NOT NULL").groupBy(F.lower("display_name").alias("merchant")).agg(F.min("id").alias("merchant_id"))
    return keys.join(known, "merchant", "left")


@query("budget_history", f"WITH {S.BUDGETS.strip()} SELECT category_id, cycle_start::VARCHAR AS cycle_start, amount::DOUBLE AS amount, rollover, carry_in::DOUBLE AS carry_in, carry_closed_at IS NOT NULL AS closed, (date_diff('month', cycle_start, DATE '{CYCLE}') + 1)::INTEGER AS place FROM bud WHERE cycle_start BETWEEN (DATE '{CYCLE}' - INTERVAL 5 MONTH)::DATE AND DATE '{CYCLE}'")
def budget_history(spark, d):
    """What each category was given and carried in the six cycles up to one: six is the screen's own limit."""
    rows = budgets.history(S.budgets(spark, d), CYCLE)
    return rows.select("category_id", F.col("cycle_start").cast("string"), F.col("amount").cast("double"), "rollover", F.col("carry_in").cast("double"), F.col("carry_closed_at").isNotNull().alias("closed"), "place")


@query("goals_with_accounts", f"WITH {S.ACCOUNTS}, {_GOALS} SELECT goal_id, a.name AS account, target_amount::DOUBLE AS target, target_date::VARCHAR AS target_date FROM goals LEFT JOIN acc a ON a.id = goals.account_id")
def goals_with_accounts(spark, d):
    names = S.accounts(spark, d).select(F.col("id").alias("account_id"), F.col("name").alias("account"))
    return goals(spark, d).join(names, "account_id", "left").select("goal_id", "account", F.col("target_amount").cast("double").alias("target"), F.col("target_date").cast("string"))


@query("account_errors", "WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN 'available_credit' WHEN 1 THEN 'other' ELSE 'balance' END AS sem, c_custkey % 2 = 0 AS liab, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS lim, c_custkey % 33 AS sd, CASE WHEN c_custkey % 3 = 0 THEN 28 END AS dd FROM customer) SELECT id, CASE WHEN trim(name) = '' THEN 'name' WHEN sem = 'other' THEN 'semantics' WHEN sem = 'available_credit' AND NOT liab THEN 'semantics' WHEN sem = 'available_credit' AND NOT coalesce(lim > 0, false) THEN 'limit' WHEN sd NOT BETWEEN 1 AND 28 OR (dd IS NOT NULL AND dd NOT BETWEEN 1 AND 28) THEN 'day' END AS error FROM a")
def account_errors(spark, d):
    k = F.col("c_custkey")
    semantics = F.when(k % 5 == 0, "available_credit").when(k % 5 == 1, "other").otherwise("balance")
    drafts = S.table(spark, d, "customer").select(k.alias("id"), F.when(k % 9 == 0, " ").otherwise(F.col("c_name")).alias("name"), semantics.alias("balance_semantics"), (k % 2 == 0).alias("is_liability"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("credit_limit"), (k % 33).alias("statement_day"), F.when(k % 3 == 0, 28).alias("due_day"))
    return V.account_errors(drafts).select("id", "error")


@query("csv_guarded", "SELECT doc_id, CASE WHEN regexp_matches(g, '[\",\\r\\n]') THEN '\"' || replace(g, '\"', '\"\"') || '\"' ELSE g END AS field FROM (SELECT doc_id, CASE WHEN left(x, 1) IN ('=', '+', '@') THEN '''' || x ELSE x END AS g FROM (SELECT doc_id, ['=', '+', '@', ''][doc_id % 4 + 1] || coalesce(source, '') || CASE WHEN doc_id % 3 = 0 THEN ', \"q\"' ELSE '' END AS x FROM documents))")
def csv_guarded(spark, d):
    """A field as it stands in a file that spreadsheets open: no formula, quoted where it must be."""
    k = F.col("doc_id")
    value = F.concat(F.get(F.array(*map(F.lit, ("=", "+", "@", ""))), (k % 4).cast("int")), F.coalesce("source", F.lit("")), F.when(k % 3 == 0, ', "q"').otherwise(""))
    return S.table(spark, d, "documents").select("doc_id", sinks.csv_field(value).alias("field"))


@query("settings_with_defaults", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'Asia/Dubai' END, 'Asia/Riyadh') AS timezone, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 1 END, 25)::INTEGER AS anchor_day FROM nation")
def settings_with_defaults(spark, d):
    k = F.col("n_nationkey")
    rows = S.table(spark, d, "nation").select(k.alias("id"), F.when(k % 3 == 0, "Asia/Dubai").alias("timezone"), F.when(k % 2 == 0, 1).alias("anchor_day"))
    return sinks.with_defaults(rows)


@query("export_reminders", "WITH s AS (SELECT event_id AS id, event_id % 3 = 0 AS due, event_id % 2 = 0 AS open FROM events) SELECT id, CASE WHEN due AND NOT open THEN 'raise' WHEN NOT due AND open THEN 'clear' ELSE 'none' END AS step FROM s")
def export_reminders(spark, d):
    k = F.col("event_id")
    return V.reminder_steps(S.table(spark, d, "events").select(k.alias("id"), (k % 3 == 0).alias("due"), (k % 2 == 0).alias("open")))


@query(
    "pace_ranking",
    f"""WITH {S.VIEW}, {S.BUDGETS}, s AS (SELECT * FROM ({_SPENT}) WHERE cycle_start = DATE '{CYCLE}'), b AS (SELECT coalesce(b.category_id, s.category_id) AS category_id, coalesce(s.spent, 0)::DOUBLE AS spent, coalesce(s.spent, 0)::DOUBLE / nullif((b.amount + b.carry_in)::DOUBLE, 0) AS share FROM (SELECT * FROM bud WHERE cycle_start = DATE '{CYCLE}') b FULL JOIN s ON s.category_id = b.category_id)
SELECT category_id, round(share, 9) AS share FROM b ORDER BY b.share DESC NULLS LAST, CASE WHEN b.share IS NULL THEN spent END DESC NULLS LAST, category_id LIMIT 5""",
)
def pace_ranking(spark, d):
    """The five categories that a phone shows: the limit is the feature."""
    spent = budgets.spend(canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE))).select("category_id", "spent")
    base = S.budgets(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).select("category_id", (F.col("amount") + F.col("carry_in")).cast("double").alias("budget"))
    rows = base.join(spent, "category_id", "full").withColumn("spent", F.coalesce("spent", F.lit(0)).cast("double"))
    rows = rows.withColumn("share", F.col("spent") / F.nullif(F.col("budget"), F.lit(0.0)))
    return rows.orderBy(*V.pace_order()).limit(5).select("category_id", F.round("share", 9).alias("share"))


@query("series_calendar", "WITH s AS (SELECT n_name AS detect_key, CASE WHEN n_nationkey % 4 <> 0 THEN DATE '1997-08-01' + (n_nationkey * 7 % 20)::INTEGER END AS next_expected_at, (n_nationkey % 3) / 2.0::DOUBLE AS confidence FROM nation) SELECT detect_key, row_number() OVER (ORDER BY next_expected_at NULLS LAST, confidence DESC, detect_key)::INTEGER AS place FROM s")
def series_calendar(spark, d):
    k = F.col("n_nationkey")
    rows = S.table(spark, d, "nation").select(F.col("n_name").alias("detect_key"), F.when(k % 4 != 0, F.date_add(F.lit(dt.date(1997, 8, 1)), (k * 7 % 20).cast("int"))).alias("next_expected_at"), (k % 3 / F.lit(2.0)).alias("confidence"))
    return rows.select("detect_key", F.row_number().over(Window.orderBy(*V.calendar_order())).alias("place"))


@query(
    "day_labels",
    f"WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d FROM orders), s AS (SELECT id, d, day(d) || ' ' || strftime(d, '%b') || CASE WHEN year(d) = 1997 THEN '' ELSE ' ' || year(d) END AS short FROM d) SELECT id, short, CASE date_diff('day', d, DATE '{_TODAY}') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(d, '%a') || ' ' || short END AS label FROM s",
)
def day_labels(spark, d):
    """How days are called, seen from one of them."""
    from tally.functions import periods

    rows = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    return rows.select("id", periods.civil_short("d", F.lit(_TODAY)).alias("short"), periods.day_label("d", F.lit(_TODAY)).alias("label"))


@query(
    "account_edit_effects",
    f"WITH {S.ACCOUNTS}, e AS (SELECT id, opening_balance AS cur, CASE WHEN id % 3 = 0 THEN opening_balance + 10 ELSE opening_balance END AS st FROM acc) SELECT id AS account_id, CASE WHEN st <> cur THEN st END::DOUBLE AS snapshot, id % 5 = 0 OR st <> cur AS closed, CASE WHEN st <> cur AND id % 5 <> 0 THEN 'balance stated by hand' END AS note FROM e",
)
def account_edit_effects(spark, d):
    """Stating a balance by hand leaves a snapshot and closes the account's open drift alert."""
    from tally.operators import rules as R

    k = F.col("id")
    rows = S.accounts(spark, d)
    edited = rows.select("id", F.col("opening_balance").alias("current_balance"), F.when(k % 3 == 0, F.col("opening_balance") + 10).otherwise(F.col("opening_balance")).alias("stated_balance"))
    alerts = rows.select(k.alias("account_id"), F.when(k % 5 == 0, F.lit(_AT)).alias("resolved_at"), F.lit(None).cast("string").alias("note"))
    stated = R.edit_snapshots(edited, _AT).select("account_id", F.col("balance").cast("double").alias("snapshot"))
    return R.closed_by_edit(alerts, edited).join(stated, "account_id", "left").select("account_id", "snapshot", "closed", "note")


@query("account_statements", f"WITH {S.TX}, {S.ACCOUNTS}, m AS (SELECT account_id, count(*) AS legs, count(*) FILTER (len(locked_fields) > 0) AS edited, max(posted_at) AS newest FROM tx WHERE state = 'posted' AND superseded_by IS NULL GROUP BY 1) SELECT a.id AS account_id, a.name, coalesce(legs, 0) AS legs, coalesce(edited, 0) AS edited, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest FROM acc a LEFT JOIN m ON m.account_id = a.id WHERE is_active")
def account_statements(spark, d):
    """What an account's page scans: its posted legs, those edited by hand, and its newest."""
    legs = S.transactions(spark, d).where("state = 'posted' AND superseded_by IS NULL").groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("legs"), F.count_if(F.size("locked_fields") > 0).alias("edited"), F.date_format(F.max("posted_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))
    rows = S.accounts(spark, d).where("is_active").join(legs, "id", "left")
    return rows.select(F.col("id").alias("account_id"), "name", F.coalesce("legs", F.lit(0)).alias("legs"), F.coalesce("edited", F.lit(0)).alias("edited"), "newest")


@query("refreshed_alerts", f"WITH {BAL} SELECT id AS account_id, current_balance::DOUBLE AS computed, (CASE WHEN id % 2 = 0 THEN -3.5 ELSE 0 END)::DOUBLE AS delta, id % 2 <> 0 AS closed, CASE WHEN id % 2 <> 0 THEN 'balance agrees after an edit by hand' END AS note FROM bal WHERE id % 3 <> 0")
def refreshed_alerts(spark, d):
    """Open drift alerts after edits: those that agree by now close by themselves."""
    from tally.operators import balances

    k = F.col("id")
    rows = current(spark, d)
    reported = (F.col("current_balance") + F.when(k % 2 == 0, F.lit("3.50")).otherwise(F.lit("0")).cast("decimal(14,2)")).cast("decimal(14,2)")
    alerts = rows.select(k.alias("account_id"), reported.alias("reported"), F.when(k % 3 == 0, F.lit(_AT)).alias("resolved_at"))
    found = balances.refreshed_alerts(alerts, rows)
    return found.withColumns({"computed": F.col("computed").cast("double"), "delta": F.col("delta").cast("double")})
