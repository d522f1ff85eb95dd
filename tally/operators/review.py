"""What a review looks at: health of the intake, alerts and their order, replayable messages, stale forms, loans of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import text

#: How an alert ranks, and when things count as late.
SEVERITIES = {"critical": 0, "warning": 1, "info": 2}
STALE_HOURS, STALL_MINUTES, EXPORT_DAYS = 24, 15, 30


def health(messages: DataFrame, now: Column, month_start: Column) -> DataFrame:
    """One row: counts by status and by method, model calls of the month, last arrival, oldest queued, rates and lateness.

    Rates are null where nothing was attempted; ignored messages are in no denominator.
    """
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    by = lambda m: F.count_if((F.col("status") == "parsed") & (F.coalesce("method", F.lit("unattributed")) == m)).alias(m)
    rows = messages.agg(
        of("parsed").alias("parsed"), of("needs_review").alias("needs_review"), of("failed").alias("failed"), of("ignored").alias("ignored"), of("pending", "processing").alias("queued"),
        by("template"), by("llm"), by("manual"), by("unattributed"),
        F.count_if((F.col("method") == "llm") & (F.col("received_at") >= month_start)).alias("llm_calls"),
        F.max("received_at").alias("last_received"), F.min(F.when(F.col("status").isin("pending", "processing"), F.col("received_at"))).alias("oldest_queued"),
    )
    share = lambda part, *whole: F.round(F.col(part) / F.nullif(sum((F.col(c) for c in whole), F.lit(0)), F.lit(0)), 6)
    late = lambda since, unit, n: F.coalesce(F.timestamp_diff(unit, F.col(since), now) > n, F.lit(False))
    return rows.withColumns({"parse_rate": share("parsed", "parsed", "needs_review", "failed"), "template_hit_rate": share("template", "template", "llm", "manual", "unattributed"), "stale": late("last_received", "SECOND", STALE_HOURS * 3600), "stalled": late("oldest_queued", "SECOND", STALL_MINUTES * 60)})


def backup_state(last_export: Column, now: Column) -> dict[str, Column]:
    """Days since the last dump of raw messages, and whether one is due: never dumped, or 30 days ago."""
    days = F.floor(F.timestamp_diff("SECOND", last_export, now) / 86400)
    return {"days": days.cast("long"), "never": last_export.isNull(), "due": last_export.isNull() | (days >= EXPORT_DAYS)}


def reminder_steps(states: DataFrame) -> DataFrame:
    """(id, step) from id, due and open (whether a reminder is open): raise one where a backup is due, clear it where none is."""
    step = F.when(F.col("due") & ~F.col("open"), "raise").when(~F.col("due") & F.col("open"), "clear").otherwise("none")
    return states.select("id", step.alias("step"))


def ranked_alerts(stored: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Open alerts (id, severity, created_at) in the order they are shown: by severity, those derived on the spot first, then the newest."""
    rows = stored.select(F.col("id").cast("string").alias("id"), "severity", "created_at", F.lit(1).alias("source"))
    if derived is not None:
        rows = rows.unionByName(derived.select(F.col("id").cast("string").alias("id"), "severity", F.lit(None).cast(stored.schema["created_at"].dataType).alias("created_at"), F.lit(0).alias("source")))
    rank = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    return rows.orderBy(F.try_element_at(rank, F.col("severity")).asc_nulls_last(), "source", F.col("created_at").desc(), "id")


def open_first(alerts: DataFrame, limit: int) -> DataFrame:
    """Drift alerts, those still open first, then the newest."""
    return alerts.orderBy(F.col("resolved_at").isNull().desc(), F.col("detected_at").desc(), "id").limit(limit)


def replayable(messages: DataFrame, tx: DataFrame, account=None, first=None, last=None) -> DataFrame:
    """Parsed messages none of whose transactions was entered by hand; of an account, or of days of arrival, if asked."""
    rows = messages.where("status = 'parsed'").join(tx.where("origin = 'manual'").select(F.col("raw_message_id").alias("id")), "id", "left_anti")
    if account is not None:
        rows = rows.join(tx.where(F.col("account_id") == account).select(F.col("raw_message_id").alias("id")), "id", "left_semi")
    day = F.to_date("received_at")
    rows = rows if first is None else rows.where(day >= F.lit(first))
    return rows if last is None else rows.where(day <= F.lit(last))


def loans_of_accounts(loans: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, loan_id): the loan that has an account's slug or name, without case; the slug wins, then the smaller id."""
    keys = accounts.select(F.col("id").alias("account_id"), F.explode(F.array(F.struct(F.lit(0).alias("order"), F.lower("slug").alias("key")), F.struct(F.lit(1).alias("order"), F.lower("name").alias("key")))).alias("k")).select("account_id", "k.*")
    met = keys.join(loans.select(F.col("id").alias("loan_id"), F.lower("name").alias("key")), "key")
    return met.groupBy("account_id").agg(F.min(F.struct("order", "loan_id")).alias("best")).select("account_id", "best.loan_id")


def rehashed(messages: DataFrame) -> DataFrame:
    """(id, old, new) of the messages whose stored shape is not what their text hashes to now."""
    now = messages.select("id", F.col("shape").alias("old"), text.shape_hash(text.normalized(F.col("body"))).alias("new"))
    return now.where("NOT (old <=> new)")


def stale_forms(forms: DataFrame, messages: DataFrame) -> DataFrame:
    """Forms whose shape no message has."""
    return forms.join(messages.select("shape").distinct(), "shape", "left_anti")


def saved_forms(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One form a shape (shape, .., created_at): the newest of what is stored and what comes."""
    rank = Window.partitionBy("shape").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return stored.unionByName(new).withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def budget_alerts(paces: DataFrame) -> DataFrame:
    """(type, key, amount) from category, budget, spent and projected: over budget, or on the way to it."""
    over = F.col("spent") > F.col("budget")
    kind = F.when(over, "budget_overspend").when(F.col("projected") > F.col("budget"), "budget_projected_overspend")
    return paces.where("budget IS NOT NULL").select(kind.alias("type"), F.col("category_id").cast("string").alias("key"), (F.when(over, F.col("spent")).otherwise(F.col("projected")) - F.col("budget")).alias("amount")).where("type IS NOT NULL")


def payout_alerts(payouts: DataFrame, kind: str) -> DataFrame:
    """Salaries or profits that are late or missing, with the days."""
    return payouts.where("state IN ('late', 'missing')").select(F.lit(kind).alias("type"), F.col("account_id").cast("string").alias("key"), F.col("days_late").cast("double").alias("amount"))


def card_alerts(statements: DataFrame, today, within: int = 3) -> DataFrame:
    """Unpaid statements that are due within so many days, with the days left."""
    left = F.datediff("due", F.lit(today))
    return statements.where(F.col("paid_at").isNull() & left.between(0, within)).select(F.lit("card_due").alias("type"), F.col("id").cast("string").alias("key"), left.cast("double").alias("amount"))


def pace_order() -> list[Column]:
    """How paced categories are listed: budgeted ones by the share they have used, then the others by what was spent."""
    return [F.col("share").desc_nulls_last(), F.when(F.col("share").isNull(), F.col("spent")).desc(), F.col("category_id")]


def calendar_order() -> list[Column]:
    """How series are listed: the soonest first, those without a next date last, then by confidence."""
    return [F.col("next_expected_at").asc_nulls_last(), F.col("confidence").desc(), F.col("detect_key")]


def rule_of(row: dict) -> dict | None:
    """The draft of a rule that catches transactions like this one: its merchant, else its biller; none if it has neither."""
    for field in ("merchant_raw", "biller"):
        if (row.get(field) or "").strip():
            return {"match": [{"field": field, "operator": "equals", "value": row[field].strip()}], "actions": {"set_category": row.get("category_id")}}
    return None


def account_errors(drafts: DataFrame) -> DataFrame:
    """drafts with the first thing that is wrong with each: days are 1 to 28, limits positive, only cards have available credit."""
    day = lambda c: F.col(c).isNotNull() & ~F.col(c).between(1, 28)
    card = F.col("balance_semantics") == "available_credit"
    error = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name").when(~F.coalesce("balance_semantics", F.lit("")).isin("balance", "available_credit"), "semantics").when(card & ~F.col("is_liability"), "semantics").when(card & ~F.coalesce(F.col("credit_limit") > 0, F.lit(False)), "limit").when(day("statement_day") | day("due_day"), "day")
    return drafts.withColumn("error", error)
