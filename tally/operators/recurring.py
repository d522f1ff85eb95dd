"""Series of payments that recur: cadence, confidence, price changes and what is due next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods

# Which types can recur as what, and the gaps in days that count as a cadence.
KINDS = {"purchase": "subscription", "bill_payment": "bill", "fee": "bill", "income": "salary", "profit": "profit"}
CADENCES = [("weekly", 7.0, 2.0), ("biweekly", 14.0, 3.0), ("monthly", 30.44, 5.0), ("quarterly", 91.31, 12.0), ("yearly", 365.25, 30.0)]
MIN_OCCURRENCES = 3


def occurrences(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Posted, owned, not superseded legs of a type that can recur, with the key that names their series."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("type"))
    rows = tx.where((F.col("state") == "posted") & F.col("superseded_by").isNull() & ~F.col("is_internal") & ~F.col("excluded") & F.col("type").isin(*KINDS))
    rows = rows.join(merchants.select(F.col("id").alias("merchant_id"), "display_name"), "merchant_id", "left")
    by_account = F.when(F.col("type").isin("income", "profit"), F.concat_ws(":", "type", F.col("account_id").cast("string")))
    key = F.coalesce(F.lower("display_name"), F.lower("biller"), F.lower("merchant_raw"), by_account)
    return rows.where(key.isNotNull()).select(F.concat_ws("|", kind, key, F.coalesce(F.col("account_id").cast("string"), F.lit(""))).alias("detect_key"), kind.alias("kind"), F.col("id").alias("transaction_id"), periods.local_date("posted_at").alias("day"), "amount")


def cadence(gap: Column, value: int) -> Column:
    """Name (0) or ideal days (1) of the first cadence within whose tolerance the gap is."""
    out = None
    for spec in CADENCES:
        hit = F.abs(gap - spec[1]) <= spec[2]
        out = F.when(hit, F.lit(spec[value])) if out is None else out.when(hit, F.lit(spec[value]))
    return out


def next_after(day: Column, name: Column) -> Column:
    return F.when(name == "weekly", F.date_add(day, 7)).when(name == "biweekly", F.date_add(day, 14)).when(name == "monthly", F.add_months(day, 1)).when(name == "quarterly", F.add_months(day, 3)).when(name == "yearly", F.add_months(day, 12))


def _clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def series(found: DataFrame) -> DataFrame:
    """One row for each series with a cadence. Charges of one day are one; deviations are means about medians.

    A price change is where the run of amounts near the latest one begins: the last day whose amount is farther from
    the latest than the tolerance ends the old price.
    """
    days = found.groupBy("detect_key", "kind", "day").agg(F.sum("amount").cast("double").alias("amount"))
    ordered, whole = Window.partitionBy("detect_key").orderBy("day"), Window.partitionBy("detect_key")
    rows = days.withColumns({"gap": F.datediff("day", F.lag("day").over(ordered)), "n": F.count("*").over(whole), "latest": F.max_by("amount", "day").over(whole)})
    rows = rows.where(F.col("n") >= MIN_OCCURRENCES)
    rows = rows.withColumns({"median_gap": F.median("gap").over(whole), "median_amount": F.median("amount").over(whole)})
    far = F.abs(F.col("amount") - F.col("latest")) > F.greatest(F.lit(0.5), F.abs("latest") * 0.01)
    rows = rows.withColumn("old_until", F.max(F.when(far, F.col("day"))).over(whole))
    old = F.col("day") <= F.col("old_until")
    agg = rows.groupBy("detect_key", "kind").agg(
        F.first("n").alias("n"), F.first("median_gap").alias("median_gap"), F.first("median_amount").alias("median_amount"), F.first("latest").alias("amount_last"),
        F.avg(F.abs(F.col("gap") - F.col("median_gap"))).alias("gap_deviation"), F.avg(F.abs(F.col("amount") - F.col("median_amount"))).alias("amount_deviation"), F.avg("amount").alias("amount_avg"),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.median(F.when(old, F.col("amount"))).alias("price_from"), F.median(F.when(~F.coalesce(old, F.lit(False)), F.col("amount"))).alias("price_to"), F.min(F.when(~F.coalesce(old, F.lit(False)), F.col("day"))).alias("price_day"),
    )
    agg = agg.withColumns({"cadence": cadence(F.col("median_gap"), 0), "ideal": cadence(F.col("median_gap"), 1)}).where("cadence IS NOT NULL")
    profit = F.col("kind") == "profit"
    regularity = _clamped(1 - F.col("gap_deviation") / F.col("ideal"))
    stability = F.when(profit | (F.col("median_amount") <= 0), 1.0).otherwise(_clamped(1 - F.col("amount_deviation") / F.nullif(F.col("median_amount"), F.lit(0.0))))
    volume = F.least(F.lit(1.0), 0.5 + (F.col("n") - MIN_OCCURRENCES) / 8)
    confidence = F.when(profit, volume * regularity).otherwise(volume * (0.65 * regularity + 0.35 * stability))
    delta = F.col("price_to") - F.col("price_from")
    changed = ~profit & (F.col("price_from") > 0) & (F.abs(delta) >= 1) & (F.abs(delta / F.nullif(F.col("price_from"), F.lit(0.0))) >= 0.05)
    return agg.select(
        "detect_key", "kind", "cadence", F.floor(F.col("median_gap") + 0.5).cast("long").alias("interval_days"), F.col("n").alias("occurrences"), "amount_avg", "amount_last", F.when(changed, F.col("price_from")).alias("amount_prev"), F.when(changed, F.col("price_day")).alias("price_change_at"),
        "first_seen", "last_seen", next_after(F.col("last_seen"), F.col("cadence")).alias("next_expected_at"), _clamped(confidence).alias("confidence"),
    )


def panel(found: DataFrame, today) -> DataFrame:
    """In which part of the panel a series stands, and how far away its next charge is."""
    dormant = F.datediff(F.lit(today), F.col("last_seen")) > F.col("interval_days") * 3
    away = F.datediff(F.col("next_expected_at"), F.lit(today))
    return found.withColumns({"part": F.when(dormant, "dormant").when(F.col("confidence") >= 0.4, "trusted").otherwise("possible"), "days_away": away.cast("long"), "upcoming": ~dormant & (F.col("confidence") >= 0.4) & away.between(0, 42), "price_alert": F.col("price_change_at").isNotNull() & (F.datediff(F.lit(today), F.col("price_change_at")) <= 365), "expected_amount": F.when(F.col("kind") != "profit", F.coalesce("amount_last", "amount_avg"))})


def merged(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert by detect_key: what detection measures is overwritten, what a person decided stays, keys set aside are skipped."""
    measured = [c for c in found.columns if c != "detect_key"]
    both = stored.alias("s").join(found.alias("f"), F.col("s.detect_key") == F.col("f.detect_key"), "full")
    use_new = F.col("f.detect_key").isNotNull() & ~F.coalesce(F.col("s.excluded_from_detection"), F.lit(False))
    pick = lambda c: F.when(use_new, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    status = F.coalesce("s.status", F.lit("active")).alias("status")
    return both.select(F.coalesce("s.detect_key", "f.detect_key").alias("detect_key"), *map(pick, measured), status, F.col("s.confirmed_at"), F.col("s.dismissed_at"), F.coalesce("s.excluded_from_detection", F.lit(False)).alias("excluded_from_detection"))
