"""The canonical relation: one row per (transaction, category, amount), with its bucket columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import periods


def with_buckets(tx: DataFrame) -> DataFrame:
    day = periods.local_date("posted_at")
    tx = tx.withColumn("local_day", day)
    return tx.withColumns({"cycle_start": F.coalesce("cycle_override", periods.period_start("local_day")), "week_start": periods.week_start("local_day")})


def categorized_amounts(tx: DataFrame, splits: DataFrame) -> DataFrame:
    """Split transactions by their splits, the others by themselves; superseded legs are in neither.

    One outer join instead of an inner and an anti join: the transactions are read and shuffled once.
    """
    keys = ["account_id", "posted_at", "direction", "type", "state", "merchant_id", "is_internal", "excluded", "cycle_start", "week_start", "local_day"]
    live = with_buckets(tx.where("superseded_by IS NULL"))
    parts = splits.select(F.col("transaction_id").alias("id"), F.col("n").alias("split_n"), F.col("category_id").alias("split_category"), F.col("amount").alias("split_amount"))
    both = live.join(parts, "id", "left")
    split = F.col("split_n").isNotNull()
    return both.select(F.col("id").alias("transaction_id"), "split_n", F.when(split, F.col("split_category")).otherwise(F.col("category_id")).alias("category_id"), F.coalesce("split_amount", "amount").alias("amount"), split.alias("is_split"), *keys)


def split_violations(tx: DataFrame, splits: DataFrame) -> DataFrame:
    """Transactions whose splits don't add up to their amount."""
    sums = splits.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount").alias("split_total"), F.count("*").alias("n"))
    return tx.join(sums, "id").where(F.col("split_total") != F.col("amount")).select(F.col("id").alias("transaction_id"), "amount", "split_total", "n")
