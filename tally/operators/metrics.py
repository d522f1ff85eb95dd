"""Totals, trends and rankings over the canonical relation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods
from tally.operators import predicates as P


def bucket_of(grain: str) -> str:
    return {"cycle": "cycle_start", "week": "week_start"}[grain]


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def period_totals(view: DataFrame, grain: str, start: dt.date) -> DataFrame:
    return view.where(F.col(bucket_of(grain)) == F.lit(start)).agg(
        P.total(P.is_expense()).alias("expense"),
        P.total(P.is_earned()).alias("earned"),
        P.total(P.is_passive()).alias("passive"),
        P.total(P.is_uncategorized()).alias("uncategorized"),
        F.count(F.when(P.is_uncategorized(), 1)).alias("uncategorized_rows"),
        F.countDistinct("transaction_id").alias("transactions"),
    )


def flow_by_bucket(view: DataFrame, grain: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    bucket = bucket_of(grain)
    rows = view if first is None else view.where(F.col(bucket).between(F.lit(first), F.lit(last)))
    return rows.groupBy(text(bucket).alias("bucket")).agg(P.total(P.is_earned()).alias("earned"), P.total(P.is_passive()).alias("passive"), P.total(P.is_expense()).alias("expense"))


def spend_by_category(view: DataFrame, grain: str, first: dt.date, last: dt.date) -> DataFrame:
    bucket = bucket_of(grain)
    return view.where(P.is_expense() & F.col(bucket).between(F.lit(first), F.lit(last))).groupBy(text(bucket).alias("bucket"), "category_id").agg(F.sum("amount").cast("double").alias("total"))


def daily_spend(view: DataFrame, first: dt.date, last: dt.date, steps: int = 4) -> DataFrame:
    """Spend and transactions of each day, and the day's step of heat against the largest day."""
    days = view.where(P.is_expense() & F.col("local_day").between(F.lit(first), F.lit(last))).groupBy("local_day").agg(F.sum("amount").cast("double").alias("total"), F.countDistinct("transaction_id").alias("n"))
    largest = days.agg(F.max("total").alias("largest"))
    heat = F.when(F.col("total") <= 0, 0).otherwise(F.least(F.lit(steps), F.floor(F.col("total") / F.col("largest") * steps) + 1))
    return days.crossJoin(largest).select(text("local_day").alias("day"), "total", "n", heat.cast("long").alias("step"))


def merchant_ranking(view: DataFrame, tx: DataFrame, merchants: DataFrame, grain: str, start: dt.date, top: int = 8) -> DataFrame:
    spent = view.where(P.is_expense() & (F.col(bucket_of(grain)) == F.lit(start))).select("transaction_id", "merchant_id", "amount")
    named = spent.join(tx.select(F.col("id").alias("transaction_id"), "merchant_raw", "biller", "type"), "transaction_id").join(merchants.select(F.col("id").alias("merchant_id"), "display_name"), "merchant_id", "left")
    names = named.groupBy(P.display_name("display_name", "merchant_raw", "biller", "type").alias("name")).agg(F.sum("amount").alias("total"), F.countDistinct("transaction_id").alias("n"))
    return names.orderBy(F.col("total").desc(), "name").limit(top).select("name", F.col("total").cast("double"), "n")


def biggest_expense(view: DataFrame, tx: DataFrame, merchants: DataFrame, grain: str, start: dt.date) -> DataFrame:
    spent = view.where(P.is_expense() & (F.col(bucket_of(grain)) == F.lit(start))).groupBy("transaction_id", "merchant_id").agg(F.sum("amount").alias("total"), F.min("local_day").alias("day"))
    top = spent.orderBy(F.col("total").desc(), "transaction_id").limit(1)
    named = top.join(tx.select(F.col("id").alias("transaction_id"), "merchant_raw", "biller", "type"), "transaction_id").join(merchants.select(F.col("id").alias("merchant_id"), "display_name"), "merchant_id", "left")
    return named.select(P.display_name("display_name", "merchant_raw", "biller", "type").alias("label"), F.col("total").cast("double"), text("day").alias("day"))


def income_sources(view: DataFrame, tx: DataFrame, accounts: DataFrame, merchants: DataFrame, cycle: dt.date) -> DataFrame:
    income = view.where((P.is_earned() | P.is_passive()) & (F.col("cycle_start") == F.lit(cycle))).select("transaction_id", "merchant_id", "account_id", "amount", F.when(P.is_passive(), "passive").otherwise("earned").alias("income_class"))
    named = income.join(tx.select(F.col("id").alias("transaction_id"), "merchant_raw", "biller"), "transaction_id").join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account")), "account_id").join(merchants.select(F.col("id").alias("merchant_id"), "display_name"), "merchant_id", "left")
    label = F.coalesce("display_name", "merchant_raw", "biller", F.when(F.col("income_class") == "earned", F.lit("Salary")).otherwise(F.col("account")))
    return named.groupBy(label.alias("source"), "income_class").agg(F.sum("amount").cast("double").alias("total"))


def weekday_profile(view: DataFrame, first_week: dt.date, weeks: int = 8) -> DataFrame:
    """Spend of each weekday; its average is over the weeks, not over the days with spend. All seven days are there."""
    last = first_week + dt.timedelta(days=7 * weeks - 1)
    spent = view.where(P.is_expense() & F.col("local_day").between(F.lit(first_week), F.lit(last))).groupBy(periods.day_of_week("local_day").alias("dow")).agg(F.sum("amount").alias("total"))
    days = view.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    total = F.coalesce("total", F.lit(0)).cast("double")
    return days.join(spent, "dow", "left").select(F.col("dow").cast("long"), total.alias("total"), (total / weeks).alias("average"))


def net_to_savings(view: DataFrame, accounts: DataFrame) -> DataFrame:
    saving = accounts.where("is_profit_bearing").select(F.col("id").alias("account_id"))
    return view.where(F.col("is_internal") & (F.col("state") != "declined")).join(saving, "account_id", "left_semi").groupBy(text("cycle_start").alias("cycle")).agg(F.sum(P.signed_amount()).cast("double").alias("net"))


def dense_buckets(spark, grain: str, first: dt.date, count: int) -> DataFrame:
    step = "interval 7 days" if grain == "week" else "interval 1 month"
    last = periods.stepped(grain, first, count - 1)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr(step))).alias("bucket"))


def rolling_mean(view: DataFrame, grain: str, first: dt.date, count: int, window: int = 4) -> DataFrame:
    """Spend of each bucket and the mean of the last few; the first ones average over what there is."""
    bucket = bucket_of(grain)
    spent = view.where(P.is_expense()).groupBy(F.col(bucket).alias("bucket")).agg(F.sum("amount").cast("double").alias("total"))
    dense = dense_buckets(view.sparkSession, grain, first, count).join(spent, "bucket", "left").select("bucket", F.coalesce("total", F.lit(0.0)).alias("total"))
    over = Window.orderBy("bucket").rowsBetween(1 - window, 0)
    return dense.select(text("bucket").alias("bucket"), "total", F.round(F.avg("total").over(over), 4).alias("rolling"))


def week_over_week(view: DataFrame, week: dt.date, top: int = 6) -> DataFrame:
    """Categories by how much their spend moved against the week before, with the mean of the four weeks before."""
    back = lambda n: F.lit(week - dt.timedelta(days=7 * n))
    at = lambda n: F.coalesce(F.sum(F.when(F.col("week_start") == back(n), F.col("amount"))), F.lit(0)).cast("double")
    spent = view.where(P.is_expense() & F.col("week_start").between(back(4), back(0)))
    rows = spent.groupBy("category_id").agg(at(0).alias("current"), at(1).alias("previous"), (F.coalesce(F.sum(F.when(F.col("week_start") < back(0), F.col("amount"))), F.lit(0)).cast("double") / 4).alias("four_week_average"))
    rows = rows.where("current > 0 OR previous > 0").withColumn("delta", F.round(F.col("current") - F.col("previous"), 2))
    return rows.orderBy(F.abs("delta").desc(), F.col("category_id").asc_nulls_last()).limit(top).select("category_id", "current", "previous", "four_week_average", "delta")


def top_categories(totals: DataFrame, keep: int = 5) -> DataFrame:
    """Per bucket: the categories that are largest over all buckets by name, the rest as Other."""
    ranks = totals.groupBy("category_id").agg(F.sum("total").alias("all")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("all").desc(), F.col("category_id").asc_nulls_last())))
    label = F.when(F.col("rank") <= keep, F.coalesce(F.col("t.category_id").cast("string"), F.lit("Uncategorized"))).otherwise("Other")
    named = totals.alias("t").join(ranks.alias("r"), F.col("t.category_id").eqNullSafe(F.col("r.category_id")))
    return named.groupBy("bucket", label.alias("category")).agg(F.round(F.sum("total"), 2).alias("total"))


def retained(flows: DataFrame, to_savings: DataFrame) -> DataFrame:
    """Income less expense less what went to savings, with the savings rates and the passive coverage of each cycle."""
    both = flows.join(to_savings.withColumnRenamed("cycle", "bucket"), "bucket", "left").withColumn("to_savings", F.coalesce("net", F.lit(0.0)))
    income = F.col("earned") + F.col("passive")
    ratio = lambda a, b: F.round(a / F.when(b != 0, b), 6)
    return both.select("bucket", F.round(income, 2).alias("income"), "expense", "to_savings", F.round(income - F.col("expense") - F.col("to_savings"), 2).alias("retained"), ratio(income - F.col("expense"), income).alias("savings_rate"), ratio(F.col("earned") - F.col("expense"), F.col("earned")).alias("earned_savings_rate"), ratio(F.col("passive"), F.col("expense")).alias("passive_coverage"))
