"""What becomes of a transaction: settlements, reversals, refunds, foreign fees, counterparties."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.operators.pairing import nearest_in_time

#: How far off in amount and days a settlement may be, and in days a refund.
SETTLE_SHARE, SETTLE_DAYS, REFUND_DAYS = 0.25, 7, 90
#: Microseconds of a day, and rows that a task matches refunds of at a time.
_DAY, TASK_ROWS = 86_400_000_000, 50_000


def _place() -> Column:
    """Account and merchant as one text."""
    return F.to_json(F.struct("account_id", "merchant"))


def _at() -> Column:
    """The wall clock's microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp"), F.col("posted_at"))


def merchant_key() -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce("merchant_raw", "biller"), r"\s+", " ")))


def settlements(pending: DataFrame, posted: DataFrame) -> DataFrame:
    """(pending_id, posted_id): the message that settles a hold: same account and merchant, within 7 days after, amount within 25 % or the hold a token of 1.

    Both have id, account_id, merchant (null never matches), amount and posted_at. A hold is settled once: the nearest pairs come first,
    and a hold whose nearest message settled another one goes on to the next, until no message fits a hold that waits. Ids are unique.
    Amounts lie in classes of a ratio of 1.25: a hold looks at those of its range, a token at the list of all.
    """
    cents = F.round(F.col("amount") * 100).cast("long")
    rows = lambda df: df.where("id IS NOT NULL AND account_id IS NOT NULL AND merchant IS NOT NULL AND posted_at IS NOT NULL").select("id", _place().alias("key"), _at().alias("at"), cents.alias("cents")).distinct()
    share, token = round(SETTLE_SHARE * 100), F.col("cents") == 100
    size = lambda c: F.when(c > 0, F.floor(F.log(c.cast("double")) / math.log(1.25))).otherwise(-1).cast("int")
    low, high = F.col("cents") * (100 - share), F.col("cents") * (100 + share)
    classes = F.transform(F.sequence(size(low), size(high)), lambda c: c.cast("string"))
    left = F.lit(_DAY * (SETTLE_DAYS + 1) - 1) - F.pmod("at", F.lit(_DAY))  # to the end of the last day
    hold = rows(pending).where("cents >= 0").select("id", "key", "at", left.alias("until"), F.when(~token, low).alias("low"), F.when(~token, high).alias("high"), F.when(token, F.array(F.lit("all"))).otherwise(classes).alias("lists"))
    final = rows(posted).select("id", "key", "at", (F.col("cents") * 100).alias("low"), F.array_compact(F.array(F.lit("all"), F.when(F.col("cents") >= 0, size(F.col("cents") * 100).cast("string")))).alias("lists"))
    found = nearest_in_time(hold, final, _DAY * (SETTLE_DAYS + 1), unit=1_000_000)
    return found.select(F.col("out_id").alias("pending_id"), F.col("in_id").alias("posted_id"))


def settled_transactions(tx: DataFrame, pairs: DataFrame) -> DataFrame:
    """tx with each settled hold posted at the final amount; the row of the settlement itself goes, for it is the same purchase."""
    final = tx.select(F.col("id").alias("posted_id"), F.col("amount").alias("final"))
    hit = pairs.join(final, "posted_id").select(F.col("pending_id").alias("hit_id"), "final")
    both = tx.join(pairs.select(F.col("posted_id").alias("id")), "id", "left_anti").join(hit, F.col("id") == F.col("hit_id"), "left")
    done = F.col("hit_id").isNotNull()
    return both.withColumns({"state": F.when(done, "posted").otherwise(F.col("state")), "amount": F.coalesce("final", "amount")}).select(*tx.columns)


def net_of_reversals(tx: DataFrame) -> DataFrame:
    """(id, net): a transaction's signed amount less what reverses it, in the cycle of the original; reversals themselves count 0."""
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    back = tx.where("reverses_transaction_id IS NOT NULL").groupBy(F.col("reverses_transaction_id").alias("id")).agg(F.sum(signed).alias("back"))
    return tx.join(back, "id", "left").select("id", F.when(F.col("reverses_transaction_id").isNotNull(), F.lit(0)).otherwise(signed + F.coalesce("back", F.lit(0))).alias("net"))


def _last_purchases(group: pd.DataFrame) -> pd.DataFrame:
    """For each refund the last purchase before it of at least its amount, within the days that count.

    In order of time only purchases that no later one outbids can still be found: their prices fall, so one search finds the last that is high enough.
    """
    names = ["key", "period", "at", "is_refund", "id", "amount", "category_id"]
    group = group[names].sort_values(["key", "period", "at", "id"])
    out = []
    told = zip(*(group[c].tolist() for c in names))
    for _, some in groupby(told, key=lambda row: row[:2]):
        open_, prices = [], []  # of the purchases that count, oldest first; prices negated
        for at, same in groupby(some, key=lambda row: row[2]):
            same = list(same)
            for row in same:
                if row[3] and (k := bisect_right(prices, -row[5]) - 1) >= 0 and at // _DAY - open_[k][2] // _DAY <= REFUND_DAYS:
                    out.append((row[4], row[5], at, open_[k][4], open_[k][6], open_[k][5]))
            for row in same:
                if not row[3]:
                    while open_ and open_[-1][5] <= row[5]:
                        open_.pop()
                        prices.pop()
                    open_.append(row)
                    prices.append(-row[5])
    return pd.DataFrame(out, columns=["refund_id", "amount", "posted_at", "purchase_id", "category_id", "price"], dtype=object).astype({"posted_at": "int64"})


def refunds(purchases: DataFrame, credits: DataFrame) -> DataFrame:
    """(refund_id, purchase_id, category_id, amount, refunded, outcome) of each refund that has a purchase to go with.

    The last purchase before it on the same account and merchant within 90 days, of at least its amount; it takes
    that one's category as a negative expense. Refunds of one purchase add up in time order; one that takes the sum
    above the purchase is for review.
    """
    types = {name: purchases.schema[name].dataType for name in ("id", "category_id", "amount")}
    rows = lambda df, *more: df.where("account_id IS NOT NULL AND merchant IS NOT NULL AND posted_at IS NOT NULL AND amount IS NOT NULL").select(_place().alias("key"), "id", _at().alias("at"), "amount", *more)
    period = F.floor(F.floor(F.col("at") / _DAY) / REFUND_DAYS)
    bought = rows(purchases, F.col("category_id").cast("string")).select(F.lit(False).alias("is_refund"), "*", F.explode(F.array(period, period + 1)).alias("period"))
    back = rows(credits, F.lit(None).cast("string").alias("category_id")).select(F.lit(True).alias("is_refund"), "*", period.alias("period"))
    both = bought.unionByName(back)
    tasks = 1 + both.count() // TASK_ROWS
    kind = {name: t.simpleString() for name, t in types.items()}
    dealt = both.groupBy(F.pmod(F.xxhash64("key", "period"), F.lit(tasks)).alias("task"))
    one = dealt.applyInPandas(_last_purchases, f"refund_id {credits.schema['id'].dataType.simpleString()}, amount {credits.schema['amount'].dataType.simpleString()}, posted_at long, purchase_id {kind['id']}, category_id string, price {kind['amount']}")
    so_far = F.sum("amount").over(Window.partitionBy("purchase_id").orderBy("posted_at", "refund_id").rowsBetween(Window.unboundedPreceding, 0))
    one = one.withColumn("refunded", so_far)
    return one.select("refund_id", "purchase_id", F.col("category_id").cast(types["category_id"]), (-F.col("amount")).alias("amount"), "refunded", F.when(F.col("refunded") > F.col("price"), "review").otherwise("booked").alias("outcome"))


def fee_splits(tx: DataFrame, fee_category: int) -> DataFrame:
    """Splits of foreign purchases (id, amount, fee_amount, category_id): the merchant's part and the bank's fee; no fee, no split."""
    rows = tx.where("fee_amount > 0 AND fee_amount < amount")
    parts = F.array(F.struct(F.lit(1).alias("n"), F.col("category_id"), (F.col("amount") - F.col("fee_amount")).alias("amount")), F.struct(F.lit(2).alias("n"), F.lit(fee_category).cast("int").alias("category_id"), F.col("fee_amount").alias("amount")))
    return rows.select(F.col("id").alias("transaction_id"), F.explode(parts).alias("s")).select("transaction_id", "s.n", "s.category_id", "s.amount")


def remembered(tx: DataFrame) -> DataFrame:
    """tx with the category last given by hand to its counterparty before it, where it has none of its own."""
    given = F.when(F.array_contains(F.coalesce("locked_fields", F.array().cast("array<string>")), "category_id"), F.col("category_id"))
    before = Window.partitionBy("counterparty").orderBy("posted_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("counterparty").isNotNull(), F.last(given, ignorenulls=True).over(before))
    return tx.withColumn("category_id", F.coalesce("category_id", last))


def transfer_class() -> Column:
    """What a transfer is: internal only if its counterparty is an owned account, else spending or other income by direction."""
    return F.when(F.col("owned"), "internal").when(F.col("direction") == "debit", "expense").otherwise("income")


def first_balances(snapshots: DataFrame, legs: DataFrame) -> DataFrame:
    """(account_id, opening): what an account held before its first reported balance: that balance less the legs up to then."""
    first = snapshots.groupBy("account_id").agg(F.min_by(F.struct("balance", "as_of"), F.struct("as_of", "id")).alias("s")).select("account_id", F.col("s.balance").alias("balance"), F.col("s.as_of").alias("as_of"))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    moved = legs.join(first, "account_id").where(F.col("posted_at") <= F.col("as_of")).groupBy("account_id").agg(F.sum(signed).alias("moved"))
    return first.join(moved, "account_id", "left").select("account_id", (F.col("balance") - F.coalesce("moved", F.lit(0))).alias("opening"))


def daily_average(total: Column, days: Column) -> Column:
    """A bucket's total a day, so that a partial bucket compares with a whole one; null before its first day."""
    return total / F.nullif(days, F.lit(0))


def running_reconciliation(legs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(account_id, computed, reported, off): the legs' running balance at an account's last report against that report.

    legs has opening_balance; a leg at the very time of the report counts.
    """
    last = snapshots.groupBy("account_id").agg(F.max_by(F.struct("balance", "as_of"), F.struct("as_of", "id")).alias("s")).select("account_id", F.col("s.balance").alias("reported"), F.col("s.as_of").alias("as_of"))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    run = legs.withColumn("balance", F.col("opening_balance") + F.sum(signed).over(Window.partitionBy("account_id").orderBy("posted_at", "id").rowsBetween(Window.unboundedPreceding, 0)))
    at = run.join(last, "account_id").where(F.col("posted_at") <= F.col("as_of")).groupBy("account_id", "reported").agg(F.max_by("balance", F.struct("posted_at", "id")).alias("computed"))
    return at.select("account_id", "computed", "reported", (F.abs(F.col("computed") - F.col("reported")) > F.lit("0.01").cast("decimal(14,2)")).alias("off"))
