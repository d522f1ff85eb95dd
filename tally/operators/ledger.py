"""Filters, pages, exports and facets of the ledger."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import predicates as P
from tally.schemas import DIRECTIONS, TRANSACTION_TYPES

PAGE_SIZE = 100
LOW_CONFIDENCE = 0.8
#: Columns that a search looks into.
SEARCHED = ("merchant_raw", "biller", "description", "notes", "display_name", "category_name", "account_name")


@dataclass(frozen=True)
class Filters:
    """What a user asks the ledger for; None asks for nothing. from_params drops what is not valid."""

    grain: str | None = None
    period: dt.date | None = None
    first: dt.date | None = None
    last: dt.date | None = None
    account_id: int | None = None
    category_id: int | None = None
    no_category: bool = False
    type: str | None = None
    direction: str | None = None
    merchant: str | None = None
    search: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    internal: str | None = None  # "only" or "hide"
    uncategorized: bool = False
    low_confidence: bool = False
    manual: bool = False
    issues: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def from_params(cls, params: dict[str, str]) -> Filters:
        good: dict[str, object] = {}
        bad: list[str] = []
        day = re.compile(r"\d{4}-\d{2}-\d{2}")
        for f in fields(cls):
            value = params.get(f.name)
            if not value:
                continue
            try:
                if f.name in ("period", "first", "last"):
                    if not day.fullmatch(value):
                        raise ValueError(value)
                    good[f.name] = dt.date.fromisoformat(value)
                elif f.name in ("account_id", "category_id"):
                    good[f.name] = int(value)
                elif f.name in ("minimum", "maximum"):
                    if not re.fullmatch(r"\d+(\.\d{1,2})?", value):
                        raise ValueError(value)
                    good[f.name] = float(value)
                elif f.name in ("no_category", "uncategorized", "low_confidence", "manual"):
                    good[f.name] = value in ("1", "true", "yes")
                elif {"grain": ("cycle", "week"), "type": TRANSACTION_TYPES, "direction": DIRECTIONS, "internal": ("only", "hide")}.get(f.name, (value,)).count(value):
                    good[f.name] = value.strip()
                else:
                    raise ValueError(value)
            except ValueError:
                bad.append(f.name)
        if good.get("first") and good.get("last") and good["first"] > good["last"]:
            good["first"], good["last"] = good["last"], good["first"]
        return cls(**good, issues=tuple(bad))

    def scope(self) -> tuple[str, dt.date, dt.date] | None:
        """A range of days wins over all, all over a period."""
        if self.first or self.last:
            return ("local_day", self.first or dt.date(1, 1, 1), self.last or dt.date(9999, 12, 31))
        if self.grain and self.period:
            start = periods.bounds(self.grain, self.period)[0]
            return ("cycle_start" if self.grain == "cycle" else "week_start", start, start)
        return None


def like_escaped(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def where(filters: Filters, columns: list[str]) -> Column:
    """All conditions that the filters ask for, over transactions with bucket columns and an array split_categories."""
    parts = [F.col("superseded_by").isNull()]
    if scope := filters.scope():
        parts.append(F.col(scope[0]).between(F.lit(scope[1]), F.lit(scope[2])))
    if filters.account_id is not None:
        parts.append(F.col("account_id") == filters.account_id)
    if filters.no_category:
        parts.append(F.col("category_id").isNull() & (F.size("split_categories") == 0))
    elif filters.category_id is not None:
        parts.append((F.col("category_id") == filters.category_id) | F.array_contains("split_categories", filters.category_id))
    for name in ("type", "direction"):
        if value := getattr(filters, name):
            parts.append(F.col(name) == value)
    if filters.merchant:
        parts.append(F.lower(F.coalesce("merchant_raw", "biller")) == filters.merchant.lower())
    if filters.search:
        pattern = f"%{like_escaped(filters.search)}%"
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in SEARCHED if c in columns]))
    if filters.minimum is not None:
        parts.append(F.col("amount") >= F.lit(filters.minimum).cast("decimal(14,2)"))
    if filters.maximum is not None:
        parts.append(F.col("amount") <= F.lit(filters.maximum).cast("decimal(14,2)"))
    if filters.internal:
        parts.append(F.col("is_internal") if filters.internal == "only" else ~F.col("is_internal"))
    if filters.uncategorized:
        parts.append(P.is_uncategorized() & (F.size("split_categories") == 0))
    if filters.low_confidence:
        parts.append((F.col("confidence") < F.lit(str(LOW_CONFIDENCE)).cast("decimal(4,3)")) & ~F.col("is_reviewed"))
    if filters.manual:
        parts.append(F.col("origin") == "manual")
    return reduce(lambda a, b: a & b, parts)


def searchable(tx: DataFrame, splits: DataFrame, accounts: DataFrame, categories: DataFrame, merchants: DataFrame) -> DataFrame:
    """Transactions with names and split categories; dimensions are joined by key and broadcast only if small."""
    from tally.operators.view import with_buckets

    parts = splits.groupBy(F.col("transaction_id").alias("id")).agg(F.sort_array(F.collect_set("category_id")).alias("split_categories"))
    rows = with_buckets(tx).join(parts, "id", "left").withColumn("split_categories", F.coalesce("split_categories", F.array().cast("array<int>")))
    rows = rows.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name")), "account_id")
    rows = rows.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id", "left")
    return rows.join(merchants.select(F.col("id").alias("merchant_id"), "display_name"), "merchant_id", "left")


def page(rows: DataFrame, after: tuple[dt.datetime, int] | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The next page by (posted_at, id) descending, and whether more follow: a top-k, never a sort of all."""
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.where((F.col("posted_at") < at) | ((F.col("posted_at") == at) & (F.col("id") < last)))
    top = rows.orderBy(F.col("posted_at").desc(), F.col("id").desc()).limit(size + 1)
    return top


def day_subtotals(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Of the days on a page: the flow of all rows that the filters let through, refunds and credits included."""
    days = shown.select("local_day").distinct()
    seen = rows.join(days, "local_day", "left_semi")
    net = F.coalesce(F.sum(F.when(P.counts_in_flow(), P.signed_amount())), F.lit(0))
    return seen.groupBy(F.col("local_day").cast("string").alias("day")).agg(net.cast("double").alias("net"), F.count("*").alias("n"), F.count(F.when(~P.counts_in_flow(), 1)).alias("not_counted"))


def export_rows(tx: DataFrame, splits: DataFrame, accounts: DataFrame, categories: DataFrame, cap: int = 10_000) -> DataFrame:
    """One row for each split, or for a transaction without; at most cap rows, newest first."""
    parts = splits.select(F.col("transaction_id").alias("id"), F.col("n").alias("split_n"), F.col("category_id").alias("sc"), F.col("amount").alias("sa"))
    rows = tx.where("superseded_by IS NULL").join(parts, "id", "left")
    rows = rows.withColumns({"category_id": F.when(F.col("split_n").isNotNull(), F.col("sc")).otherwise(F.col("category_id")), "amount": F.coalesce("sa", "amount")})
    top = rows.orderBy(F.col("posted_at").desc(), F.col("id").desc(), F.col("split_n").asc_nulls_first()).limit(cap)
    top = top.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account")), "account_id").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    return top.select("id", "split_n", F.date_format(periods.local_ts("posted_at"), "yyyy-MM-dd HH:mm").alias("local_time"), "account", "category", "direction", "type", F.col("amount").cast("double"))
