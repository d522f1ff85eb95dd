"""What counts as expense, earned and passive income and flow: one Column each, used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paying one's own card or loan is not spending.
SETTLEMENTS = ("card_payment", "loan_payment")


def _owned() -> Column:
    return ~F.col("is_internal") & ~F.col("excluded")


def is_expense() -> Column:
    return (F.col("direction") == "debit") & counts_in_flow()


def is_earned() -> Column:
    return (F.col("direction") == "credit") & _owned() & (F.col("type") == "income")


def is_passive() -> Column:
    return (F.col("direction") == "credit") & _owned() & (F.col("type") == "profit")


def is_uncategorized() -> Column:
    return F.col("category_id").isNull() & is_expense()


def counts_in_flow() -> Column:
    return _owned() & ~F.col("type").isin(*SETTLEMENTS) & (F.col("state") != "declined")


def signed_amount() -> Column:
    return F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def total(when: Column, amount: str = "amount") -> Column:
    """The sum of the amounts where it holds, 0 if none, as a double."""
    return F.coalesce(F.sum(F.when(when, F.col(amount))), F.lit(0)).cast("double")


def display_name(*fallbacks: str) -> Column:
    return F.coalesce(*fallbacks)
