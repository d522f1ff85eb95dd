"""Edits by hand as transforms: rows and a table of edits in, the rows after them and what became of each edit out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import balances


def locks() -> Column:
    return F.coalesce("locked_fields", F.array().cast("array<string>"))


def edit_outcomes(tx: DataFrame, edits: DataFrame, splits: DataFrame, fields: list[str]) -> DataFrame:
    """(id, outcome, changed, new_ columns) of each edit (id, given: names of the fields it sets, and those fields).

    missing, amount (not positive) and split (the amount of a transaction that has splits) are refused; unchanged if
    every given value is what the row has; else updated, with the columns that differ.
    """
    new = edits.select("id", "given", *(F.col(c).alias(f"new_{c}") for c in fields))
    parted = splits.select(F.col("transaction_id").alias("id"), F.lit(True).alias("parted")).distinct()
    both = new.join(tx.select("id", F.lit(True).alias("known"), *fields), "id", "left").join(parted, "id", "left")
    changed = F.array_compact(F.array(*(F.when(F.array_contains("given", c) & ~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in fields)))
    both = both.withColumn("changed", F.when(F.col("known"), changed).otherwise(F.array().cast("array<string>")))
    outcome = F.when(F.col("known").isNull(), "missing")
    if "amount" in fields:
        outcome = outcome.when(F.array_contains("given", "amount") & ~F.coalesce(F.col("new_amount") > 0, F.lit(False)), "amount").when(F.array_contains("changed", "amount") & F.col("parted"), "split")
    outcome = outcome.when(F.size("changed") == 0, "unchanged").otherwise("updated")
    return both.select("id", outcome.alias("outcome"), "changed", *(f"new_{c}" for c in fields))


def edited(tx: DataFrame, outcomes: DataFrame, fields: list[str]) -> DataFrame:
    """tx after the edits that were not refused; the fields that moved are locked, and only these."""
    done = outcomes.where("outcome = 'updated'").drop("outcome").withColumnRenamed("id", "edit_id")
    both = tx.join(done, tx["id"] == done["edit_id"], "left")
    moved = lambda c: F.coalesce(F.array_contains("changed", c), F.lit(False))
    values = {c: F.when(moved(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields}
    return both.withColumns(values | {"locked_fields": F.when(F.col("edit_id").isNotNull(), F.array_union(locks(), "changed")).otherwise(F.col("locked_fields"))}).select(*tx.columns)


def cycle_moves(tx: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, outcome, cycle_override, locked_fields) of each move (id, cycle_start): only to the cycle before or after the one it posted in; null undoes it."""
    own = periods.period_start(periods.local_date("posted_at"))
    rows = moves.select("id", F.col("cycle_start").alias("to")).join(tx.select("id", F.lit(True).alias("known"), own.alias("own"), "cycle_override", "locked_fields"), "id", "left")
    beside = F.col("to").isNull() | F.col("to").isin(F.add_months("own", -1), F.add_months("own", 1))
    outcome = F.when(F.col("known").isNull(), "missing").when(~beside, "refused").when(F.col("to").eqNullSafe(F.col("cycle_override")), "unchanged").otherwise("moved")
    rows = rows.withColumn("outcome", outcome)
    moved = F.col("outcome") == "moved"
    return rows.select("id", "outcome", F.when(moved, F.col("to")).otherwise(F.col("cycle_override")).alias("cycle_override"), F.when(moved, F.array_union(locks(), F.array(F.lit("cycle_override")))).otherwise(F.col("locked_fields")).alias("locked_fields"))


def deletions(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, raw_message_id, sibling_legs): what goes, and how many legs of the same message stay or go beside it."""
    gone = tx.join(ids.select("id").distinct(), "id", "left_semi").select("id", "raw_message_id")
    legs = tx.where("raw_message_id IS NOT NULL").groupBy("raw_message_id").agg(F.count("*").alias("legs"))
    return gone.join(legs, "raw_message_id", "left").select("id", "raw_message_id", F.coalesce(F.col("legs") - 1, F.lit(0)).alias("sibling_legs"))


def after_deletion(tx: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transactions that stay, and the messages, those of deleted legs ignored so that no replay brings them back."""
    hit = gone.where("raw_message_id IS NOT NULL").select(F.col("raw_message_id").alias("hit_id")).distinct()
    both = messages.join(hit, messages["id"] == hit["hit_id"], "left")
    hit_now = F.col("hit_id").isNotNull()
    return tx.join(gone.select("id"), "id", "left_anti"), both.withColumns({"status": F.when(hit_now, "ignored").otherwise(F.col("status")), "ignored_reason": F.when(hit_now, "user").otherwise(F.col("ignored_reason"))}).drop("hit_id")


def bulk_edited(tx: DataFrame, ids: DataFrame, values: dict) -> DataFrame:
    """tx with these values on all the ids, each column of them locked whether it moved or not."""
    if not values:
        raise ValueError("a bulk edit sets at least one column")
    kinds, hit = dict(tx.dtypes), ids.select(F.col("id").alias("hit_id")).distinct()
    both, chosen = tx.join(hit, tx["id"] == hit["hit_id"], "left"), F.col("hit_id").isNotNull()
    set_ = {c: F.when(chosen, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
    return both.withColumns(set_ | {"locked_fields": F.when(chosen, F.array_union(locks(), F.array(*map(F.lit, values)))).otherwise(F.col("locked_fields"))}).select(*tx.columns)


def unlocked_field(tx: DataFrame, unlocks: DataFrame) -> DataFrame:
    """tx with the named locks (id, column) taken off; values stay as they are."""
    off = unlocks.groupBy(F.col("id").alias("off_id")).agg(F.collect_set("column").alias("off"))
    both = tx.join(off, tx["id"] == off["off_id"], "left")
    return both.withColumn("locked_fields", F.when(F.col("off").isNotNull(), F.array_except(locks(), "off")).otherwise(F.col("locked_fields"))).select(*tx.columns)


def manual_entries(drafts: DataFrame, accounts: DataFrame) -> DataFrame:
    """The drafts with error (amount, date, account) or as posted, reviewed transactions by hand: error is null."""
    known = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("known"))
    rows = drafts.join(known, "account_id", "left")
    cents = F.col("amount").try_cast("decimal(14,2)")
    valid = F.col("amount").rlike(r"^-?\d+(\.\d{1,2})?$") & (cents > 0)
    error = F.when(~F.coalesce(valid, F.lit(False)), "amount").when(F.col("posted_at").isNull(), "date").when(F.col("known").isNull(), "account")
    return rows.withColumns({"error": error, "amount": cents, "state": F.lit("posted"), "origin": F.lit("manual"), "is_reviewed": F.lit(True)}).drop("known")


def converted(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids are entries by hand from now on, unless they are superseded."""
    hit = ids.select(F.col("id").alias("hit_id")).distinct()
    both = tx.join(hit, tx["id"] == hit["hit_id"], "left")
    chosen = F.col("hit_id").isNotNull() & F.col("superseded_by").isNull()
    return both.withColumns({"origin": F.when(chosen, "manual").otherwise(F.col("origin")), "is_reviewed": F.col("is_reviewed") | chosen}).select(*tx.columns)


def drift_resolutions(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """(account_id, outcome, note, persists) of each note on a drift alert: it needs words and an alert that is still open.

    persists says whether the balances still differ after it was closed.
    """
    rows = notes.join(alerts.select("account_id", F.lit(True).alias("known"), "resolved_at", "current_balance", "reported"), "account_id", "left")
    outcome = F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "no note").when(F.col("known").isNull() | F.col("resolved_at").isNotNull(), "closed").otherwise("resolved")
    return rows.select("account_id", outcome.alias("outcome"), F.trim("note").alias("note"), (F.abs(F.col("current_balance") - F.col("reported")) > balances.TOLERANCE).alias("persists"))


def budget_actions(budgets: DataFrame, actions: DataFrame) -> DataFrame:
    """(category_id, cycle_start, amount, rollover, carry_in, closed, outcome): budgets after one action each.

    actions has category_id, day (any day of the cycle), action and amount: set (a null amount removes), roll, keep
    (rollover on or off) and reset (no carry, closed). A negative amount, and rollover or reset without a budget, are refused.
    """
    asked = actions.select("category_id", periods.period_start("day").alias("cycle_start"), "action", F.col("amount").alias("asked"))
    both = budgets.withColumn("known", F.lit(True)).join(asked, ["category_id", "cycle_start"], "full")
    act, known = F.col("action"), F.col("known").isNotNull()
    refused = F.coalesce((act == "set") & (F.col("asked") < 0), F.lit(False)) | act.isin("roll", "keep", "reset") & ~known
    outcome = F.when(act.isNull(), "kept").when(refused, "refused").when((act == "set") & F.col("asked").isNull(), "removed").when((act == "set") & ~known, "created").otherwise("changed")
    done = (act.isNotNull()) & ~refused
    both = both.withColumn("outcome", outcome)
    return both.select(
        "category_id",
        "cycle_start",
        F.when(done & (act == "set"), F.col("asked")).otherwise(F.col("amount")).alias("amount"),
        F.when(done & act.isin("roll", "keep"), act == "roll").otherwise(F.coalesce("rollover", F.when(F.col("outcome") == "created", F.lit(False)))).alias("rollover"),
        F.when(done & (act == "reset"), F.lit(0)).otherwise(F.coalesce("carry_in", F.when(F.col("outcome") == "created", F.lit(0)))).cast("decimal(14,2)").alias("carry_in"),
        (F.col("carry_closed_at").isNotNull() | done & (act == "reset")).alias("closed"),
        "outcome",
    )


def goal_refusals(goals: DataFrame, drafts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(goal_id, outcome, excess) of each draft (goal_id, account_id, target_amount, allocation), checked before it is saved.

    The other goals of the account and this allocation may not be more than it holds; a goal's own old share doesn't count.
    """
    held = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("known"), "is_liability", "current_balance")
    shares = goals.where("account_id IS NOT NULL").groupBy("account_id").agg(F.sum("allocation").alias("allotted"))
    own = goals.select("goal_id", F.col("account_id").alias("old_account"), F.col("allocation").alias("old"))
    rows = drafts.join(held, "account_id", "left").join(shares, "account_id", "left").join(own, "goal_id", "left")
    others = F.coalesce("allotted", F.lit(0)) - F.when(F.col("old_account").eqNullSafe(F.col("account_id")), F.coalesce("old", F.lit(0))).otherwise(F.lit(0))
    excess = others + F.col("allocation") - F.col("current_balance")
    outcome = F.when(~F.coalesce(F.col("target_amount") > 0, F.lit(False)), "target").when(~F.coalesce(F.col("allocation") >= 0, F.lit(False)), "allocation").when(F.col("known").isNull(), "account").when(F.col("is_liability"), "liability").when(excess > 0, "over-allocated").otherwise("saved")
    return rows.select("goal_id", outcome.alias("outcome"), F.when(excess > 0, excess.cast("double")).alias("excess"))


#: What each action on a series does to (status, confirmed, dismissed, excluded).
SERIES_ACTIONS = {
    "confirm": {"confirmed": True, "dismissed": False},
    "dismiss": {"dismissed": True, "confirmed": False},
    "restore": {"dismissed": False},
    "pause": {"status": "paused"},
    "resume": {"status": "active"},
    "cancel": {"status": "cancelled"},
    "exclude": {"excluded": True, "dismissed": True},
    "include": {"excluded": False, "dismissed": False},
}


def acted_series(series: DataFrame, actions: DataFrame) -> DataFrame:
    """series (detect_key, status, confirmed, dismissed, excluded, ..) after one action each (detect_key, action)."""
    both = series.join(actions.select("detect_key", "action"), "detect_key", "left")

    def after(column: str) -> Column:
        steps = [(name, patch[column]) for name, patch in SERIES_ACTIONS.items() if column in patch]
        chain = reduce(lambda c, s: (F if c is None else c).when(F.col("action") == s[0], F.lit(s[1])), steps, None)
        return chain.otherwise(F.col(column))

    return both.withColumns({c: after(c) for c in ("status", "confirmed", "dismissed", "excluded")}).drop("action").select(*series.columns)


def linked_to_series(tx: DataFrame, occurrences: DataFrame, series: DataFrame) -> DataFrame:
    """(id, detect_key): each transaction that a kept series was detected from, by the key of its occurrence."""
    kept = series.where("NOT excluded").select("detect_key")
    links = occurrences.join(kept, "detect_key", "left_semi").select(F.col("transaction_id").alias("id"), "detect_key")
    return tx.select("id").join(links, "id", "left")
