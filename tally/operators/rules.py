"""Rules over transactions, and replaying parsed legs against what is stored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.ledger import like_escaped

# What a rule can look at, how, and what it can set (action -> column).
FIELDS = ("merchant_raw", "biller", "description", "type", "direction", "account_id")
OPERATORS = ("equals", "contains", "starts_with")
ACTIONS = {"set_category": "category_id", "set_merchant": "merchant_id", "mark_internal_transfer": "is_internal", "exclude_from_analytics": "excluded"}


@dataclass(frozen=True)
class Rule:
    id: int
    priority: int
    match: tuple[tuple[str, str, str], ...]
    actions: dict
    enabled: bool = True

    @classmethod
    def parsed(cls, row: dict) -> Rule | None:
        """The rule that a stored row holds; none if any part of it is not what it should be, so it never matches."""
        match, actions = row.get("match"), row.get("actions")
        if not isinstance(match, list) or not match or not isinstance(actions, dict):
            return None
        conditions = []
        for c in match:
            if not isinstance(c, dict) or c.get("field") not in FIELDS or c.get("operator") not in OPERATORS or not isinstance(c.get("value"), str):
                return None
            conditions.append((c["field"], c["operator"], c["value"]))
        known = {k: v for k, v in actions.items() if k in ACTIONS}
        return cls(row["id"], row.get("priority", 0), tuple(conditions), known, bool(row.get("enabled", True))) if known else None


STORED = "struct<match: array<struct<field: string, operator: string, value: string>>, actions: map<string, string>>"


def stored_rules(rows: DataFrame) -> DataFrame:
    """(id, valid, match, actions) of rules stored as JSON (id, rule): one that isn't wholly as it should be never matches.

    A rule needs conditions, each with a known field, a known operator and a value, and at least one known action;
    actions that aren't known are left out.
    """
    parsed = rows.select("id", F.from_json("rule", STORED).alias("r")).select("id", "r.*")
    sound = F.forall("match", lambda c: c["field"].isin(*FIELDS) & c["operator"].isin(*OPERATORS) & c["value"].isNotNull())
    known = F.map_filter("actions", lambda k, v: k.isin(*ACTIONS))
    parsed = parsed.withColumn("actions", known)
    valid = F.coalesce((F.size("match") > 0) & F.coalesce(sound, F.lit(False)) & (F.size("actions") > 0), F.lit(False))
    return parsed.select("id", valid.alias("valid"), "match", "actions")


def matches(rule: Rule) -> Column:
    """All conditions, without case; superseded legs match nothing."""

    def one(name: str, operator: str, value: str) -> Column:
        column = F.col(name).cast("string")
        if operator == "equals":
            return F.coalesce(F.lower(column) == value.lower(), F.lit(False))
        pattern = f"%{like_escaped(value)}%" if operator == "contains" else f"{like_escaped(value)}%"
        return F.coalesce(column.ilike(pattern), F.lit(False))

    return reduce(lambda a, b: a & b, (one(*c) for c in rule.match), F.col("superseded_by").isNull())


def changes(rule: Rule) -> Column:
    """Whether applying the rule would change any of its columns; nulls compare as values."""
    return reduce(lambda a, b: a | b, (~F.col(ACTIONS[a]).eqNullSafe(F.lit(v)) for a, v in rule.actions.items()), F.lit(False))


def unlocked(rule: Rule) -> Column:
    locks = F.coalesce("locked_fields", F.array().cast("array<string>"))
    return ~reduce(lambda a, b: a | b, (F.array_contains(locks, ACTIONS[a]) for a in rule.actions), F.lit(False))


def preview(tx: DataFrame, rule: Rule) -> DataFrame:
    seen = tx.where(matches(rule))
    would = changes(rule) & unlocked(rule)
    return seen.agg(F.count("*").alias("matched"), F.count(F.when(would, 1)).alias("would_change"), F.count(F.when(~unlocked(rule), 1)).alias("locked"), F.count(F.when(~changes(rule) & unlocked(rule), 1)).alias("unchanged"))


def applied(tx: DataFrame, rule: Rule) -> DataFrame:
    """The transactions after the rule: exactly those change that its preview counts."""
    hit = matches(rule) & changes(rule) & unlocked(rule)
    kinds = dict(tx.dtypes)
    set_ = {ACTIONS[a]: F.when(F.col("__hit"), F.lit(v).cast(kinds[ACTIONS[a]])).otherwise(F.col(ACTIONS[a])) for a, v in rule.actions.items()}
    return tx.withColumn("__hit", hit).withColumns(set_).withColumn("matched_rule_id", F.when(F.col("__hit"), F.lit(rule.id))).drop("__hit")


def first_match(tx: DataFrame, rules: list[Rule]) -> DataFrame:
    """Opt-in: the rule of the smallest (priority, id) that matches each transaction; one chain of conditions, no join."""
    chain = None
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.id)):
        chain = F.when(matches(rule), F.lit(rule.id)) if chain is None else chain.when(matches(rule), F.lit(rule.id))
    return tx.withColumn("rule_id", F.lit(None).cast("int") if chain is None else chain)


def replayed(legs: DataFrame, stored: DataFrame, compared: list[str], in_scope: Column | None = None) -> DataFrame:
    """One row for each leg (raw_id, account_id, direction, message_status and the compared columns): what replaying it would do.

    outcome: deleted (its message is ignored), no-transaction, manual, out-of-scope, changed or unchanged; changes
    and blocked list the columns that differ, by whether the row has them locked.
    """
    keys = ["raw_id", "account_id", "direction"]
    old = stored.select(*keys, F.col("id"), "origin", "locked_fields", (F.lit(True) if in_scope is None else in_scope).alias("in_scope"), *(F.col(c).alias(f"old_{c}") for c in compared))
    both = legs.join(old, keys, "left")
    locks = F.coalesce("locked_fields", F.array().cast("array<string>"))
    differ = lambda locked: F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")) & (F.array_contains(locks, c) == F.lit(locked)), F.concat_ws(":", F.lit(c), F.coalesce(F.col(f"old_{c}").cast("string"), F.lit("-")), F.coalesce(F.col(c).cast("string"), F.lit("-")))) for c in compared)))
    skip = F.when(F.col("message_status") == "ignored", "deleted").when(F.col("id").isNull(), "no-transaction").when(F.col("origin") == "manual", "manual").when(~F.col("in_scope"), "out-of-scope")
    rows = both.withColumns({"skip": skip, "changes": differ(False), "blocked": differ(True)})
    outcome = F.coalesce("skip", F.when((F.size("changes") > 0) | (F.size("blocked") > 0), "changed").otherwise("unchanged"))
    none = F.array().cast("array<string>")
    return rows.select(*keys, "id", outcome.alias("outcome"), F.when(F.col("skip").isNull(), F.col("changes")).otherwise(none).alias("changes"), F.when(F.col("skip").isNull(), F.col("blocked")).otherwise(none).alias("blocked"))


def account_edit(before: DataFrame, after: DataFrame, tracked: list[str]) -> DataFrame:
    """(id, field, old, new) for each tracked column that an edit changed."""
    both = before.select("id", *(F.col(c).alias(f"old_{c}") for c in tracked)).join(after.select("id", *tracked), "id")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in tracked)))
    return both.select("id", rows.alias("e")).select("id", "e.*").where("NOT (old <=> new)")


def adjustment_legs(edited: DataFrame) -> DataFrame:
    """The leg that books the difference (id, current_balance, stated_balance) an edit by hand leaves; none without one."""
    delta = F.col("stated_balance") - F.col("current_balance")
    return edited.where(delta != 0).select(F.col("id").alias("account_id"), F.lit("adjustment").alias("type"), F.when(delta > 0, "credit").otherwise("debit").alias("direction"), F.abs(delta).alias("amount"), F.lit("manual").alias("origin"), F.lit(True).alias("excluded"))


def edit_snapshots(edited: DataFrame, at) -> DataFrame:
    """The balance stated by hand in each edit that leaves a difference, as a snapshot of its account."""
    return edited.where("stated_balance <> current_balance").select(F.col("id").alias("account_id"), F.col("stated_balance").alias("balance"), F.lit("manual").alias("source"), F.lit(at).alias("as_of"))


def closed_by_edit(alerts: DataFrame, edited: DataFrame, note: str = "balance stated by hand") -> DataFrame:
    """alerts (account_id, resolved_at, note) after the edits: an open one of an account whose balance was stated is closed with a note."""
    hit = edited.where("stated_balance <> current_balance").select(F.col("id").alias("account_id"), F.lit(True).alias("stated")).distinct()
    both = alerts.join(hit, "account_id", "left")
    closes = F.coalesce("stated", F.lit(False)) & F.col("resolved_at").isNull()
    return both.withColumn("closed", F.col("resolved_at").isNotNull() | closes).withColumn("note", F.when(closes, F.lit(note)).otherwise(F.col("note"))).drop("stated")
