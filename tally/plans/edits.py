"""Queries on edits by hand: outcomes and rows after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import edits as E
from tally.operators import recurring
from tally.plans.accounts import BAL, current
from tally.plans.planning import _GOALS, _OCC, goals
from tally.plans.registry import query
from tally.sources import tables as S

_SORTED = "array_to_string(list_sort({0}), ',')"
_FIELDS = ["amount", "merchant_raw", "category_id"]


def _edits(spark, d):
    """Each third transaction gets an edit by its id; some name no transaction or an amount that can't be."""
    k = F.col("id")
    given = F.when(k % 9 == 0, F.array(F.lit("amount"), F.lit("merchant_raw"))).when(k % 9 == 3, F.array(F.lit("category_id"))).otherwise(F.array(F.lit("merchant_raw"), F.lit("category_id")))
    amount = F.when(k % 27 == 0, F.lit(0)).when(k % 18 == 0, F.col("amount")).otherwise(F.col("amount") + 1).cast("decimal(14,2)")
    return S.transactions(spark, d).where(k % 3 == 0).select(F.when(k % 30 == 3, -k).otherwise(k).alias("id"), given.alias("given"), amount.alias("amount"), F.when(k % 2 == 0, "shop").otherwise(F.col("merchant_raw")).alias("merchant_raw"), F.when(k % 5 != 0, 7).cast("int").alias("category_id"))


_EDITS = f"""{S.TX}, ed AS (SELECT CASE WHEN id % 30 = 3 THEN -id ELSE id END AS id, CASE id % 9 WHEN 0 THEN ['amount', 'merchant_raw'] WHEN 3 THEN ['category_id'] ELSE ['merchant_raw', 'category_id'] END AS given, CASE WHEN id % 27 = 0 THEN 0 WHEN id % 18 = 0 THEN amount ELSE amount + 1 END AS amount, CASE WHEN id % 2 = 0 THEN 'shop' ELSE merchant_raw END AS merchant_raw, CASE WHEN id % 5 <> 0 THEN 7 END AS category_id FROM tx WHERE id % 3 = 0),
eo AS (SELECT ed.* EXCLUDE (ch), CASE WHEN tx.id IS NULL THEN 'missing' WHEN list_contains(given, 'amount') AND ed.amount <= 0 THEN 'amount' WHEN list_contains(ch, 'amount') AND EXISTS (SELECT 1 FROM splits WHERE transaction_id = ed.id) THEN 'split' WHEN len(ch) = 0 THEN 'unchanged' ELSE 'updated' END AS outcome, CASE WHEN tx.id IS NULL THEN [] ELSE ch END AS ch
 FROM (SELECT ed.*, list_filter([CASE WHEN list_contains(given, 'amount') AND ed.amount IS DISTINCT FROM tx.amount THEN 'amount' END, CASE WHEN list_contains(given, 'merchant_raw') AND ed.merchant_raw IS DISTINCT FROM tx.merchant_raw THEN 'merchant_raw' END, CASE WHEN list_contains(given, 'category_id') AND ed.category_id IS DISTINCT FROM tx.category_id THEN 'category_id' END], lambda x: x IS NOT NULL) AS ch FROM ed LEFT JOIN tx ON tx.id = ed.id) ed LEFT JOIN tx ON tx.id = ed.id)"""


@query("edit_outcomes", f"WITH {_EDITS} SELECT id, outcome, {_SORTED.format('ch')} AS changed FROM eo")
def edit_outcomes(spark, d):
    found = E.edit_outcomes(S.transactions(spark, d), _edits(spark, d), S.splits(spark, d), _FIELDS)
    return found.select("id", "outcome", F.array_join(F.array_sort("changed"), ",").alias("changed"))


@query(
    "edited_transactions",
    f"WITH {_EDITS}, u AS (SELECT * FROM eo WHERE outcome = 'updated') SELECT tx.id, (CASE WHEN list_contains(ch, 'amount') THEN u.amount ELSE tx.amount END)::DOUBLE AS amount, CASE WHEN list_contains(ch, 'merchant_raw') THEN u.merchant_raw ELSE tx.merchant_raw END AS merchant_raw, CASE WHEN list_contains(ch, 'category_id') THEN u.category_id ELSE tx.category_id END AS category_id, {_SORTED.format('list_distinct(list_concat(locked_fields, coalesce(ch, [])))')} AS locks FROM tx LEFT JOIN u ON u.id = tx.id",
)
def edited_transactions(spark, d):
    tx = S.transactions(spark, d)
    rows = E.edited(tx, E.edit_outcomes(tx, _edits(spark, d), S.splits(spark, d), _FIELDS), _FIELDS)
    return rows.select("id", F.col("amount").cast("double"), "merchant_raw", "category_id", F.array_join(F.array_sort("locked_fields"), ",").alias("locks"))


_OWN = S.cycle_sql(S.LOCAL.format("posted_at"))


@query(
    "cycle_override_moves",
    f"""WITH {S.TX}, m AS (SELECT tx.*, {_OWN} AS own, CASE id % 4 WHEN 0 THEN ({_OWN} + INTERVAL 1 MONTH)::DATE WHEN 1 THEN ({_OWN} - INTERVAL 1 MONTH)::DATE WHEN 2 THEN {_OWN} END AS dest FROM tx),
o AS (SELECT *, CASE WHEN dest IS NOT NULL AND dest NOT IN ((own + INTERVAL 1 MONTH)::DATE, (own - INTERVAL 1 MONTH)::DATE) THEN 'refused' WHEN dest IS NOT DISTINCT FROM cycle_override THEN 'unchanged' ELSE 'moved' END AS outcome FROM m)
SELECT id, outcome, (CASE WHEN outcome = 'moved' THEN dest ELSE cycle_override END)::VARCHAR AS cycle_override, {_SORTED.format("CASE WHEN outcome = 'moved' THEN list_distinct(list_append(locked_fields, 'cycle_override')) ELSE locked_fields END")} AS locks FROM o""",
)
def cycle_override_moves(spark, d):
    from tally.functions import periods

    tx = S.transactions(spark, d)
    own, k = periods.period_start(periods.local_date("posted_at")), F.col("id")
    moves = tx.select("id", F.when(k % 4 == 0, F.add_months(own, 1)).when(k % 4 == 1, F.add_months(own, -1)).when(k % 4 == 2, own).alias("cycle_start"))
    return E.cycle_moves(tx, moves).select("id", "outcome", F.col("cycle_override").cast("string"), F.array_join(F.array_sort("locked_fields"), ",").alias("locks"))


def _legs_of_messages(spark, d):
    """Two transactions a message; entries by hand have none."""
    return S.transactions(spark, d).withColumn("raw_message_id", F.when(F.col("origin") == "parsed", F.floor(F.col("id") / 2)))


_LEGS = f"{S.TX}, lm AS (SELECT *, CASE WHEN origin = 'parsed' THEN id // 2 END AS raw_message_id FROM tx), gone AS (SELECT * FROM lm WHERE id % 5 = 2)"


@query("deleted_transactions", f"WITH {_LEGS} SELECT g.id, g.raw_message_id, (SELECT count(*) FROM lm WHERE lm.raw_message_id = g.raw_message_id AND lm.id <> g.id) AS sibling_legs FROM gone g")
def deleted_transactions(spark, d):
    tx = _legs_of_messages(spark, d)
    return E.deletions(tx, tx.where("id % 5 = 2").select("id"))


@query("messages_after_delete", f"WITH {_LEGS} SELECT DISTINCT raw_message_id AS id, CASE WHEN raw_message_id IN (SELECT raw_message_id FROM gone WHERE raw_message_id IS NOT NULL) THEN 'ignored' ELSE 'parsed' END AS status, CASE WHEN raw_message_id IN (SELECT raw_message_id FROM gone WHERE raw_message_id IS NOT NULL) THEN 'user' END AS ignored_reason FROM lm WHERE raw_message_id IS NOT NULL")
def messages_after_delete(spark, d):
    tx = _legs_of_messages(spark, d)
    messages = tx.where("raw_message_id IS NOT NULL").select(F.col("raw_message_id").alias("id")).distinct().withColumns({"status": F.lit("parsed"), "ignored_reason": F.lit(None).cast("string")})
    return E.after_deletion(tx, messages, E.deletions(tx, tx.where("id % 5 = 2").select("id")))[1]


@query("bulk_edit", f"WITH {S.TX} SELECT id, CASE WHEN id % 7 = 1 THEN 3 ELSE category_id END AS category_id, excluded OR id % 7 = 1 AS excluded, {_SORTED.format('''CASE WHEN id % 7 = 1 THEN list_distinct(list_concat(locked_fields, ['category_id', 'excluded'])) ELSE locked_fields END''')} AS locks FROM tx")
def bulk_edit(spark, d):
    tx = S.transactions(spark, d)
    rows = E.bulk_edited(tx, tx.where("id % 7 = 1").select("id"), {"category_id": 3, "excluded": True})
    return rows.select("id", "category_id", "excluded", F.array_join(F.array_sort("locked_fields"), ",").alias("locks"))


@query("unlocked_fields", f"WITH {S.TX} SELECT id, {_SORTED.format('''CASE WHEN id % 2 = 0 THEN list_filter(locked_fields, lambda x: x <> 'amount') ELSE locked_fields END''')} AS locks FROM tx")
def unlocked_fields(spark, d):
    tx = S.transactions(spark, d)
    rows = E.unlocked_field(tx, tx.where("id % 2 = 0").select("id", F.lit("amount").alias("column")))
    return rows.select("id", F.array_join(F.array_sort("locked_fields"), ",").alias("locks"))


@query(
    "manual_entries",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN 'amount' WHEN o_orderkey % 6 = 3 THEN 'date' WHEN o_orderkey % 6 = 4 THEN 'account' END AS error, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN round(1.255, 2) ELSE 12.5 END::DOUBLE AS amount, 'manual' AS origin, 'posted' AS state FROM orders",
)
def manual_entries(spark, d):
    k = F.col("o_orderkey")
    amount = F.when(k % 6 == 0, "twelve").when(k % 6 == 1, "0").when(k % 6 == 2, "1.255").otherwise("12.50")
    drafts = S.table(spark, d, "orders").select(k.alias("id"), F.when(k % 6 == 4, -1).otherwise(F.col("o_custkey")).alias("account_id"), amount.alias("amount"), F.when(k % 6 != 3, F.col("o_orderdate")).alias("posted_at"))
    rows = E.manual_entries(drafts, S.accounts(spark, d))
    return rows.select("id", "error", F.col("amount").cast("double"), "origin", "state")


@query("converted_to_manual", f"WITH {S.TX} SELECT id, CASE WHEN id % 4 = 3 AND superseded_by IS NULL THEN 'manual' ELSE origin END AS origin, is_reviewed OR (id % 4 = 3 AND superseded_by IS NULL) AS is_reviewed FROM tx")
def converted_to_manual(spark, d):
    tx = S.transactions(spark, d)
    return E.converted(tx, tx.where("id % 4 = 3").select("id")).select("id", "origin", "is_reviewed")


@query(
    "drift_resolutions",
    f"WITH {BAL} SELECT id AS account_id, CASE WHEN id % 5 = 0 THEN 'no note' WHEN id % 7 = 0 OR id % 3 = 0 THEN 'closed' ELSE 'resolved' END AS outcome, CASE WHEN id % 5 = 0 THEN '' ELSE 'cash' END AS note, CASE WHEN id % 7 <> 0 THEN id % 2 = 0 END AS persists FROM bal",
)
def drift_resolutions(spark, d):
    rows, k = current(spark, d), F.col("id")
    alerts = rows.where("id % 7 <> 0").select(k.alias("account_id"), F.when(k % 3 == 0, F.lit("1997-01-01").cast("date")).alias("resolved_at"), "current_balance", (F.col("current_balance") + F.when(k % 2 == 0, 1).otherwise(0)).alias("reported"))
    return E.drift_resolutions(alerts, rows.select(k.alias("account_id"), F.when(k % 5 == 0, "  ").otherwise(" cash ").alias("note")))


@query(
    "budget_actions",
    f"""WITH {S.BUDGETS}, ac AS (SELECT n_nationkey AS category_id, make_date(1997, 6, 25) AS cycle_start, ['set', 'set', 'roll', 'keep', 'reset', 'set'][n_nationkey % 6 + 1] AS action, CASE n_nationkey % 6 WHEN 0 THEN 500 WHEN 5 THEN -1 END AS asked FROM nation),
j AS (SELECT coalesce(b.category_id, ac.category_id) AS category_id, coalesce(b.cycle_start, ac.cycle_start) AS cycle_start, b.amount, b.rollover, b.carry_in, b.carry_closed_at, b.category_id IS NOT NULL AS known, action, asked, coalesce((action = 'set' AND asked < 0) OR (action IN ('roll', 'keep', 'reset') AND b.category_id IS NULL), false) AS refused FROM bud b FULL JOIN ac ON ac.category_id = b.category_id AND ac.cycle_start = b.cycle_start),
o AS (SELECT *, CASE WHEN action IS NULL THEN 'kept' WHEN refused THEN 'refused' WHEN action = 'set' AND asked IS NULL THEN 'removed' WHEN action = 'set' AND NOT known THEN 'created' ELSE 'changed' END AS outcome FROM j)
SELECT category_id, cycle_start::VARCHAR AS cycle_start, (CASE WHEN NOT refused AND action = 'set' THEN asked ELSE amount END)::DOUBLE AS amount, CASE WHEN NOT refused AND action IN ('roll', 'keep') THEN action = 'roll' WHEN outcome = 'created' THEN false ELSE rollover END AS rollover, (CASE WHEN NOT refused AND action = 'reset' THEN 0 WHEN outcome = 'created' THEN 0 ELSE carry_in END)::DOUBLE AS carry_in, (carry_closed_at IS NOT NULL OR coalesce(NOT refused AND action = 'reset', false)) AS closed, outcome FROM o""",
)
def budget_actions(spark, d):
    k = F.col("n_nationkey")
    acts = F.get(F.array(*map(F.lit, ("set", "set", "roll", "keep", "reset", "set"))), (k % 6).cast("int"))
    actions = S.table(spark, d, "nation").select(k.alias("category_id"), F.lit("1997-07-03").cast("date").alias("day"), acts.alias("action"), F.when(k % 6 == 0, 500).when(k % 6 == 5, -1).cast("decimal(14,2)").alias("amount"))
    rows = E.budget_actions(S.budgets(spark, d), actions)
    return rows.select("category_id", F.col("cycle_start").cast("string"), F.col("amount").cast("double"), "rollover", F.col("carry_in").cast("double"), "closed", "outcome")


@query(
    "goal_refusals",
    f"""WITH {BAL}, {_GOALS}, dr AS (SELECT goal_id, CASE WHEN goal_id % 11 = 0 THEN -1 ELSE coalesce(account_id, goal_id) END AS account_id, CASE WHEN goal_id % 13 = 0 THEN 0 ELSE target_amount END AS target_amount, CASE WHEN goal_id % 17 = 0 THEN -5 ELSE allocation + 200 END AS allocation FROM goals),
g AS (SELECT account_id, sum(allocation) AS allotted FROM goals WHERE account_id IS NOT NULL GROUP BY 1), j AS (SELECT dr.*, b.id AS known, b.is_liability, coalesce(g.allotted, 0) - CASE WHEN o.account_id IS NOT DISTINCT FROM dr.account_id THEN o.allocation ELSE 0 END + dr.allocation - b.current_balance AS excess FROM dr LEFT JOIN bal b ON b.id = dr.account_id LEFT JOIN g ON g.account_id = dr.account_id LEFT JOIN goals o ON o.goal_id = dr.goal_id)
SELECT goal_id, CASE WHEN NOT target_amount > 0 THEN 'target' WHEN allocation < 0 THEN 'allocation' WHEN known IS NULL THEN 'account' WHEN is_liability THEN 'liability' WHEN excess > 0 THEN 'over-allocated' ELSE 'saved' END AS outcome, (CASE WHEN excess > 0 THEN excess END)::DOUBLE AS excess FROM j""",
)
def goal_refusals(spark, d):
    rows, k = goals(spark, d), F.col("goal_id")
    money = lambda c: c.cast("decimal(14,2)")
    drafts = rows.select("goal_id", F.when(k % 11 == 0, -1).otherwise(F.coalesce("account_id", k)).alias("account_id"), money(F.when(k % 13 == 0, 0).otherwise(F.col("target_amount"))).alias("target_amount"), money(F.when(k % 17 == 0, -5).otherwise(F.col("allocation") + 200)).alias("allocation"))
    return E.goal_refusals(rows, drafts, current(spark, d))


_ACTS = list(E.SERIES_ACTIONS)


def _stored_series(spark, d):
    """A series for each category, in every state."""
    k = F.col("n_nationkey")
    return S.table(spark, d, "nation").select(F.col("n_name").alias("detect_key"), F.when(k % 3 == 0, "paused").otherwise("active").alias("status"), (k % 2 == 0).alias("confirmed"), (k % 5 == 0).alias("dismissed"), (k % 7 == 0).alias("excluded"), (k * 1.5).alias("amount_avg"), k.alias("k"))


@query(
    "series_actions",
    f"WITH s AS (SELECT n_name AS detect_key, CASE WHEN n_nationkey % 3 = 0 THEN 'paused' ELSE 'active' END AS status, n_nationkey % 2 = 0 AS confirmed, n_nationkey % 5 = 0 AS dismissed, n_nationkey % 7 = 0 AS excluded, CASE WHEN n_nationkey % 9 < 8 THEN {_ACTS}[n_nationkey % 9 + 1] END AS a FROM nation) SELECT detect_key, CASE a WHEN 'pause' THEN 'paused' WHEN 'resume' THEN 'active' WHEN 'cancel' THEN 'cancelled' ELSE status END AS status, CASE WHEN a = 'confirm' THEN true WHEN a = 'dismiss' THEN false ELSE confirmed END AS confirmed, CASE WHEN a IN ('dismiss', 'exclude') THEN true WHEN a IN ('confirm', 'restore', 'include') THEN false ELSE dismissed END AS dismissed, CASE a WHEN 'exclude' THEN true WHEN 'include' THEN false ELSE excluded END AS excluded FROM s",
)
def series_actions(spark, d):
    rows = _stored_series(spark, d)
    actions = rows.where("k % 9 < 8").select("detect_key", F.get(F.array(*map(F.lit, _ACTS)), (F.col("k") % 9).cast("int")).alias("action"))
    return E.acted_series(rows, actions).select("detect_key", "status", "confirmed", "dismissed", "excluded")


@query("series_links", f"WITH {_OCC} SELECT tx.id, o.detect_key FROM tx LEFT JOIN (SELECT * FROM occ WHERE kind <> 'bill') o ON o.transaction_id = tx.id")
def series_links(spark, d):
    """Each transaction's series; bills are excluded from detection here."""
    occurrences = recurring.occurrences(S.transactions(spark, d), S.merchants(spark, d))
    series = occurrences.select("detect_key", (F.col("kind") == "bill").alias("excluded")).distinct()
    return E.linked_to_series(S.transactions(spark, d), occurrences, series)
