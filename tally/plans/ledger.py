"""Queries on the ledger's pages, filters and exports, on rules and on replay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.operators import ledger as L
from tally.operators import rules as R
from tally.operators.view import with_buckets
from tally.plans.registry import query
from tally.plans.spending import CYCLE, FLOW
from tally.sources import tables as S

_CAT = "cat AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey + 100 AS parent_id, n_nationkey % 8 = 0 AS is_income FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL, false FROM region)"
_LD = S.LOCAL.format("posted_at")


def _rows(spark, d) -> DataFrame:
    return L.searchable(S.transactions(spark, d), S.splits(spark, d), S.accounts(spark, d), S.categories(spark, d), S.merchants(spark, d))


_AFTER = (dt.datetime(1997, 8, 10, 12), 5000)


@query("ledger_page_keyset", f"WITH {S.TX} SELECT id, posted_at::VARCHAR AS posted_at, amount::DOUBLE AS amount, direction, type FROM tx WHERE superseded_by IS NULL AND (posted_at, id) < (TIMESTAMP '{_AFTER[0]}', {_AFTER[1]}) ORDER BY posted_at DESC, id DESC LIMIT 101")
def ledger_page_keyset(spark, d):
    rows = L.page(S.transactions(spark, d).where("superseded_by IS NULL"), _AFTER)
    return rows.select("id", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), F.col("amount").cast("double"), "direction", "type")


@query(
    "ledger_day_subtotals",
    f"WITH {S.TX}, f AS (SELECT *, {_LD} AS ld FROM tx WHERE superseded_by IS NULL AND direction = 'debit' AND amount >= 1000), p AS (SELECT DISTINCT ld FROM (SELECT ld FROM f WHERE (posted_at, id) < (TIMESTAMP '{_AFTER[0]}', {_AFTER[1]}) ORDER BY posted_at DESC, id DESC LIMIT 101)) SELECT ld::VARCHAR AS day, coalesce(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) FILTER ({FLOW}), 0)::DOUBLE AS net, count(*) AS n, count(*) FILTER (NOT ({FLOW})) AS not_counted FROM f WHERE ld IN (SELECT ld FROM p) GROUP BY 1",
)
def ledger_day_subtotals(spark, d):
    rows = with_buckets(S.transactions(spark, d)).withColumn("split_categories", F.array().cast("array<int>"))
    kept = rows.where(L.where(L.Filters(direction="debit", minimum=1000.0), rows.columns))
    return L.day_subtotals(kept, L.page(kept, _AFTER))


_NAMED = f"""{S.TX}, {S.ACCOUNTS}, {S.MERCHANTS}, {_CAT}, sc AS (SELECT transaction_id, list_sort(list(DISTINCT category_id)) AS cs FROM splits GROUP BY 1),
nm AS (SELECT tx.*, {S.cycle_sql(_LD)} AS cyc, {_LD} AS ld, coalesce(cycle_override, {S.cycle_sql(_LD)}) AS cs0, coalesce(sc.cs, []) AS scs, a.name AS account_name, c.name AS category_name, m.display_name FROM tx JOIN acc a ON a.id = tx.account_id LEFT JOIN sc ON sc.transaction_id = tx.id LEFT JOIN cat c ON c.id = tx.category_id LEFT JOIN mer m ON m.id = tx.merchant_id WHERE superseded_by IS NULL)"""
_UNCAT = "category_id IS NULL AND direction = 'debit' AND " + FLOW + " AND len(scs) = 0"
FILTERS = {
    "cycle": (L.Filters(grain="cycle", period=CYCLE), f"cs0 = DATE '{CYCLE}'"),
    "range": (L.Filters(first=dt.date(1997, 3, 1), last=dt.date(1997, 3, 31), grain="cycle", period=CYCLE), "ld BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'"),
    "category": (L.Filters(category_id=3), "(category_id = 3 OR list_contains(scs, 3))"),
    "no_category": (L.Filters(no_category=True), "category_id IS NULL AND len(scs) = 0"),
    "search": (L.Filters(search="urg_nt"), "false"),
    "search_name": (L.Filters(search="#00000000"), "(coalesce(merchant_raw ILIKE '%#00000000%', false) OR coalesce(biller ILIKE '%#00000000%', false) OR coalesce(display_name ILIKE '%#00000000%', false) OR coalesce(category_name ILIKE '%#00000000%', false) OR coalesce(account_name ILIKE '%#00000000%', false))"),
    "merchant": (L.Filters(merchant="1-urgent", direction="debit"), "lower(coalesce(merchant_raw, biller)) = '1-urgent' AND direction = 'debit'"),
    "amounts": (L.Filters(minimum=5000.0, maximum=9000.5, type="purchase"), "amount BETWEEN 5000 AND 9000.5 AND type = 'purchase'"),
    "internal_only": (L.Filters(internal="only"), "is_internal"),
    "internal_hidden": (L.Filters(internal="hide", account_id=7), "NOT is_internal AND account_id = 7"),
    "uncategorized": (L.Filters(uncategorized=True), _UNCAT),
    "low_confidence": (L.Filters(low_confidence=True), "confidence < 0.8 AND NOT is_reviewed"),
    "manual": (L.Filters(manual=True, direction="credit"), "origin = 'manual' AND direction = 'credit'"),
}


@query("ledger_filter_matrix", f"WITH {_NAMED} " + " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, coalesce(sum(amount), 0)::DOUBLE AS total FROM nm WHERE {sql}" for name, (_, sql) in FILTERS.items()))
def ledger_filter_matrix(spark, d):
    """Each filter over one scan: a row carries the names of the filters that let it through."""
    rows = _rows(spark, d)
    names = F.array_compact(F.array(*(F.when(L.where(f, rows.columns), F.lit(name)) for name, (f, _) in FILTERS.items())))
    found = rows.select("amount", F.explode(names).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    every = spark.createDataFrame([(name,) for name in FILTERS], "filter string")
    return every.join(found, "filter", "left").select("filter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).cast("double").alias("total"))


@query(
    "ledger_export_split_rows",
    f"WITH {S.TX}, {S.ACCOUNTS}, {_CAT}, r AS (SELECT tx.id, tx.posted_at, tx.account_id, tx.direction, tx.type, s.n AS split_n, CASE WHEN s.n IS NOT NULL THEN s.category_id ELSE tx.category_id END AS category_id, coalesce(s.amount, tx.amount) AS amount FROM tx LEFT JOIN splits s ON s.transaction_id = tx.id WHERE superseded_by IS NULL ORDER BY posted_at DESC, id DESC, s.n NULLS FIRST LIMIT 10000) SELECT r.id, split_n, strftime(posted_at + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS local_time, a.name AS account, c.name AS category, direction, type, amount::DOUBLE AS amount FROM r JOIN acc a ON a.id = r.account_id LEFT JOIN cat c ON c.id = r.category_id",
)
def ledger_export_split_rows(spark, d):
    return L.export_rows(S.transactions(spark, d), S.splits(spark, d), S.accounts(spark, d), S.categories(spark, d))


@query("facet_merchants", f"WITH {S.TX} SELECT coalesce(merchant_raw, biller) AS merchant, count(*) AS n FROM tx WHERE coalesce(merchant_raw, biller) IS NOT NULL AND superseded_by IS NULL GROUP BY 1 ORDER BY n DESC, merchant LIMIT 30")
def facet_merchants(spark, d):
    name = F.coalesce("merchant_raw", "biller")
    return S.transactions(spark, d).where(name.isNotNull() & F.col("superseded_by").isNull()).groupBy(name.alias("merchant")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "merchant").limit(30)


@query("category_tree", f"WITH {_CAT} SELECT c.id, c.name, p.name AS parent, c.is_income FROM cat c LEFT JOIN cat p ON p.id = c.parent_id")
def category_tree(spark, d):
    cats = S.categories(spark, d)
    return cats.join(cats.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("id", "name", "parent", "is_income")


@query(
    "transaction_detail",
    f"WITH {S.TX}, {S.ACCOUNTS}, {_CAT}, s AS (SELECT transaction_id, count(*) AS n FROM splits GROUP BY 1), b AS (SELECT account_id, posted_at::DATE AS day, count(*) AS n FROM tx GROUP BY 1, 2) SELECT tx.id, a.name AS account, c.name AS category, coalesce(s.n, 0) AS splits, b.n - 1 AS siblings FROM tx JOIN acc a ON a.id = tx.account_id LEFT JOIN cat c ON c.id = tx.category_id LEFT JOIN s ON s.transaction_id = tx.id JOIN b ON b.account_id = tx.account_id AND b.day = posted_at::DATE",
)
def transaction_detail(spark, d):
    """Every transaction with names, number of splits, and legs of its account on the same day."""
    tx = S.transactions(spark, d)
    split = S.splits(spark, d).groupBy(F.col("transaction_id").alias("id")).agg(F.count("*").alias("n_splits"))
    beside = tx.groupBy("account_id", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n_day"))
    rows = tx.withColumn("day", F.to_date("posted_at")).join(split, "id", "left").join(beside, ["account_id", "day"]).join(S.accounts(spark, d).select(F.col("id").alias("account_id"), F.col("name").alias("account")), "account_id").join(S.categories(spark, d).select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    return rows.select("id", "account", "category", F.coalesce("n_splits", F.lit(0)).alias("splits"), (F.col("n_day") - 1).alias("siblings"))


@query("period_transaction_lines", f"WITH {S.VIEW}, r AS (SELECT transaction_id, category_id, amount, posted_at, count(*) OVER (PARTITION BY transaction_id) AS n FROM v WHERE cycle_start = DATE '{CYCLE}') SELECT transaction_id, CASE WHEN n > 1 THEN 'Split' ELSE coalesce(category_id::VARCHAR, 'Uncategorized') END AS label, sum(amount)::DOUBLE AS amount FROM r GROUP BY ALL")
def period_transaction_lines(spark, d):
    """One line for each transaction of the cycle; several splits are one line called Split."""
    from tally.plans.spending import canonical

    rows = canonical(spark, d).where(F.col("cycle_start") == F.lit(CYCLE)).withColumn("parts", F.count("*").over(Window.partitionBy("transaction_id")))
    label = F.when(F.col("parts") > 1, "Split").otherwise(F.coalesce(F.col("category_id").cast("string"), F.lit("Uncategorized")))
    return rows.groupBy("transaction_id", label.alias("label")).agg(F.sum("amount").cast("double").alias("amount"))


RULES = [
    R.Rule(1, 10, (("merchant_raw", "starts_with", "1-ur"), ("direction", "equals", "DEBIT")), {"set_category": 4}),
    R.Rule(2, 5, (("biller", "contains", "LLER 3"),), {"set_category": None, "exclude_from_analytics": True}),
    R.Rule(3, 20, (("type", "equals", "purchase"),), {"mark_internal_transfer": True}),
]
_MATCH = {1: "coalesce(merchant_raw ILIKE '1-ur%', false) AND direction = 'debit'", 2: "coalesce(biller ILIKE '%LLER 3%', false)", 3: "type = 'purchase'"}
_CHANGE = {1: "category_id IS DISTINCT FROM 4", 2: "(category_id IS NOT NULL OR NOT excluded)", 3: "NOT is_internal"}
_LOCK = {1: "list_contains(locked_fields, 'category_id')", 2: "(list_contains(locked_fields, 'category_id') OR list_contains(locked_fields, 'excluded'))", 3: "list_contains(locked_fields, 'is_internal')"}


@query("rule_preview_counts", f"WITH {S.TX} " + " UNION ALL ".join(f"SELECT {r} AS rule_id, count(*) AS matched, count(*) FILTER ({_CHANGE[r]} AND NOT {_LOCK[r]}) AS would_change, count(*) FILTER ({_LOCK[r]}) AS locked, count(*) FILTER (NOT ({_CHANGE[r]}) AND NOT {_LOCK[r]}) AS unchanged FROM tx WHERE superseded_by IS NULL AND {_MATCH[r]}" for r in (1, 2, 3)))
def rule_preview_counts(spark, d):
    tx = S.transactions(spark, d).withColumn("description", F.lit(None).cast("string"))
    out = None
    for rule in RULES:
        one = R.preview(tx, rule).select(F.lit(rule.id).alias("rule_id"), "*")
        out = one if out is None else out.union(one)
    return out


@query("rule_apply", f"WITH {S.TX} SELECT id, CASE WHEN h THEN 4 ELSE category_id END AS category_id, CASE WHEN h THEN 1 END AS matched_rule_id FROM (SELECT *, superseded_by IS NULL AND {_MATCH[1]} AND {_CHANGE[1]} AND NOT {_LOCK[1]} AS h FROM tx)")
def rule_apply(spark, d):
    return R.applied(S.transactions(spark, d), RULES[0]).select("id", "category_id", "matched_rule_id")


@query("rule_first_match", f"WITH {S.TX}, r AS (SELECT CASE WHEN superseded_by IS NULL AND {_MATCH[2]} THEN 2 WHEN superseded_by IS NULL AND {_MATCH[1]} THEN 1 WHEN superseded_by IS NULL AND {_MATCH[3]} THEN 3 END AS rule_id FROM tx) SELECT rule_id, count(*) AS n FROM r GROUP BY 1")
def rule_first_match(spark, d):
    return R.first_match(S.transactions(spark, d), RULES).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "replay_diff",
    f"""WITH {S.TX}, st AS (SELECT id AS raw_id, id, account_id, direction, origin, locked_fields, posted_at, amount, merchant_raw, category_id FROM tx WHERE id % 31 <> 0), lg AS (SELECT id AS raw_id, account_id, direction, CASE WHEN id % 29 = 0 THEN 'ignored' ELSE 'parsed' END AS ms, CASE WHEN id % 10 = 1 THEN CAST(amount + 1 AS DECIMAL(14,2)) ELSE amount END AS amount, CASE WHEN id % 15 = 2 THEN 'shop' ELSE merchant_raw END AS merchant_raw, CASE WHEN id % 8 = 4 THEN NULL ELSE category_id END AS category_id FROM tx),
j AS (SELECT lg.*, st.id, CASE WHEN ms = 'ignored' THEN 'deleted' WHEN st.id IS NULL THEN 'no-transaction' WHEN st.origin = 'manual' THEN 'manual' WHEN st.posted_at >= TIMESTAMP '2000-01-01' THEN 'out-of-scope' END AS skip, coalesce(locked_fields, []) AS lk,
 list_filter([CASE WHEN lg.amount IS DISTINCT FROM st.amount THEN 'amount:' || coalesce(st.amount::VARCHAR, '-') || ':' || coalesce(lg.amount::VARCHAR, '-') END, CASE WHEN lg.merchant_raw IS DISTINCT FROM st.merchant_raw THEN 'merchant_raw:' || coalesce(st.merchant_raw, '-') || ':' || coalesce(lg.merchant_raw, '-') END, CASE WHEN lg.category_id IS DISTINCT FROM st.category_id THEN 'category_id:' || coalesce(st.category_id::VARCHAR, '-') || ':' || coalesce(lg.category_id::VARCHAR, '-') END], lambda x: x IS NOT NULL) AS df FROM lg LEFT JOIN st ON st.raw_id = lg.raw_id AND st.account_id = lg.account_id AND st.direction = lg.direction),
k AS (SELECT *, list_filter(df, lambda x: NOT list_contains(lk, split_part(x, ':', 1))) AS ch, list_filter(df, lambda x: list_contains(lk, split_part(x, ':', 1))) AS bl FROM j)
SELECT raw_id, coalesce(skip, CASE WHEN len(df) > 0 THEN 'changed' ELSE 'unchanged' END) AS outcome, CASE WHEN skip IS NULL THEN array_to_string(ch, ' ') ELSE '' END AS changes, CASE WHEN skip IS NULL THEN array_to_string(bl, ' ') ELSE '' END AS blocked FROM k""",
)
def replay_diff(spark, d):
    tx = S.transactions(spark, d)
    stored = tx.where("id % 31 <> 0").withColumn("raw_id", F.col("id"))
    k = F.col("id")
    legs = tx.select(k.alias("raw_id"), "account_id", "direction", F.when(k % 29 == 0, "ignored").otherwise("parsed").alias("message_status"), F.when(k % 10 == 1, (F.col("amount") + 1).cast("decimal(14,2)")).otherwise(F.col("amount")).alias("amount"), F.when(k % 15 == 2, "shop").otherwise(F.col("merchant_raw")).alias("merchant_raw"), F.when(k % 8 != 4, F.col("category_id")).alias("category_id"))
    rows = R.replayed(legs, stored, ["amount", "merchant_raw", "category_id"], F.col("posted_at") < F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz"))
    return rows.select("raw_id", "outcome", F.array_join("changes", " ").alias("changes"), F.array_join("blocked", " ").alias("blocked"))


@query(
    "account_edit_adjustments",
    f"WITH {S.ACCOUNTS}, e AS (SELECT id, opening_balance AS cur, CASE WHEN id % 3 = 0 THEN opening_balance + 10 WHEN id % 3 = 1 THEN opening_balance - 2.5 ELSE opening_balance END AS st FROM acc) SELECT id AS account_id, 'adjustment' AS type, CASE WHEN st > cur THEN 'credit' ELSE 'debit' END AS direction, abs(st - cur)::DOUBLE AS amount, 'manual' AS origin, true AS excluded FROM e WHERE st <> cur",
)
def account_edit_adjustments(spark, d):
    rows = S.accounts(spark, d)
    stated = F.when(F.col("id") % 3 == 0, F.col("opening_balance") + 10).when(F.col("id") % 3 == 1, F.col("opening_balance") - F.lit("2.5").cast("decimal(3,1)")).otherwise(F.col("opening_balance"))
    return R.adjustment_legs(rows.select("id", F.col("opening_balance").alias("current_balance"), stated.alias("stated_balance"))).withColumn("amount", F.col("amount").cast("double"))


@query("lock_union", f"WITH {S.TX} SELECT id, array_to_string(list_sort(list_distinct(list_concat(locked_fields, ['amount', 'notes']))), ',') AS locks, array_to_string(list_sort(list_filter(locked_fields, lambda x: x <> 'amount')), ',') AS without_amount FROM tx WHERE len(locked_fields) > 0")
def lock_union(spark, d):
    """Locks after an edit of two fields, and after one is unlocked."""
    rows = S.transactions(spark, d).where(F.size("locked_fields") > 0)
    return rows.select("id", F.array_join(F.array_sort(F.array_union("locked_fields", F.array(F.lit("amount"), F.lit("notes")))), ",").alias("locks"), F.array_join(F.array_sort(F.array_remove("locked_fields", "amount")), ",").alias("without_amount"))


@query("rows_as_json", "SELECT n_regionkey AS region, count(*) AS n, string_agg('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1")
def rows_as_json(spark, d):
    rows = S.table(spark, d, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("r"))
    return rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.to_json(r)), ",").alias("rows"))


_JSON = [
    '{"match": [{"field": "merchant_raw", "operator": "equals", "value": "x"}], "actions": {"set_category": "4"}}',
    '{"match": [{"field": "merchant_raw", "operator": "like", "value": "x"}], "actions": {"set_category": "4"}}',
    '{"match": [], "actions": {"set_category": "4"}}',
    '{"match": [{"field": "biller", "operator": "contains", "value": "y"}], "actions": {"explode": "1"}}',
    '{"match": [{"field": "biller", "operator": "contains"}], "actions": {"set_merchant": "1"}}',
    "not a rule",
    '{"match": [{"field": "type", "operator": "starts_with", "value": "f"}, {"field": "direction", "operator": "equals", "value": "debit"}], "actions": {"set_merchant": "2", "explode": "1"}}',
]


@query("stored_rules", "SELECT n_nationkey AS id, n_nationkey % 7 IN (0, 6) AS valid, CASE n_nationkey % 7 WHEN 0 THEN 1 WHEN 6 THEN 2 END::INTEGER AS conditions FROM nation")
def stored_rules(spark, d):
    """Rules as they are stored, each nation's one of seven, five of them malformed in a way of their own."""
    rows = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.get(F.array(*map(F.lit, _JSON)), (F.col("n_nationkey") % 7).cast("int")).alias("rule"))
    return R.stored_rules(rows).select("id", "valid", F.when(F.col("valid"), F.size("match")).alias("conditions"))


@query("split_violations", f"WITH {S.TX}, s AS (SELECT transaction_id, sum(amount) + CASE WHEN transaction_id % 4 = 1 THEN 1 ELSE 0 END AS parts FROM splits GROUP BY 1) SELECT id, (amount - parts)::DOUBLE AS remainder FROM tx JOIN s ON s.transaction_id = tx.id WHERE parts <> amount")
def split_violations(spark, d):
    """Transactions whose splits don't add up to them, and by how much."""
    parts = S.splits(spark, d).groupBy(F.col("transaction_id").alias("id")).agg((F.sum("amount") + F.when(F.col("transaction_id") % 4 == 1, 1).otherwise(0)).alias("parts"))
    return S.transactions(spark, d).join(parts, "id").where("parts <> amount").select("id", (F.col("amount") - F.col("parts")).cast("double").alias("remainder"))
