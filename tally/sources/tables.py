"""The driver's tables as ledger tables: orders are transactions, customers accounts, nations categories, events messages.

Each projection has a DuckDB twin in SQL, so that one text says what a query's oracle reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.functions import periods
from tally.schemas import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


CREDIT_TYPES = ["income", "profit", "transfer", "refund", "income"]
DEBIT_TYPES = ["purchase", "purchase", "bill_payment", "withdrawal", "card_payment", "loan_payment", "fee", "transfer"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    posted = F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))
    kind = F.when(k % 89 == 0, "adjustment").when(k % 5 == 0, _pick(F.floor(k / 5) % 5, CREDIT_TYPES)).otherwise(_pick(k % 8, DEBIT_TYPES))
    rows = rows.withColumns({"posted_at": posted, "type": kind})
    return rows.select(
        k.alias("id"),
        F.col("o_custkey").alias("account_id"),
        "posted_at",
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(k % 5 == 0, "credit").otherwise("debit").alias("direction"),
        "type",
        F.when(k % 97 == 0, "declined").when((F.col("o_orderstatus") == "P") & (k % 13 == 0), "pending").otherwise("posted").alias("state"),
        (k % 11 == 0).alias("is_internal"),
        (k % 53 == 0).alias("excluded"),
        F.when(k % 101 == 0, k - 1).alias("superseded_by"),
        F.when(k % 7 != 0, k % 25).cast("int").alias("category_id"),
        F.when(k % 6 != 5, F.col("o_orderpriority")).alias("merchant_raw"),
        F.when(F.col("type") == "bill_payment", F.concat(F.lit("biller "), (k % 6).cast("string"))).alias("biller"),
        F.when(k % 4 == 0, k % 10 + 1).alias("merchant_id"),
        F.when((F.col("type") == "income") & (k % 35 == 0), F.add_months(periods.period_start(periods.local_date("posted_at")), 1)).alias("cycle_override"),
        F.when(k % 9 == 0, "manual").otherwise("parsed").alias("origin"),
        F.when(k % 19 == 0, F.array(F.lit("category_id"))).when(k % 23 == 0, F.array(F.lit("amount"), F.lit("merchant_raw"))).otherwise(F.array().cast("array<string>")).alias("locked_fields"),
        F.when(k % 3 == 0, (k % 100 / F.lit(100)).cast("decimal(4,3)")).alias("confidence"),
        (k % 2 == 0).alias("is_reviewed"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of each tenth transaction; the second is the exact rest."""
    tx = transactions(spark, sf_dir).where(F.col("id") % 10 == 3).select("id", "amount")
    first = (F.floor(F.col("amount") * 60) / 100).cast(MONEY)
    legs = F.array(F.struct(F.lit(1).alias("n"), (F.col("id") % 25).cast("int").alias("category_id"), first.alias("amount")), F.struct(F.lit(2).alias("n"), ((F.col("id") + 7) % 25).cast("int").alias("category_id"), (F.col("amount") - first).cast(MONEY).alias("amount")))
    return tx.select(F.col("id").alias("transaction_id"), F.explode(legs).alias("s")).select("transaction_id", "s.n", "s.category_id", "s.amount")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("institution"),
        (k % 4 == 0).alias("is_liability"),
        F.when(k % 8 == 0, "available_credit").otherwise("balance").alias("balance_semantics"),
        F.when(k % 8 == 0, F.lit(20000)).cast(MONEY).alias("credit_limit"),
        F.col("c_acctbal").cast(MONEY).alias("opening_balance"),
        (k % 3 == 0).alias("is_profit_bearing"),
        (k % 5 != 0).alias("reconcilable"),
        (k % 17 != 0).alias("is_active"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are the parents of nations; ids of parents start at 100."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).alias("parent_id"), (F.col("n_nationkey") % 8 == 0).alias("is_income"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"), F.lit(False).alias("is_income"))
    return nations.unionByName(regions)


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("display_name"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bank reported with the last leg of each account and month: the derived balance plus a drift by key."""
    tx = transactions(spark, sf_dir).where("state = 'posted' AND superseded_by IS NULL").select("id", "account_id", "posted_at", "amount", "direction")
    tx = tx.join(accounts(spark, sf_dir).select(F.col("id").alias("account_id"), "opening_balance"), "account_id")
    run = Window.partitionBy("account_id").orderBy("posted_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("account_id", F.trunc("posted_at", "month")).orderBy(F.col("posted_at").desc(), F.col("id").desc())
    drift = F.when(F.col("id") % 7 == 0, F.lit("12.34")).when(F.col("id") % 5 == 0, F.lit("0.01")).otherwise(F.lit("0")).cast(MONEY)
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    rows = tx.withColumns({"moved": F.sum(signed).over(run), "rn": F.row_number().over(last)})
    return rows.where("rn = 1").select("account_id", (F.col("opening_balance") + F.col("moved") + drift).cast(MONEY).alias("balance"), F.when(F.col("id") % 6 == 0, "manual").otherwise("sms").alias("source"), F.col("posted_at").alias("as_of"), "id")


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for four of five categories in each cycle of 1997; every third one is already settled."""
    months = spark.range(1, 13).select(F.make_date(F.lit(1997), F.col("id").cast("int"), F.lit(25)).alias("cycle_start"))
    cats = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("category_id"))
    rows = cats.crossJoin(months)
    base = (F.lit(20000) + F.col("category_id") * 1000).cast(MONEY)
    return rows.select("category_id", "cycle_start", base.alias("amount"), (F.col("category_id") % 2 == 0).alias("rollover"), (F.col("category_id") * 10 - 100).cast(MONEY).alias("carry_in"), F.when((F.col("category_id") + F.month("cycle_start")) % 3 == 0, F.col("cycle_start")).alias("carry_closed_at"))


def _array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LOCAL = "CAST({0} + INTERVAL 3 HOUR AS DATE)"


def cycle_sql(d: str) -> str:
    return f"(CASE WHEN day({d}) >= 25 THEN date_trunc('month', {d})::DATE + 24 ELSE (date_trunc('month', {d}) - INTERVAL 1 MONTH)::DATE + 24 END)"


def week_sql(d: str) -> str:
    return f"(date_trunc('week', {d} + 1)::DATE - 1)"


TX = f"""
tx0 AS (SELECT *, o_orderkey AS k, o_orderdate + to_hours(o_orderkey % 24) AS posted_at,
    CASE WHEN o_orderkey % 89 = 0 THEN 'adjustment' WHEN o_orderkey % 5 = 0 THEN {_array(CREDIT_TYPES)}[(o_orderkey // 5) % 5 + 1] ELSE {_array(DEBIT_TYPES)}[o_orderkey % 8 + 1] END AS type FROM orders),
tx AS (SELECT k AS id, o_custkey AS account_id, posted_at, CAST(o_totalprice AS DECIMAL(14,2)) AS amount, CASE WHEN k % 5 = 0 THEN 'credit' ELSE 'debit' END AS direction, type,
    CASE WHEN k % 97 = 0 THEN 'declined' WHEN o_orderstatus = 'P' AND k % 13 = 0 THEN 'pending' ELSE 'posted' END AS state, k % 11 = 0 AS is_internal, k % 53 = 0 AS excluded,
    CASE WHEN k % 101 = 0 THEN k - 1 END AS superseded_by, CAST(CASE WHEN k % 7 <> 0 THEN k % 25 END AS INTEGER) AS category_id, CASE WHEN k % 6 <> 5 THEN o_orderpriority END AS merchant_raw,
    CASE WHEN type = 'bill_payment' THEN 'biller ' || (k % 6) END AS biller, CASE WHEN k % 4 = 0 THEN k % 10 + 1 END AS merchant_id,
    CASE WHEN type = 'income' AND k % 35 = 0 THEN ({cycle_sql(LOCAL.format('posted_at'))} + INTERVAL 1 MONTH)::DATE END AS cycle_override,
    CASE WHEN k % 9 = 0 THEN 'manual' ELSE 'parsed' END AS origin, CASE WHEN k % 19 = 0 THEN ['category_id'] WHEN k % 23 = 0 THEN ['amount', 'merchant_raw'] ELSE [] END AS locked_fields,
    CASE WHEN k % 3 = 0 THEN CAST(k % 100 / 100 AS DECIMAL(4,3)) END AS confidence, k % 2 = 0 AS is_reviewed FROM tx0),
splits AS (SELECT id AS transaction_id, 1 AS n, CAST(id % 25 AS INTEGER) AS category_id, CAST(floor(amount * 60) / 100 AS DECIMAL(14,2)) AS amount FROM tx WHERE id % 10 = 3
    UNION ALL SELECT id, 2, CAST((id + 7) % 25 AS INTEGER), CAST(amount - CAST(floor(amount * 60) / 100 AS DECIMAL(14,2)) AS DECIMAL(14,2)) FROM tx WHERE id % 10 = 3)"""

_V = f"t.account_id, t.posted_at, t.direction, t.type, t.state, t.merchant_id, t.is_internal, t.excluded, coalesce(t.cycle_override, {cycle_sql(LOCAL.format('t.posted_at'))}) AS cycle_start, {week_sql(LOCAL.format('t.posted_at'))} AS week_start, {LOCAL.format('t.posted_at')} AS local_day"
VIEW = f"""{TX},
v AS (SELECT t.id AS transaction_id, s.n AS split_n, s.category_id, s.amount, true AS is_split, {_V} FROM tx t JOIN splits s ON s.transaction_id = t.id WHERE t.superseded_by IS NULL
    UNION ALL SELECT t.id, NULL, t.category_id, t.amount, false, {_V} FROM tx t WHERE t.superseded_by IS NULL AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.transaction_id = t.id))"""

ACCOUNTS = """
acc AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS institution, c_custkey % 4 = 0 AS is_liability, CASE WHEN c_custkey % 8 = 0 THEN 'available_credit' ELSE 'balance' END AS balance_semantics,
    CASE WHEN c_custkey % 8 = 0 THEN CAST(20000 AS DECIMAL(14,2)) END AS credit_limit, CAST(c_acctbal AS DECIMAL(14,2)) AS opening_balance, c_custkey % 3 = 0 AS is_profit_bearing, c_custkey % 5 <> 0 AS reconcilable, c_custkey % 17 <> 0 AS is_active FROM customer)"""

MERCHANTS = "mer AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS display_name FROM supplier)"

SNAPSHOTS = """
snap AS (SELECT account_id, CAST(opening_balance + moved + CASE WHEN id % 7 = 0 THEN 12.34 WHEN id % 5 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(14,2)) AS balance, CASE WHEN id % 6 = 0 THEN 'manual' ELSE 'sms' END AS source, posted_at AS as_of, id
    FROM (SELECT t.id, t.account_id, t.posted_at, a.opening_balance, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY t.account_id ORDER BY posted_at, t.id) AS moved,
            row_number() OVER (PARTITION BY t.account_id, date_trunc('month', posted_at) ORDER BY posted_at DESC, t.id DESC) AS rn
          FROM tx t JOIN acc a ON a.id = t.account_id WHERE state = 'posted' AND superseded_by IS NULL) WHERE rn = 1)"""

BUDGETS = """
bud AS (SELECT n_nationkey AS category_id, make_date(1997, m::INTEGER, 25) AS cycle_start, CAST(20000 + n_nationkey * 1000 AS DECIMAL(14,2)) AS amount, n_nationkey % 2 = 0 AS rollover, CAST(n_nationkey * 10 - 100 AS DECIMAL(14,2)) AS carry_in,
    CASE WHEN (n_nationkey + m) % 3 = 0 THEN make_date(1997, m::INTEGER, 25) END AS carry_closed_at FROM nation, range(1, 13) t(m) WHERE n_nationkey % 5 <> 4)"""
