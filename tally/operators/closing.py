"""Closing a budget's cycle into stored carries, once: whoever comes second finds it closed."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions import periods
from tally.operators import budgets as B

CARRIES = "category_id int, amount decimal(14,2), rollover boolean, carry_in decimal(14,2), carry_closed_at timestamp"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _moved_once(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder to where none is yet; False if one is. The file system decides, so of two at once one is told False."""
    files, source_at = _path(spark, source)
    jvm, context = spark._jvm, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    target_at = files.makeQualified(jvm.org.apache.hadoop.fs.Path(target))
    try:
        context.rename(files.makeQualified(source_at), target_at, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception:
        if not files.exists(target_at):
            raise
        files.delete(source_at, True)
        return False
    return True


def carries(spark: SparkSession, path: str) -> DataFrame:
    """All carries closed so far under path: those columns and cycle_start, the cycle that they go into."""
    files, at = _path(spark, path)
    closed = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("cycle_start=")] if files.exists(at) else []
    if not closed:
        return spark.createDataFrame([], f"{CARRIES}, cycle_start date")
    return spark.read.schema(f"{CARRIES}, cycle_start date").option("basePath", path).parquet(*[p.toString() for p in closed])


def with_carries(budgets: DataFrame, stored: DataFrame) -> DataFrame:
    """budgets (category_id, cycle_start, amount, rollover, carry_in, carry_closed_at) with what was carried into them.

    A carry into a cycle that has no budget makes one of the closed cycle's amount; a budget that says itself that its
    carry was closed keeps its own.
    """
    into = stored.select("category_id", "cycle_start", F.struct("amount", "rollover", "carry_in", "carry_closed_at").alias("__in"))
    both = budgets.join(into, ["category_id", "cycle_start"], "full")
    taken = F.col("__in").isNotNull() & F.col("carry_closed_at").isNull()
    own: dict[str, Column] = {c: F.coalesce(c, f"__in.{c}") for c in ("amount", "rollover")}
    return both.withColumns(own | {c: F.when(taken, F.col(f"__in.{c}")).otherwise(F.col(c)) for c in ("carry_in", "carry_closed_at")}).select(*budgets.columns)


def close_cycle(budgets: DataFrame, view: DataFrame, cycle: dt.date, now: dt.datetime, path: str) -> bool:
    """Closes one ended cycle into the next under path; False if that was done before, whatever this call would have written.

    budgets are the rows without stored carries; what is stored now counts in, so a carry goes on into the next one. The
    carries of a cycle are one folder that appears at once: a call that dies before leaves none, and nothing that is
    closed is ever written again. A cycle that has not ended is refused; one without budgets is closed without rows.
    """
    spark = budgets.sparkSession
    ends = budgets.sparkSession.range(1).select(periods.period_end(F.lit(cycle)).alias("e"), F.add_months(F.lit(cycle), 1).alias("n")).first()
    if now.date() <= ends["e"]:
        raise ValueError(f"the cycle of {cycle} ends on {ends['e']}")
    current = with_carries(budgets, carries(spark, path)).where(F.col("cycle_start") == F.lit(cycle))
    spent = current.join(B.spend(view), ["cycle_start", "category_id"], "left")
    carry = B.carry_forward(F.col("amount"), F.coalesce("carry_in", F.lit(0)), F.coalesce("spent", F.lit(0)), F.col("rollover"))
    rows = spent.select(F.col("category_id").cast("int").alias("category_id"), F.col("amount").cast("decimal(14,2)").alias("amount"), "rollover", carry.cast("decimal(14,2)").alias("carry_in"), F.lit(now).alias("carry_closed_at"))
    rows.write.parquet(draft := f"{path}/_closing-{uuid.uuid4().hex}")
    return _moved_once(spark, draft, f"{path}/cycle_start={ends['n']}")
