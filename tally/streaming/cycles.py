"""Totals by salary cycle over a stream of legs: told once a cycle is over and late legs had their time, amended when later ones come."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.functions import periods
from tally.operators import predicates as P
from tally.operators.lineage import settled
from tally.operators.metrics import text
from tally.streaming.ingest import _dropped, _stored

_MONEY = "expense decimal(38,2), earned decimal(38,2), passive decimal(38,2), legs long"
OPEN, TOLD, CLOCK = f"cycle_start date, {_MONEY}", f"cycle_start date, {_MONEY}, amends boolean", "newest date"
#: Days after a cycle's last day during which its legs still count before it is told.
LATE_DAYS = 7


def _summed(rows: DataFrame) -> DataFrame:
    """Rows of OPEN, one a cycle."""
    return rows.groupBy("cycle_start").agg(*(F.sum(c).cast("decimal(38,2)").alias(c) for c in ("expense", "earned", "passive")), F.sum("legs").alias("legs"))


def cycle_sums(rows: DataFrame) -> DataFrame:
    """The rows of the canonical relation added up by cycle: a few rows, whatever the batch holds."""
    amount = lambda when: F.sum(F.when(when, F.col("amount")).otherwise(0)).cast("decimal(38,2)")
    return rows.groupBy("cycle_start").agg(amount(P.is_expense()).alias("expense"), amount(P.is_earned()).alias("earned"), amount(P.is_passive()).alias("passive"), F.count("*").alias("legs"), F.max("local_day").alias("newest"))


def write_cycles(path: str, late_days: int = LATE_DAYS) -> Callable[[DataFrame, int], None]:
    """Writes for each batch, a folder each under path, so that a repeat of the batch replaces them:

    open, the sums of cycles that still run or wait for late legs; told, the sums of those that are over; and late, the
    legs of cycles told before, for review, which also amend what was told. A cycle has no fixed length, so no window
    of the engine is one, and a watermark drops what comes too late; here the clock is the newest local day of all
    batches before. A batch reads the open sums and the clock that the one before left: 24 months take 24 rows.
    A leg without a day or a cycle is in late and in no sum.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dated = F.col("local_day").isNotNull() & F.col("cycle_start").isNotNull()
        before = _stored(spark, f"{path}/clock/batch={number - 1}", CLOCK).agg(F.max("newest")).first()[0]
        sums = settled(cycle_sums(batch.where(dated)))
        newest = max((d for d in (before, sums.agg(F.max("newest")).first()[0]) if d is not None), default=None)
        over = lambda day: F.lit(False) if day is None else periods.period_end("cycle_start") < F.lit(day - dt.timedelta(days=late_days))
        sums = sums.drop("newest")
        running = settled(_summed(_stored(spark, f"{path}/open/batch={number - 1}", OPEN).unionByName(sums.where(~over(before)))))
        told = running.where(over(newest)).withColumn("amends", F.lit(False)).unionByName(sums.where(over(before)).withColumn("amends", F.lit(True)))
        for name, rows in (("told", told), ("late", batch.where(~dated | over(before))), ("open", running.where(~over(newest))), ("clock", spark.createDataFrame([(newest,)], CLOCK))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        for name in ("open", "clock"):
            _dropped(spark, f"{path}/{name}/batch={number - 2}")

    return write


def run(rows: DataFrame, path: str, checkpoint: str, once: bool = False, late_days: int = LATE_DAYS) -> StreamingQuery:
    """Starts the totals over a stream of rows of the canonical relation, each minute or (once) for what is there."""
    writer = rows.writeStream.foreachBatch(write_cycles(path, late_days)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def _whole(spark: SparkSession, path: str) -> int:
    """The last batch that is written whole: its clock comes last."""
    last = _stored(spark, f"{path}/clock", f"{CLOCK}, batch int").agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def told_cycles(spark: SparkSession, path: str) -> DataFrame:
    """What was told of each cycle with its amendments, and how many legs came late."""
    told = _stored(spark, f"{path}/told", f"{TOLD}, batch int").where(F.col("batch") <= _whole(spark, path))
    late = told.groupBy("cycle_start").agg(F.sum(F.when(F.col("amends"), F.col("legs")).otherwise(0)).alias("late_legs"))
    return _summed(told).join(late, "cycle_start")


def flow_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, earned, passive, expense) of all legs taken: what was told, amended, and is still open; as metrics.flow_by_bucket."""
    columns = ["cycle_start", "expense", "earned", "passive", "legs"]
    opened = _stored(spark, f"{path}/open", f"{OPEN}, batch int").where(F.col("batch") == _whole(spark, path))
    sums = _summed(told_cycles(spark, path).select(*columns).unionByName(opened.select(*columns)))
    return sums.select(text("cycle_start").alias("bucket"), *(F.col(c).cast("double").alias(c) for c in ("earned", "passive", "expense")))
