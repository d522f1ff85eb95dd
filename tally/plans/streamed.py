"""Queries whose rows come in as a stream."""

from __future__ import annotations

import uuid

from tally.operators.lineage import shared_folder
from tally.plans.registry import query
from tally.plans.spending import _flow_sql, canonical
from tally.streaming import cycles

#: Batches that the rows arrive in.
BATCHES = 4


@query("streamed_cycle_flow", _flow_sql("cycle_start"))
def streamed_cycle_flow(spark, d):
    """Income and expense per salary cycle, taken batch by batch: cycles are told as they end, and amended by legs that come after.

    Files hold spans of time but arrive as their writers end, so that legs are out of order. The sums equal flow_by_cycle's.
    """
    folder = f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}"
    parts = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    canonical(spark, d).repartitionByRange(parts, "posted_at").write.parquet(f"{folder}/in")
    files = spark.read.parquet(f"{folder}/in")
    rows = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-parts // BATCHES)).parquet(f"{folder}/in")
    cycles.run(rows, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return cycles.flow_so_far(spark, f"{folder}/out")
