"""How the shards of op12 lie in their files."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tally.llm import phrases


def test_a_file_of_many_shards_is_read_a_few_at_a_time(spark):
    """before, a task's shards were one row group of any size up to a hundred rows, and a reader held all of it."""
    docs = spark.range(0, 60, 1, 1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(k, "id"), F.lit(7919)))), " ").alias("text"), F.lit("en").alias("lang"))
    path = phrases._written(phrases.shards(docs, "text", "lang", 100_000), "shards")
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(path.removeprefix("file:") + "/*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60
    assert max(g.num_rows for g in groups) < 50 and max(g.total_byte_size for g in groups) < 5 * phrases.GROUP_BYTES
