"""Where intermediate rows are written: the checkpoint folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or one of our own where driver and executors are one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tally-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out once a row.

    The planner may put a column's expression wherever the column is named, so that one named ten times is worked out ten times;
    it does not look through the rows of an array.
    """
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))
