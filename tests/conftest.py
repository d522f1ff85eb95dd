from __future__ import annotations

import decimal
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = Path(SMALL, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{float(v):.6g}" if isinstance(v, float | decimal.Decimal) else str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Holds a query's rows against those of its SQL."""

    def hold(query, sql):
        found = query(spark, SMALL)
        names = sorted(found.columns)
        cursor = duck.execute(sql)
        theirs = [c[0] for c in cursor.description]
        assert sorted(theirs) == names
        ours = sorted(tuple(_plain(r[n]) for n in names) for r in found.collect())
        assert ours == sorted(tuple(_plain(r[theirs.index(n)]) for n in names) for r in cursor.fetchall())

    return hold
