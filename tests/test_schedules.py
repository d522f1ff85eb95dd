"""Loans are dealt over tasks, and a schedule ends where its payments end, whatever its formula says."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tally.operators import savings
from tally.plans import saving
from tests.conftest import SMALL


def test_loans_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(saving, "LOANS_A_TASK", 5)
    assert saving.loans(spark, SMALL).rdd.getNumPartitions() > 3


def test_schedules_are_whole(spark):
    """Rates of nothing, next to nothing and much, payments that barely cover the interest."""
    rng = random.Random(5)
    rows = [(k, rng.choice([0.01, 10.0, 1000.0, 123456.78]), rng.choice([0.0, 1e-18, 1e-9, 0.001, 0.05, 1.0]), 0.0) for k in range(200)]
    rows = [(k, b, r, b * r + rng.choice([0.011, 0.02, 1.0, b / 599.5, b / 3, b])) for k, b, r, _ in rows]
    made = spark.createDataFrame(rows, "id long, b double, r double, p double").select("id", F.transform(savings.schedule(F.col("b"), F.col("r"), F.col("p")), lambda x: x["balance"]).alias("left"))
    found = {x.id: list(x.left) for x in made.collect()}
    for k, b, r, p in rows:
        left, out = b, []
        while p > b * r + 0.01 and left > 0.005 and len(out) < 600:
            left = max(0.0, left - (min(p, left + left * r) - left * r))
            out.append(left)
        assert found[k] == out
