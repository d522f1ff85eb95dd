"""Components over few links: what they are, and in how few tasks."""

from __future__ import annotations

import random
import uuid

import pytest
from tally.llm.components import components


def _plain(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "empty"])
def test_roots_are_the_smallest_nodes_reachable(spark, kind):
    dice = random.Random(5)
    links = {"chain": [(k, k + 1) for k in range(200)], "hub": [(7, k) for k in range(300) if k != 7], "random": [tuple(dice.sample(range(400), 2)) for _ in range(300)], "empty": []}[kind]
    found = [tuple(r) for r in components(spark.createDataFrame([*links, (5, 5), (None, 3)] if links else [], "u long, v long")).collect()]
    assert dict(found) == _plain(links) and len(found) == len(dict(found))


def test_a_few_links_take_a_few_tasks(spark):
    """before, each step of each round was as many tasks as shuffles have partitions, which a driver keeps in memory."""
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    group = f"components-{uuid.uuid4().hex}"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, "components")
        assert components(spark.range(1, 500).selectExpr("id AS u", "id - id % 7 AS v")).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    told = spark.sparkContext.statusTracker()
    stages = {s for job in told.getJobIdsForGroup(group) for s in told.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := told.getStageInfo(s)))
    assert 0 < tasks < 1000, tasks
