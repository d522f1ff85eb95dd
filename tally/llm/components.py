"""Connected components over links between integer nodes, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import gathered, settled


def _centres(pairs: DataFrame, rows: int) -> DataFrame:
    """For each u its smallest neighbour or itself; aggregates before the shuffle, so a hub is one row a task.

    Written before it is joined: a join of two plain shuffles is one whose skewed partitions, a hub's, can be split.
    """
    return settled(gathered(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), rows))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    both = gathered(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
    found = gathered(both.join(_centres(both, rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows)
    return settled(gathered(found.distinct(), rows))


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = gathered(down.join(_centres(down, rows), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v"), rows)
    return settled(gathered(found.distinct(), rows))


def _rows_and_loose(links: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes still keep them from being stars around their smallest nodes: those with two links down, or links both ways."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    found = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()
    return found[0], found[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v): root is the smallest node reachable. Runs until all links are stars.

    Null ends and self links are dropped; an empty input gives an empty output. Steps over few links take few tasks.
    """
    links = settled(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        rows, loose = _rows_and_loose(links)
        if not loose:
            break
        links = _small_star(_large_star(gathered(links, rows), rows), rows)
    links = gathered(links, rows)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
