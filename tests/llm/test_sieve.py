"""Bit maps that keep rows from a shuffle, and the shuffles of op6."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tally.llm import common, substrings


@pytest.mark.parametrize("words", [common.SIEVE_WORDS, 16])
def test_a_sieve_loses_no_row_and_parts_all(spark, words, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    marked = common.sieve(rows.where("id % 10 = 0"), "h", 500)
    passed, rest = ({r["id"] for r in common.sifted(rows, "h", marked, others).collect()} for others in (False, True))
    assert passed >= set(range(0, 5000, 10)) and not passed & rest and len(passed) + len(rest) == 5000
    assert words == 16 or len(passed) < 1200


def test_an_empty_sieve_lets_nothing_pass(spark):
    rows = spark.range(50).select("id", F.xxhash64("id").alias("h"))
    marked = common.sieve(rows.limit(0), "h", 0)
    assert common.sifted(rows, "h", marked).count() == 0 and common.sifted(rows, "h", marked, others=True).count() == 50


def test_words_of_segments_are_shuffled_once(spark):
    """before, words met a table of all grams, which shuffled them by gram and then by shard."""
    segments = spark.createDataFrame([(1, 1, 2, "a b c d"), (1, 2, 1, "x a b c d"), (2, 3, 1, "q r s t")], "key long, content long, n long, words string")
    masks = substrings.segment_masks(segments, segments, 4, 2)
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert {r["content"]: r["mask"] for r in masks.collect()} == {1: 1, 2: 2, 3: 0}
