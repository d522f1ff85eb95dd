"""What a message's outcome is made of is worked out once a row, whatever reads it."""

from __future__ import annotations

from pyspark.sql import functions as F
from tally.functions import derive
from tally.functions import forms as M
from tally.operators import parser, queue

OWNED = [("SAIB", "1111", "main")]


def _parsed(spark):
    raw = spark.createDataFrame([(1, "SAIB", "x"), (2, "SAIB", "شراء")], "id long, sender string, body string").selectExpr("*", "timestamp_ntz'2025-01-01 10:00:00' AS received_at")
    return parser.parsed_messages(raw, spark.createDataFrame(OWNED, "sender string, value string, account string"))


def _plan(df):
    spark = df.sparkSession
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", most)


def test_a_filter_on_the_status_repeats_no_pattern(spark):
    """This held before as well; it guards the steps that work a column out once."""
    plan = _plan(_parsed(spark).where("status = 'needs_review'").select("id", "status"))
    assert plan.count("رمز التحقق") == 1


def test_parked_members_are_parsed_once(spark):
    """before, the groups and their members were parsed one after the other."""
    found = queue.parked_members(_parsed(spark).where("status = 'needs_review'"))
    assert "_normalized" not in _plan(found)
    assert sorted((r.id, r.messages) for r in found.collect()) == [(1, 1), (2, 1)]


def test_messages_are_not_dealt_by_their_sender(spark):
    """a few senders have all messages, so that a shuffle by sender is a few tasks."""
    legs = parser.ledger_legs(_parsed(spark))
    plan = legs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_line_of_all_messages_meets_its_form_in_many_parts(spark):
    """before, all messages with a form's line, and then all their texts, were one key of one task."""
    form = M.Form("all", "s", "purchase", "debit", None, "the same line\nsum {amount} SAR", None, True)
    stored = spark.createDataFrame([derive.as_row(form, "x", 1)], "id string, sender string, kind string, direction string, date string, text string, account string, shape string, created_at int")
    texts = spark.range(400).select(F.col("id").alias("k"), F.lit("s").alias("sender"), F.concat(F.lit("the same line\nsum "), F.col("id"), F.lit(" SAR")).alias("norm"))
    found = derive.form_matches(texts, stored, "k", 8)
    assert found.select("k", F.col("said.amount").cast("long").alias("a")).where("k = a").count() == 400
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) == 8 and max(sizes) < 100
    assert "part#" in [line for line in _plan(found).splitlines() if "Join" in line][0]
