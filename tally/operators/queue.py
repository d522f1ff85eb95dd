"""The message queue: idempotent append, claims, parking, and what a review sees of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import text
from tally.operators.lineage import settled

STALE = "INTERVAL 10 MINUTES"


def hashed(messages: DataFrame) -> DataFrame:
    """Adds body_hash: sender, normal form and minute of arrival."""
    return messages.withColumn("body_hash", text.body_hash(F.col("sender"), text.normalized(F.col("body")), F.col("received_at")))


def new_messages(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """The first (by id) of each body_hash that is not among the stored; its other columns are those of that row."""
    rest = messages.join(stored.select("body_hash").distinct(), "body_hash", "left_anti")
    row = F.struct(*(c for c in messages.columns if c != "body_hash"))
    return rest.groupBy("body_hash").agg(F.min_by(row, "id").alias("row")).select("body_hash", "row.*")


def claimed(messages: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """The next to parse, oldest first: pending ones, and those whose processing has gone stale."""
    stuck = (F.col("status") == "processing") & (F.col("last_attempt_at") < now - F.expr(STALE))
    return messages.where((F.col("status") == "pending") | stuck).orderBy("received_at", "id").limit(limit)


def parked_exhausted(messages: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Messages that were stuck so many times have failed."""
    worn = (F.col("status") == "processing") & (F.col("attempts") >= most) & (F.col("last_attempt_at") < now - F.expr(STALE))
    return messages.withColumn("status", F.when(worn, "failed").otherwise(F.col("status")))


def status_counts(messages: DataFrame) -> DataFrame:
    """Counts by status and the parse rate; what was ignored on purpose is not held against the parser."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    found = messages.agg(F.count("*").alias("messages"), of("parsed").alias("parsed"), of("ignored").alias("ignored"), of("needs_review").alias("needs_review"))
    rate = F.round(F.col("parsed") / F.nullif(F.col("messages") - F.col("ignored"), F.lit(0)), 6)
    return found.withColumn("parse_rate", rate)


def parked_shapes(parked: DataFrame) -> DataFrame:
    """One row a shape and sender: messages, newest sample, newest and oldest arrival; the most frequent first."""
    latest = F.struct("received_at", "id")
    found = parked.groupBy("shape", "sender", "status").agg(F.count("*").alias("messages"), F.max_by("body", latest).alias("sample"), F.max("received_at").alias("newest"), F.min("received_at").alias("oldest"))
    return found.orderBy(F.col("messages").desc(), F.col("newest").desc(), "shape")


def parked_members(parked: DataFrame) -> DataFrame:
    """(id, shape, sender, status, messages): each message with how many its group of parked_shapes has, so that an action on the group can name them.

    A row a message instead of a list a group: a shape may hold most of what waits. The messages are written once, since what they
    are read from is parsed.
    """
    rows = settled(parked.select("id", "shape", "sender", "status"))
    groups = rows.groupBy("shape", "sender", "status").agg(F.count("*").alias("messages"))
    return rows.join(groups, ["shape", "sender", "status"])


def requeued(messages: DataFrame, shape: str) -> DataFrame:
    """Messages of a shape that waited or failed are pending again; parsed ones stay."""
    again = (F.col("shape") == shape) & F.col("status").isin("needs_review", "failed")
    return messages.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))})


def dismissed(messages: DataFrame, ids: DataFrame, restore: bool = False) -> DataFrame:
    """The named messages are ignored by the user's wish, or come back from that."""
    chosen = messages.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left").withColumn("__hit", F.col("__id").isNotNull())
    now, why = ("needs_review", None) if restore else ("ignored", "user")
    hit = F.col("__hit") & (F.col("ignored_reason") == "user" if restore else F.col("status") == "needs_review")
    return chosen.withColumns({"status": F.when(hit, now).otherwise(F.col("status")), "ignored_reason": F.when(hit, F.lit(why).cast("string")).otherwise(F.col("ignored_reason"))}).drop("__id", "__hit")
