"""Messages as a stream: each micro-batch is deduplicated, parsed and written; a batch that runs again writes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.functions import forms as M
from tally.functions import text
from tally.operators import linking, parser, queue
from tally.operators.lineage import settled
from tally.schemas import RAW_MESSAGE


#: The longest sender and body that are taken in.
SENDER_CHARS, BODY_CHARS = 64, 4000
#: Days back from the newest leg within which a batch links legs again: the two sides of a movement come in different batches.
LOOKBACK_DAYS = 7


def bounded(messages: DataFrame) -> DataFrame:
    """The messages that an ingest takes: a sender and a body of at least one character and of the lengths allowed."""
    return messages.where(F.length("sender").between(1, SENDER_CHARS) & F.length("body").between(1, BODY_CHARS))


def message_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """JSON lines of raw messages as they arrive, those of lengths that are taken in; a missing received_at is the time of reading."""
    rows = bounded(spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", max_files).json(path))
    return rows.withColumn("received_at", F.coalesce("received_at", F.current_timestamp()))


def deduplicated(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drops messages that come again within the watermark; older repeats meet the stored hashes in the batch.

    The watermark follows taken_at, when the engine reads a message, not received_at, which a phone that was offline
    states hours later: a watermark of arrivals would drop such a message unseen.
    """
    hashed = messages.withColumn("body_hash", text.body_hash(F.col("sender"), text.normalized(F.col("body")), F.col("received_at")))
    return hashed.withColumn("taken_at", F.current_timestamp()).withWatermark("taken_at", late).dropDuplicatesWithinWatermark(["body_hash"])


def _there(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists, asked of the file system that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def _dropped(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


LINK = "id string, is_internal boolean, transfer_group string, superseded_by string, batch long"


def current_legs(spark: SparkSession, path: str) -> DataFrame:
    """All legs written under path as they are now: the newest link of a leg says what it is. For readers; no batch reads all."""
    legs, links = spark.read.parquet(f"{path}/legs"), _stored(spark, f"{path}/links", LINK)
    newest = links.groupBy(F.col("id").alias("link_id")).agg(F.max_by(F.struct("is_internal", "transfer_group", "superseded_by"), "batch").alias("now"))
    both = legs.join(newest, legs["id"] == newest["link_id"], "left")
    return both.withColumns({"is_internal": F.coalesce("now.is_internal", "is_internal"), "transfer_group": F.col("now.transfer_group"), "superseded_by": F.col("now.superseded_by")}).drop("link_id", "now")


def recent_legs(legs: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The legs of the last days before the newest: those that later ones may still be linked to."""
    newest = legs.agg(F.max("posted_at")).first()[0]
    return legs.where(F.col("posted_at") >= F.lit(newest) - F.make_dt_interval(F.lit(days)))


def new_links(recent: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(id, is_internal, transfer_group, superseded_by) of the legs that linking changes.

    Top-ups find their purchases, and an echo of a transfer yields to the message that told of it first. Pairs that
    were made and legs that were superseded are left as they are, so a scan that runs again changes nothing.
    """
    recent = recent.where("superseded_by IS NULL")
    cards = identifiers.where("value <> '__default__'").select(F.col("value").alias("card"))
    linked = linking.linked_topups(recent.select("id", "kind", F.col("card_last4").alias("card"), "amount", F.col("posted_at").alias("ts"), "is_internal", "transfer_group"), cards)
    told = recent.where("kind = 'transfer' AND is_internal").select("id", F.col("raw_message_id").alias("message_id"), F.col("sender").alias("institution"), F.col("posted_at").alias("ts"), "account", "direction", "amount")
    yielded = linking.superseded_legs(told, linking.echoes(told)).withColumnRenamed("leg_id", "id")
    was = recent.select("id", F.col("is_internal").alias("was_internal"), F.col("transfer_group").alias("was_group"))
    now = linked.select("id", "is_internal", "transfer_group").join(yielded, "id", "left").join(was, "id")
    return now.where("is_internal <> was_internal OR NOT (transfer_group <=> was_group) OR superseded_by IS NOT NULL").select("id", "is_internal", "transfer_group", "superseded_by")


#: Columns of a message that waits for another try, beside its own.
QUEUED = "id string, sender string, body string, received_at timestamp, device_id string, body_hash string, status string, attempts int, last_error string, last_attempt_at timestamp"
#: Jobs that a batch spends on finding the messages that can't be parsed; parts that are still whole then wait for the next batch.
HALVINGS = 128


def isolated(work: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str) -> tuple[list[str], list[tuple[str, str]], list[tuple[int, int]]]:
    """Parses and writes work in parts under path: (folders written, body_hash and error of each message that fails, parts put off).

    A part whose job fails is halved by its hashes until the message that fails is alone, so one bad message costs about
    2 log2(n) jobs and holds up no other. After HALVINGS jobs a failing part is put off whole, which is no attempt.
    """
    spark, folders, failed, later, parts, jobs = work.sparkSession, [], [], [], [(0, 0)], 0
    while parts:
        depth, number = parts.pop()
        part = work.where(_in_parts([(depth, number)]))
        folder = f"{path}/part={depth}-{number}"
        try:
            parse(part).write.mode("overwrite").parquet(folder)
            folders.append(folder)
        except Exception as error:
            _dropped(spark, folder)
            hashes = [r[0] for r in part.select("body_hash").limit(2).collect()]
            if len(hashes) == 1:
                failed.append((hashes[0], str(error)))
            elif jobs >= HALVINGS:
                later.append((depth, number))
            else:
                parts += [(depth + 1, number), (depth + 1, number + (1 << depth))]
        jobs += 1
    return folders, failed, later


def write_batch(identifiers: DataFrame, path: str, backfill: bool = False, forms=M.FORMS, parse=parser.parsed_messages, most: int = 3, claims: int = 50):
    """Writes a batch's outcomes, legs, snapshots and links under path, a folder a batch, so that a repeat of the batch replaces them.

    A batch reads what the one before left, never all of history: the queue of messages to try again, the legs of the
    last days with their links, and of the messages those of the days its own arrived on: a hash holds the minute of
    arrival, so a repeat can only be among these. It takes the oldest claims of the queue along with the new ones. A
    message whose parse fails counts an attempt and waits in the queue; after most attempts it is written as failed.
    Messages that wait keep their text; no other row holds a recognised one-time code.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = settled(batch.drop("taken_at").withColumn("day", F.to_date(_local_time())))
        days = [r["day"] for r in arrived.select("day").distinct().collect()]
        known = [f"{path}/messages/day={day}" for day in days if _there(spark, f"{path}/messages/day={day}")]
        waiting = _stored(spark, f"{path}/queue/batch={number - 1}", QUEUED)
        seen = waiting.select("body_hash")
        if known:
            seen = seen.union(spark.read.option("basePath", f"{path}/messages").parquet(*known).where(F.col("batch") < number).select("body_hash"))
        fresh = queue.new_messages(arrived.drop("day"), seen)
        fresh = fresh.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "last_attempt_at": F.lit(None).cast("timestamp")})
        claimed = queue.claimed(waiting, F.current_timestamp(), claims)
        work = settled(fresh.unionByName(claimed.select(*fresh.columns)))

        def parsed(rows: DataFrame) -> DataFrame:
            local = rows.drop("status", "attempts", "last_error", "last_attempt_at").withColumn("received_at", _local_time())
            return parser.redacted(parse(local, identifiers, backfill=backfill, forms=forms))

        folders, failed, later = isolated(work, parsed, f"{path}/parsing/batch={number}")
        bad = spark.createDataFrame(failed, "bad_hash string, why string")
        tried = parser.attempted(work.join(bad, F.col("body_hash") == F.col("bad_hash")), F.lit(True), F.col("why"), most).withColumn("last_attempt_at", F.current_timestamp()).select(*work.columns)
        tried = settled(tried)
        put_off = work.where(_in_parts(later)) if later else work.limit(0)
        rest = waiting.join(claimed.select("body_hash"), "body_hash", "left_anti").select(*work.columns)
        settled(rest.unionByName(put_off).unionByName(tried.where("status = 'pending'"))).write.mode("overwrite").parquet(f"{path}/queue/batch={number}")
        gone = tried.where("status = 'failed'").withColumnRenamed("last_error", "error").withColumn("received_at", _local_time()).drop("last_attempt_at")
        whole = gone if not folders else spark.read.parquet(*folders).unionByName(gone, allowMissingColumns=True)
        stamped = whole.withColumns({"day": F.to_date("received_at"), "batch": F.lit(number).cast("long")})
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/messages")
        if folders:
            done = spark.read.parquet(*folders)
            parser.ledger_legs(done).write.mode("overwrite").parquet(f"{path}/legs/batch={number}")
            parser.snapshots(done).write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")
            _linked(spark, path, number, spark.read.parquet(f"{path}/legs/batch={number}"), identifiers)
        else:
            _linked(spark, path, number, None, identifiers)
        for old in ("queue", "recent", "parsing"):
            _dropped(spark, f"{path}/{old}/batch={number - (1 if old == 'parsing' else 2)}")

    return write


def _local_time() -> Column:
    """Arrival by the bank's wall clock."""
    return F.from_utc_timestamp("received_at", "Asia/Riyadh").cast("timestamp_ntz")


def _in_parts(parts: list[tuple[int, int]]) -> Column:
    """Rows whose hash ends in one of these (bits, value)."""
    slot = F.xxhash64(F.lit("half"), "body_hash")
    found = F.lit(False)
    for depth, number in parts:
        found = found | (F.pmod(slot, F.lit(1 << depth)) == number)
    return found


def _linked(spark: SparkSession, path: str, number: int, legs: DataFrame | None, identifiers: DataFrame) -> None:
    """Writes the links of the batch's legs among each other and with those carried, and the last days' legs as they are after it: all that the next batch reads of legs."""
    was = f"{path}/recent/batch={number - 1}"
    state = spark.read.parquet(was) if _there(spark, was) else None
    if legs is not None:
        legs = legs.withColumns({"transfer_group": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string")})
        state = legs if state is None else state.unionByName(legs)
    if state is None:
        return
    carried = settled(state)  # the last days before this batch, and the batch whole: it may hold a month of them
    links = settled(new_links(carried, identifiers))
    links.write.mode("overwrite").parquet(f"{path}/links/batch={number}")
    now = links.select(F.col("id").alias("link_id"), F.struct("is_internal", "transfer_group", "superseded_by").alias("now"))
    both = carried.join(now, F.col("id") == F.col("link_id"), "left")
    # a link that only tells of a superseding keeps the rest as it was, for it holds all three
    changed = F.col("link_id").isNotNull()
    after = both.withColumns({c: F.when(changed, F.col(f"now.{c}")).otherwise(F.col(c)) for c in ("is_internal", "transfer_group", "superseded_by")}).select(*carried.columns)
    recent_legs(settled(after)).write.mode("overwrite").parquet(f"{path}/recent/batch={number}")


def weekly_spend(legs: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of legs as spending by account and week from Sunday on; a week is told once it is over and late legs had their time."""
    spent = legs.where("direction = 'debit' AND NOT is_internal").withWatermark("posted_at", late)
    week = F.window("posted_at", "7 days", "7 days", "3 days")  # windows count from a Thursday
    return spent.groupBy(week.alias("week"), "account").agg(F.sum("amount").alias("spent"), F.count("*").alias("legs")).select(F.to_date("week.start").alias("week"), "account", "spent", "legs")


def run(messages: DataFrame, identifiers: DataFrame, path: str, checkpoint: str, once: bool = False, backfill: bool = False, forms=M.FORMS, parse=parser.parsed_messages) -> StreamingQuery:
    """Starts the stream, each minute or (once) for what is there. backfill takes messages up to 400 days old, else 3.

    Messages that failed are tried again with the next batch, of new messages or of none (Spark runs one as the watermark moves on).
    """
    writer = deduplicated(messages).writeStream.foreachBatch(write_batch(identifiers, path, backfill, forms, parse)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
