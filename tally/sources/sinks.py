"""What leaves the engine: CSV that spreadsheets open safely, JSON, the dump of raw messages; and settings with defaults."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What settings are where none are stored, and how many raw messages one dump holds.
DEFAULTS = {"timezone": "Asia/Riyadh", "anchor_day": 25}
DUMP_ROWS = 200_000
BOM = "﻿"


def guarded(value: Column) -> Column:
    """The value with a quote before =, + or @, which a spreadsheet would take for a formula."""
    text = value.cast("string")
    return F.when(text.rlike("^[=+@]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_field(value: Column) -> Column:
    """One field of a line: guarded, empty for null, in quotes if it holds a quote, a comma or a line end."""
    text = F.coalesce(guarded(value), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(rows: DataFrame, path: str) -> None:
    """Parts of CSV under path, lines ended by \\r\\n; each begins with the byte order mark and the header, so that it opens by itself.

    Line ends inside a field are kept as they are, which Spark's own CSV would turn into its line separator.
    """
    header = BOM + ",".join(rows.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines = rows.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in rows.columns)).alias("value"))
    lines.mapInArrow(headed, "value string").write.option("lineSep", "\r\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line, nulls kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


#: The columns of a dump of raw messages, and those of them that are times.
DUMP_COLUMNS = (
    "id", "sender", "body", "received_at", "device_sent_at", "ingested_at", "body_hash", "status", "processed_at", "attempts",
    "last_attempt_at", "last_error", "ignored_reason", "classification", "language", "shape_hash", "template_id", "parse_method", "llm_response",
)
DUMP_TIMES = ("received_at", "device_sent_at", "ingested_at", "processed_at", "last_attempt_at")


def raw_dump(messages: DataFrame, limit: int = DUMP_ROWS) -> DataFrame:
    """The oldest messages, as many as a dump holds, in the order of (received_at, id), with a dump's columns.

    Times are UTC texts to the second, attempts a number, all else text; a column that messages lack is null.
    """

    def column(name: str) -> Column:
        if name not in messages.columns:
            return F.lit(None).cast("long" if name == "attempts" else "string").alias(name)
        if name in DUMP_TIMES:
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)
        return F.col(name).cast("long" if name == "attempts" else "string").alias(name)

    return messages.orderBy("received_at", "id").limit(limit).select(*map(column, DUMP_COLUMNS))


def dump_is_whole(messages: DataFrame, limit: int = DUMP_ROWS) -> bool:
    """Whether a dump is sure to leave nothing out: one that is full may."""
    return messages.limit(limit).count() < limit


def export_raw(messages: DataFrame, settings: DataFrame, path: str, now: dt.datetime, limit: int = DUMP_ROWS, form: str = "csv") -> tuple[bool, DataFrame]:
    """Writes the dump under path, as CSV or JSON lines: (truncated, settings after it).

    last_export_at is set only once a whole dump lies there: a truncated one is no backup, and a reminder is then right.
    """
    rows = raw_dump(messages, limit)
    (write_json if form == "json" else write_csv)(rows, path)
    truncated = not dump_is_whole(messages, limit)
    stamp = F.lit(now).cast("timestamp")
    return truncated, settings if truncated else settings.withColumn("last_export_at", stamp)


def with_defaults(settings: DataFrame, defaults: dict | None = None) -> DataFrame:
    """settings with what is missing filled in."""
    return settings.fillna(DEFAULTS if defaults is None else defaults)
