"""Operator 1: line dedup by winnowing over line hashes, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import hot_join, settled, text_hash
from tally.llm.quality import WHITE


def _named(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda over an array of one it has a name."""
    return F.transform(F.array(value), use)[0]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, how many rows have both, and each line with a word: its place among all lines and the hash of its normal form."""
    normal = lambda line: F.lower(F.trim(F.regexp_replace(line, WHITE, " ")))
    every = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda line, i: F.struct(i.alias("at"), normal(line).alias("line")))
    kept = F.transform(F.filter(every, lambda x: x["line"] != ""), lambda x: F.struct(x["at"], F.xxhash64(x["line"]).alias("h")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), kept.alias("lines"))
    return rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.first("lines").alias("lines")).select("doc_id", "text_hash", "copies", F.col("lines.at").alias("at"), F.col("lines.h").alias("h"))


def windows_of(hashes: Column, min_run: int) -> Column:
    """Of every run of min_run lines, or of all lines if they are fewer: place, hash, and its mark, the first of its smallest line hashes."""
    lines = lambda i, n: [F.get(hashes, i + k) for k in range(n)]
    starts = F.slice(hashes, F.lit(1), F.greatest(F.lit(0), F.size(hashes) - (min_run - 1)))

    def window(i: Column) -> Column:
        own = lines(i, min_run)
        least = F.least(*own) if min_run > 1 else own[0]
        marked = F.coalesce(*(F.when(x == least, i + k) for k, x in enumerate(own)))
        return F.struct(i.alias("place"), F.xxhash64(*own).alias("hash"), least.alias("mark"), marked.alias("marked"))

    least = F.array_min(hashes)
    short = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(hashes, F.size(hashes)).alias("hash"), least.alias("mark"), (F.array_position(hashes, least) - 1).cast("int").alias("marked")))
    return F.when(F.size(hashes).between(1, min_run - 1), short).otherwise(F.transform(starts, lambda _, i: window(i)))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 3) -> DataFrame:
    """(doc_id, text_hash, copies, n_lines, runs, n_removed): the runs of lines (places among all lines, both ends in) that repeat earlier ones.

    Documents stand in the order of (doc_id, text_hash), nulls last; rows equal in both count here as one (copies says how
    many). Each window of min_run lines marks its smallest line hash; equal windows mark equal lines, so a run that repeats
    is sure to have a mark that stands at two places. Windows of marks that stand at one place only leave at once. The
    places of the others are joined to the first occurrence of the same window, never to all others, and each match reaches
    as far both ways as its windows follow each other; so none is lost whatever stands before or after it, and all but the
    first go. A document of fewer lines is one window. A line goes only because an equal one stands earlier, so the first
    of equal lines always stays. Long texts take time in proportion; an empty table gives no rows.
    """
    table = settled(line_table(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    windows = table.select("doc_id", "text_hash", order.alias("o"), F.explode(windows_of(F.col("h"), min_run)).alias("w")).select("doc_id", "text_hash", "o", "w.*")
    marks = windows.groupBy("mark").agg(F.min(F.struct("o", "marked")).alias("first"), F.max(F.struct("o", "marked")).alias("last"), F.count("*").alias("n"))
    marks = settled(marks.where(~F.col("first").eqNullSafe(F.col("last"))).select("mark", "n"))
    total = table.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("n")).first()["n"]
    shared = settled(hot_join(windows, marks, ["mark"], "n", total).select("doc_id", "text_hash", "o", "hash", "place"))
    first = settled(shared.groupBy("hash").agg(F.min(F.struct("o", "place")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = hot_join(shared, first, ["hash"], "n", total).where(~F.struct("o", "place").eqNullSafe(F.col("first")))
    places = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    found = table.join(places, table["doc_id"].eqNullSafe(places["__id"]) & (table["text_hash"] == places["__hash"]), "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    # windows that overlap are one run: it starts where the place before is too far off, and stops where the next is
    starts = F.filter("places", lambda p, k: (k == 0) | (F.get("places", k - 1) + min_run <= p))
    stops = F.transform(F.filter("places", lambda p, k: (k == F.size("places") - 1) | (p + min_run <= F.get("places", k + 1))), lambda p: F.least(p + min_run, F.size("at")) - 1)
    found = found.withColumn("spans", F.arrays_zip(starts.alias("start"), stops.alias("stop")))
    runs = F.transform("spans", lambda r: F.struct(F.get("at", r["start"]).alias("start"), F.get("at", r["stop"]).alias("stop")))
    inside = F.aggregate("spans", F.lit(0), lambda total, r: total + r["stop"] - r["start"] + 1)
    return found.select("doc_id", "text_hash", "copies", F.size("at").alias("n_lines"), runs.alias("runs"), inside.alias("n_removed"))


#: Repeats of a row that are made at once.
COPIES = 4096


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (those with a word), n_removed and kept_text.

    Lines are compared lower-cased with single blanks; lines without a word are not compared, and go only inside a
    removed run. Of rows equal in id and text one is kept as the first and the others lose all lines. A null text gives
    an empty one. Null ids are ids like others; an empty table gives no rows; other columns are not read.
    """
    runs = repeated_runs(docs, id_col, text_col, min_run).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.join(runs, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["text_hash"] == F.col("__hash")))
    lines = F.split("text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["stop"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size(lines)))
    kept = _named(lines, lambda all_: F.array_join(F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.slice(all_, p["a"] + 1, p["b"] - p["a"]))), "\n"))
    text = F.when(F.size("runs") == 0, F.col("text")).otherwise(kept)
    rows = rows.select("doc_id", "text_hash", "copies", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), text.alias("kept_text"))
    out = ["doc_id", "n_lines", "n_removed", "kept_text"]
    equal = rows.where("copies > 1").groupBy("doc_id", "text_hash").agg(*(F.first(c).alias(c) for c in ["copies", "text", *out[1:]]))
    again = equal.withColumn("from", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"), F.lit(COPIES).cast("long"))))
    again = again.withColumn("copy", F.explode(F.sequence("from", F.least("copies", F.col("from") + (COPIES - 1))))).select("doc_id", "n_lines", F.col("n_lines").alias("n_removed"), F.when(F.col("n_lines") > 0, F.lit("")).otherwise(F.col("text")).alias("kept_text"))
    return rows.where("copies = 1").select(*out).unionByName(equal.select(*out)).unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the kept text of every document."""
    kept = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
