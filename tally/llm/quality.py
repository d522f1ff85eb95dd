"""Operator 7: quality rules of a document and the frequency of its lines across documents, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import hot_join, settled, text_hash, whole_rows

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def normal_lines(text: Column) -> Column:
    """The lines with a word, lower-cased, their white space single blanks."""
    return F.array_remove(F.transform(F.split(text, "\n"), lambda line: F.lower(F.trim(F.regexp_replace(line, WHITE, " ")))), "")


def _covered(windows: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, position), keep equal neighbours, merge their spans."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def spans(order: Column) -> Column:
        twice = F.filter(order, lambda x, k: (k > 0) & (F.get(order, k - 1)["h"] == x["h"]) | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)), F.lit(0), lambda a, b: a + b)

    # an array of one lets the sorted windows be named once inside the lambda
    return F.aggregate(F.transform(F.array(ordered), spans), F.lit(0), lambda a, b: a + b)


def document_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", window: int = 3) -> DataFrame:
    """One row for each row of docs: its counts, and hash and words of each of its lines."""
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(host.isNull(), host).alias("host"), text_hash(F.col(text_col)).alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"words": words_of(F.col("text")), "raw_lines": F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != ""), "lines": normal_lines(F.col("text"))})
    rows = rows.withColumn("n_words", F.size("words"))
    rows = rows.withColumn("windows", F.transform(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.col("n_words") - (window - 1))), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, window)))))
    return rows.select(
        "doc_id",
        "host",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(_covered(F.col("windows"), window)).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda line: F.struct(F.xxhash64(line).alias("h"), F.size(F.split(line, " ")).alias("w"))).alias("lines"),
    )


def frequent_lines(metrics: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, h, n): lines that more than min_docs and more than max_share of the host's documents hold, or more than max_docs; equal texts are one document, n counts all rows."""
    texts = metrics.groupBy("host", "text_hash").agg(F.count("*").alias("rows"), F.first(F.array_distinct("lines.h")).alias("h"))
    sizes = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = texts.select("host", "rows", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("texts"), F.sum("rows").alias("n")).where(F.col("texts") > min_docs)
    return lines.join(sizes, "host").where((F.col("texts") > F.col("docs") * max_share) | (F.col("texts") > max_docs)).select("host", "h", "n")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str | None = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 5,
    max_share: float = 0.02,
    max_docs: int = 10_000,
    min_left_percent: int = 30,
) -> DataFrame:
    """One row for each row of docs: the counts, base_failed, the words in frequent lines, the lines to drop, kept.

    A line (lower-cased, white space single blanks) is boilerplate if more than min_docs and more than max_share of its
    host's different texts hold it, or more than max_docs of them, which bounds how often a line stays on a very large host. A document that passes the base rules is rejected if its other lines have
    less than min_left_percent of its words. A null or empty text has no words and fails the base rules; documents of
    a null host are one host; repeated rows count as one document and get the same verdict. Other columns are not read.
    """
    metrics = settled(document_metrics(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    lines = metrics.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    total = metrics.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    frequent = settled(frequent_lines(metrics, min_docs, max_share, max_docs))
    hit = hot_join(lines, frequent, ["host", "h"], "n", total).groupBy("row").agg(F.sum("w").alias("boilerplate_words"), F.collect_set("h").alias("drop_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("boilerplate_words", F.lit(0))
    return metrics.drop("lines").join(hit, "row", "left").select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.coalesce("boilerplate_words", F.lit(0)).alias("boilerplate_words"),
        F.coalesce("drop_lines", F.array().cast("array<bigint>")).alias("drop_lines"), (~failed & (100 * left >= min_left_percent * F.col("n_words"))).alias("kept"),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", **rules) -> DataFrame:
    """The rows of docs that quality_rules keeps, without their boilerplate lines; columns stay, an n_chars follows the text.

    Null and empty texts are rejected, repeated rows stay or go together, an empty table gives no rows.
    """
    verdict = quality_rules(docs, id_col, text_col, host_col, **rules).where("kept").select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__text"), F.col("drop_lines").alias("__drop"))
    rows = whole_rows(docs, id_col, text_col)
    host = F.col("row")[host_col] if host_col else F.lit(None).cast("string")
    rows = rows.withColumn("host", F.xxhash64(host.isNull(), host))
    kept = rows.join(verdict.dropDuplicates(["__id", "__host", "__text"]), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("host") == F.col("__host")) & (F.col("text_hash") == F.col("__text")))
    line_hash = lambda line: F.xxhash64(F.lower(F.trim(F.regexp_replace(line, WHITE, " "))))
    was = F.col("row")[text_col]
    text = F.when(F.size("__drop") == 0, was).otherwise(F.array_join(F.filter(F.split(was, "\n"), lambda line: ~F.array_contains("__drop", line_hash(line))), "\n"))
    new = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select("row", text.alias("text")).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """The counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, text IS NULL AS no_text FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(list_transform(string_split(t, chr(10)), lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))), lambda x: x <> '') AS ls,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw
      FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
uniq AS (SELECT DISTINCT source, t, no_text, list_distinct(ls) AS ls FROM w),
hosts AS (SELECT source, count(*) AS docs FROM uniq GROUP BY source),
freq AS (SELECT f.source, f.l FROM (SELECT source, l, count(*) AS n FROM (SELECT source, unnest(ls) AS l FROM uniq) GROUP BY source, l) f
         JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 5 AND (f.n > h.docs * 0.02 OR f.n > 10000)),
boil AS (SELECT x.r, sum(len(string_split(x.l, ' '))) AS b FROM (SELECT r, source, unnest(ls) AS l FROM w) x
         JOIN freq f ON x.l = f.l AND x.source IS NOT DISTINCT FROM f.source GROUP BY x.r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(raw) - len(list_distinct(raw)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(b, 0) AS b
      FROM w LEFT JOIN rep USING (r) LEFT JOIN boil USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - b) >= 30 * n_words AS kept FROM v
"""
