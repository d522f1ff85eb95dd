"""Operator 9: sharding by extendible hashing, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.llm.common import settled, text_hash, whole_rows

#: Bits of a document's hash: 15 hex digits of an MD5, the same in any SQL engine.
BITS = 60
#: Repeats of a row that are numbered in one array.
RUN = 4096
#: Bits that one round of splits adds.
ROUND = 4


def prefix(bits: Column, depth: Column | int) -> Column:
    """The leading bits, as many as depth says."""
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, docs): the buckets left when each one over the limit was split on its next bit.

    A round sums the bytes of the open buckets' rows at the next few depths at once, settles the buckets that fit and
    keeps open those that don't at its last depth; rows of settled buckets leave the next round. A bucket of one row
    stays as it is, however large.
    """
    done, open_, depth = None, rows.select("bits", "bytes"), 0
    while True:
        levels = range(depth, min(BITS, depth + ROUND) + 1)
        sums = open_.groupBy(prefix(F.col("bits"), levels[-1]).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        tree = sums.select("bytes", "docs", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.call_function("shiftright", F.col("p"), F.lit(levels[-1] - d)).alias("prefix")) for d in levels))).alias("node"))
        tree = settled(tree.groupBy("node.depth", "node.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == BITS)
        split = tree.where(~fits)
        # a bucket exists if its parent was split; the root and the buckets that the last round left open exist
        parents = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix"))
        roots = tree.where(F.col("depth") == depth).select("depth", "prefix")
        leaves = tree.where(fits).join(parents.unionByName(roots), ["depth", "prefix"], "left_semi")
        done = leaves if done is None else done.unionByName(leaves)
        large = split.where(F.col("depth") == levels[-1]).select("prefix")
        if large.isEmpty():
            return settled(done)
        open_ = settled(open_.withColumn("prefix", prefix(F.col("bits"), levels[-1])).join(large, "prefix", "left_semi").select("bits", "bytes"))
        depth = levels[-1]


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, repeat, bytes, depth, shard (the hash prefix as 0s and 1s), shard_bytes, shard_docs.

    Every shard holds at most limit bytes of UTF-8 text, or one document that is larger by itself. A null text has 0
    bytes; rows that repeat id and text are numbered first, so that they can part; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"))
    # equal rows are one row with a count until they are numbered, so a large group of them shuffles as one
    counted = base.groupBy("doc_id", "text_hash", "bytes", "digest").agg(F.count("*").alias("n"))
    single = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "digest", F.col("repeat").cast("string"))
    rows = counted.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long"))))
    rows = rows.withColumn("repeat", F.explode(F.sequence("from", F.least("n", F.col("from") + (RUN - 1)))))
    rows = settled(rows.select("doc_id", "text_hash", "repeat", "bytes", F.conv(F.substring(F.md5(single), 1, BITS // 4), 16, 10).cast("long").alias("bits")))
    buckets = directory(rows, limit).select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]
    placed = rows.withColumn("node", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("bits"), d).alias("prefix")) for d in sorted(depths))))) if depths else rows.withColumn("node", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    placed = placed.select("doc_id", "text_hash", "repeat", "bytes", F.col("node.depth").alias("depth"), F.col("node.prefix").alias("prefix")).join(buckets, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    return placed.select("doc_id", "text_hash", "repeat", "bytes", "depth", name.alias("shard"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows of docs as one folder a shard under path and returns docs with its shard.

    A folder is named s and the shard's bits, so that readers take it for no number, and the only shard is s alone.
    Null ids and texts are rows like others, a null text of 0 bytes; an empty table writes no folder and gives no rows.
    """
    out = with_shards(docs, limit, id_col, text_col)
    out.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    return out


def with_shards(docs: DataFrame, limit: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns shard and shard_bytes (existing ones of that name are replaced); an empty table gives no rows.

    Only rows equal in id and text are numbered together, by a hash of all columns; that sort spills to disk.
    """
    place = shards(docs, id_col, text_col, limit).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("repeat").alias("__repeat"), "shard", "shard_bytes")
    plain = [c for c in docs.columns if c not in ("shard", "shard_bytes")]
    rows = whole_rows(docs, id_col, text_col)
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"))).cast("long"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__text")) & (F.col("number") == F.col("__repeat"))
    return rows.join(place, on).select(*(F.col("row")[c].alias(c) for c in plain), "shard", "shard_bytes")


def query(spark, sf_dir: str, limit: int = 8 << 20) -> DataFrame:
    """The shard of every document."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit=limit).select("doc_id", "bytes", "depth", "shard", "shard_bytes", "shard_docs")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || md5(concat_ws('|', coalesce(doc_id::VARCHAR, chr(0)), md5(coalesce(text, '')), row_number() OVER (PARTITION BY doc_id, text)::VARCHAR))[1:15])::BIGINT AS bits
  FROM documents),
sums AS (SELECT depth, bits >> (60 - depth) AS p, sum(bytes)::BIGINT AS b, count(*) AS n FROM d, range(0, 61) t(depth) GROUP BY 1, 2),
tree AS (
  SELECT depth, p, b, n FROM sums WHERE depth = 0
  UNION ALL
  SELECT s.depth, s.p, s.b, s.n FROM tree t JOIN sums s ON s.depth = t.depth + 1 AND s.p >> 1 = t.p WHERE t.b > 8388608 AND t.n > 1 AND t.depth < 60),
leaf AS (SELECT * FROM tree WHERE b <= 8388608 OR n = 1 OR depth = 60)
SELECT d.doc_id, d.bytes, leaf.depth::INTEGER AS depth, CASE WHEN leaf.depth = 0 THEN '' ELSE right(bin(d.bits >> (60 - leaf.depth) | (1::BIGINT << 60)), leaf.depth::INTEGER) END AS shard, leaf.b AS shard_bytes, leaf.n AS shard_docs
FROM d JOIN leaf ON d.bits >> (60 - leaf.depth) = leaf.p
"""
