"""Operator 11: importance resampling towards a target corpus over inverted postings of hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tally.llm.common import chunks, quoted, settled, text_hash

#: Bytes to themselves; upper-case letters to lower-case ones, what no word holds to a blank.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Rows that one block numbers at most: a posting's document is two bytes.
BLOCK_ROWS = 1 << 16
#: Parts of the buckets, and blocks of one part that one group holds: some 10 MB.
PARTS, GROUP_BLOCKS = 16, 64


def features(texts: list[bytes | None], runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC of every feature (runs of 1 to so many words), the text it belongs to, and how many words each text has."""
    words = [(t or b"").translate(PLAIN).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner, place = np.repeat(np.arange(len(words)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    every = list(chain.from_iterable(words))
    spaced = [b" " + w for w in every]
    last, codes, owners = np.fromiter(map(crc32, every), np.uint32, len(every)), [], []
    for k in range(1, runs + 1):  # a run's CRC goes on from that of the run of one word less
        if k > 1:
            last = np.fromiter(map(crc32, spaced[k - 1 :], last.tolist()), np.uint32, max(0, len(every) - k + 1))
        inside = place[: len(last)] + k <= sizes[owner[: len(last)]]
        codes.append(last[inside])
        owners.append(owner[: len(last)][inside])
    return np.concatenate(codes), np.concatenate(owners), sizes


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8 if values.max() < 1 << 8 else np.uint16 if values.max() < 1 << 16 else np.uint32)


def postings(docs: DataFrame, id_col: str, text_col: str, buckets: int, runs: int) -> DataFrame:
    """Blocks of documents turned round: a row for each bucket of a block (total, docs, counts), and one (bucket null) that lists its documents.

    A bucket's list is bytes: the block's own two-byte numbers of the documents that hold it, and their counts in as
    few bytes as the largest needs. A block is at most 4 MB of text, or one document.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), text_hash(F.col(quoted(text_col))).alias("text_hash"))
    of = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("members", T.ArrayType(of))])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text"):
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                yield block(batch.slice(start, BLOCK_ROWS), number)
                number += 1

    def block(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        codes, owners, n_words = features(batch.column(1).cast(pa.binary()).to_pylist(), runs)
        n = batch.num_rows
        keys, counts = np.unique((codes % np.uint32(buckets)).astype(np.int64) * n + owners, return_counts=True)
        found, docs_ = np.divmod(keys, n)
        firsts = np.flatnonzero(np.diff(found, prepend=-1))
        lasts = np.append(firsts[1:], len(found))[: len(firsts)]
        made = [(int(found[a]), int(counts[a:b].sum()), docs_[a:b].astype(np.uint16).tobytes(), _narrow(counts[a:b]).tobytes()) for a, b in zip(firsts, lasts, strict=True)]
        own = pa.StructArray.from_arrays([pa.array(np.arange(n), pa.int32()), batch.column(0), batch.column(2), pa.array(n_words), pa.array(np.bincount(owners, minlength=n))], names=["at", "doc_id", "text_hash", "n_words", "n_features"])
        members = pa.ListArray.from_arrays(pa.array([0, *[None] * len(made), n], pa.int32()), own)
        columns = [[x[k] for x in made] for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([number] * (len(made) + 1), pa.int64()), pa.array([None, *columns[0]], pa.int32()), pa.array([None, *columns[1]], pa.int64()), pa.array([None, *columns[2]], pa.binary()), pa.array([None, *columns[3]], pa.binary()), members], names=schema.names)

    return rows.select("doc_id", "text", "text_hash").mapInArrow(turned, schema)


def gains(ours: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that ours holds: what both corpora have of a bucket meets where its gain is computed.

    gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). One row a bucket; the blocks' totals are added up before they move.
    """
    both = ours.where("bucket IS NOT NULL").select("bucket", F.col("total").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.where("bucket IS NOT NULL").select("bucket", F.lit(0).cast("long").alias("s"), F.col("total").alias("t")))
    per = settled(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t").cast("double") + 1) * float(whole["s"] + buckets) / ((F.col("s").cast("double") + 1) * float(whole["t"] + buckets))
    return per.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _contributed(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """What the buckets of one part give to each document of some blocks."""
    of = {x["bucket"]: x["gain"] for x in right.column("gains")[0].as_py()}
    sums: dict[int, np.ndarray] = {}
    for number, bucket, docs_, counts in zip(*(left.column(c).to_pylist() for c in ("block", "bucket", "docs", "counts")), strict=True):
        at = np.frombuffer(docs_, np.uint16)
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // len(at)]
        have = sums.get(number)
        if have is None or len(have) <= at[-1]:
            more = np.zeros(int(at[-1]) + 1, np.int64)
            if have is not None:
                more[: len(have)] = have
            have = sums[number] = more
        have[at] += of[bucket] * np.frombuffer(counts, kind).astype(np.int64)
    hit = {number: np.flatnonzero(have) for number, have in sums.items()}
    return pa.table({
        "block": pa.array(np.repeat(np.fromiter(hit, np.int64, len(hit)), [len(x) for x in hit.values()])),
        "at": pa.array(np.concatenate([*hit.values(), np.zeros(0, np.int64)]), pa.int32()),
        "given": pa.array(np.concatenate([*(sums[number][x] for number, x in hit.items()), np.zeros(0, np.int64)])),
    })


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, runs: int = 3) -> DataFrame:
    """One row for each row of docs: block, at, doc_id, text_hash, n_words, n_features and weight, the sum of its features' gains.

    Postings (bucket, block of documents, counts) are shuffled by part of the buckets and group of blocks, so that
    neither a frequent bucket nor a large corpus fills a task; the gains of the part's buckets meet them there, each
    group gives one number a document, and these are added up by document. Null texts have no words and weight 0;
    repeated rows are rows of their own; an empty table gives no rows, an empty target counts as one without features.
    """
    ours = settled(postings(docs, id_col, text_col, buckets, runs))
    theirs = postings(target.select(F.lit(0).alias("target_id"), F.col(quoted(target_text_col)).alias("target_text")), "target_id", "target_text", buckets, runs)
    blocks, lists = ours.where("bucket IS NULL"), ours.where("bucket IS NOT NULL")
    groups, part = max(1, math.ceil(blocks.count() / GROUP_BLOCKS)), (F.col("bucket") % PARTS).alias("part")
    lists = lists.select(part, F.pmod(F.xxhash64("block"), F.lit(groups)).alias("salt"), "block", "bucket", "docs", "counts")
    per = gains(ours, theirs, buckets).groupBy(part).agg(F.collect_list(F.struct("bucket", "gain")).alias("gains"))
    per = per.crossJoin(docs.sparkSession.range(groups).withColumnRenamed("id", "salt"))  # a part has buckets / PARTS gains
    given = lists.groupBy("part", "salt").cogroup(per.groupBy("part", "salt")).applyInArrow(_contributed, "block long, at int, given long")
    total = given.groupBy("block", "at").agg(F.sum("given").alias("weight"))
    members = blocks.select("block", F.explode("members").alias("m")).select("block", "m.*")
    return members.join(total, ["block", "at"], "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in this order (no two rows equal in it) with their rank: sorted by ranges, each range numbered from where it begins."""
    sorted_ = settled(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = sorted_.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")).where(F.col("__before") < n)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return sorted_.join(F.broadcast(begins), "__range").withColumn("rank", (place + F.col("__before")).cast("long")).where(F.col("rank") <= n).drop("__range", "__before")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = 10_000, runs: int = 3, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_features, weight, score and rank (null if not drawn).

    Gumbel top-k: score is weight plus floor(-1000 ln(-ln u)) with u from a hash of seed and id, and of the documents
    with at least least_words words percent are drawn by highest score, ties to smaller ids, then by the text's hash. A
    null id is hashed as an empty text and comes last in ties. Nulls, repeats and empty tables are as in weights;
    nothing is drawn from fewer than 100 / percent documents.
    """
    rows = weights(docs, target, id_col, text_col, target_text_col, buckets, runs)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    rows = settled(rows.withColumn("score", F.col("weight") + noise))
    fit = rows.where(F.col("n_words") >= least_words)
    n = percent * fit.count() // 100
    best = ranked(fit.select("block", "at", "score", "doc_id", "text_hash"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("block"), F.col("at")], n).select("block", "at", "rank")
    return rows.join(best, ["block", "at"], "left").select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's texts."""
    found = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
