"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.llm.common import gathered, settled, text_hash, whole_rows
from tally.llm.quality import SPACES, SYMBOLS, words_of

#: Rows that one window partition of a source's prefix sum holds about.
BUCKET_ROWS = 4000


def quality_weight(word_chars: Column, symbols: Column, size: Column) -> Column:
    """Between 0.25 and 1: halved as the mean word is far from 4.5 code points, and once more as symbols take the place of words.

    Both are the counts of quality.document_metrics; 0.5 without words.
    """
    words = F.greatest(size, F.lit(1))
    shape, clean = 0.5 + 0.5 * F.exp(-F.abs(word_chars / words - 4.5) / 4.5), 1 - 0.5 * F.least(F.lit(1.0), symbols / words)
    return F.when(size > 0, shape * clean).otherwise(F.lit(0.5))


def targets(sizes: DataFrame, shares: tuple[float, ...] = (5, 2, 1), epochs: float = 3, total: float | None = None) -> DataFrame:
    """(source, source_size, docs, mean_weight, target): the shares repeat over sources by code point, null last.

    A target stops at epochs times its source's size; the excess is shared anew by weight until none is above. In the
    order of epochs * size / weight the sources that stop come first, and what is left for the rest, by weight, is
    largest at the first that doesn't stop; so one pass of prefix sums finds the level. Works on one row a source; an empty table gives none.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.avg("weight").alias("mean_weight"))
    per = per.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(shares))
    per = per.withColumns({"share": F.element_at(F.array(*(F.lit(float(x)) for x in shares)), F.col("turn") + 1), "cap": F.col("source_size") * float(epochs)})
    before = Window.orderBy(F.col("cap") / F.col("share"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    whole = F.sum("source_size").over(everything).cast("double") if total is None else F.lit(float(total))
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("share").over(everything) - F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    return per.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("share"))).select("source", "source_size", "docs", "mean_weight", "target")


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("source", "__source"), left["source"].eqNullSafe(F.col("__source"))).drop("__source")


def _prefix(rows: DataFrame, amount: str, out: str, n: int | None = None) -> DataFrame:
    """Adds to each row the sum of amount over the rows of its source that come before it by (bucket, key, id, hash).

    Sums within (source, bucket) and the buckets' own prefix sums add up to it, so no task takes a whole source. Steps take as few tasks as n rows need, if it is given.
    """
    few = (lambda df: df) if n is None else (lambda df: gathered(df, n))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    buckets = few(rows.groupBy("source", "bucket").agg(F.sum(amount).alias("__sum")))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few(buckets.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__offset")))
    summed = few(rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))))
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket")))
    return joined.withColumn(out, F.col("__inside") + F.col("__offset")).drop("__source", "__bucket", "__inside", "__offset")


def _left_over(rows: DataFrame, tolerance: float) -> DataFrame:
    """Row ids of documents taken once beyond the prefix (once is false there) of sources that miss their target by more than tolerance of it.

    First fit in key order: of the rows that still fit into what is left, those are taken whose prefix sum does; what
    was too large never fits again, so rounds over ever fewer and smaller rows do what one pass in order would. When
    none fits, the smallest row left is taken if that is nearer to the target than to leave it.
    """
    missing = F.first("gap") - F.sum(F.when(F.col("once"), F.col("size")).otherwise(0))
    left = settled(rows.groupBy("source").agg(F.first("target").alias("target"), missing.alias("left")).where((F.col("left") > 0.5) & (F.col("left") > tolerance * F.col("target"))).select("source", "left"))
    free = settled(_same_source(rows.where("NOT once AND size > 0").select("row_id", "source", "bucket", "key", "doc_id", "text_hash", "size"), left))
    found, rest, sources, n = free.select("row_id").limit(0), settled(free.where("size <= left")), left.count(), 0
    left = gathered(left, sources)
    while n := rest.count():
        rest = settled(gathered(_prefix(gathered(rest, n), "size", "before", n).withColumn("fits", F.col("before") + F.col("size") <= F.col("left")), n))
        found = found.unionByName(rest.where("fits").select("row_id"))
        used = gathered(rest.where("fits").groupBy("source").agg(F.sum("size").alias("used")), sources)
        left = settled(gathered(left.join(used.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), sources))
        rest = settled(gathered(_same_source(rest.where("NOT fits").drop("left", "before", "fits"), left).where("size <= left"), n))
    smallest = _same_source(free.drop("left").join(found, "row_id", "left_anti"), left).where("size < 2 * left")
    return found.unionByName(smallest.groupBy("source").agg(F.min(F.struct("size", "key", "doc_id", "text_hash", "row_id")).alias("x")).select("x.row_id"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    shares: tuple[float, ...] = (5, 2, 1),
    epochs: int = 3,
    total: float | None = None,
    seed: int = 0,
    tolerance: float = 0.001,
) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, source, size, source_size, target, copies and taken (words).

    A document's key is an exponential variable over its quality weight, drawn from a hash of seed, id and text, so
    reruns agree; weight is a positive column, by default quality_weight. A source whose target is above its size
    first takes whole epochs of all its documents; what is left of the target goes to documents by ascending key
    while their prefix sum stays within it. A source that then misses its target by more than tolerance of it goes on
    past the first document that is too large: whatever still fits is taken in key order, and at last the smallest
    document left, if that brings the sum nearer. So a source misses its target by at most half of the smallest document that it could
    still take, or by tolerance. No document is cut, and none is taken more than epochs times. Null texts have size 0;
    null sources are one source, last in order; rows that repeat are documents of their own; an empty table gives none.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), *([F.length(F.translate(text, SPACES, "")).alias("chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols")] if weight is None else [weight.cast("double").alias("weight")]))
    if weight is None:
        rows = rows.withColumn("weight", quality_weight(F.col("chars"), F.col("symbols"), F.col("size"))).drop("chars", "symbols")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = settled(rows.withColumn("key", -F.log(uniform) / F.col("weight")).withColumn("row_id", F.monotonically_increasing_id()))
    goals = settled(targets(rows, shares, epochs, total))
    rows = _same_source(rows, goals)
    # a key's bucket follows its order: keys of mean weight are even in 1 - exp(-key * mean)
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * F.ceil(F.col("docs") / BUCKET_ROWS)))
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)))
    rows = rows.withColumn("gap", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    rows = _prefix(rows, "size", "before")
    rows = settled(rows.withColumn("once", (F.col("before") + F.col("size") <= F.col("gap")) & (F.col("gap") > 0.5)))
    more = settled(_left_over(rows, tolerance)).withColumn("more", F.lit(True))
    rows = rows.join(more, "row_id", "left").withColumn("taken_once", F.col("once") | F.coalesce("more", F.lit(False)))
    copies = F.col("whole") + F.col("taken_once").cast("long")
    return rows.withColumn("copies", copies.cast("long")).select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; other columns are kept as they are.

    Documents without words, null texts among them, count in no budget and stay once. Of rows that repeat id, text and
    source, at a budget's boundary only some are taken once more: the first by a hash of all columns. An empty table
    gives no rows.
    """
    plan = mixture(docs, id_col, text_col, source_col, **options)
    times = plan.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("source").alias("__source"), F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies"))
    times = times.groupBy("__id", "__text", "__source").agg(F.min("copies").alias("least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    times = settled(times.where("least > 0 OR more > 0"))
    rows = whole_rows(docs, id_col, text_col).withColumn("source", F.col("row")[source_col])
    met = rows.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__text")) & F.col("source").eqNullSafe(F.col("__source")))
    place = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "source").orderBy(F.xxhash64("row")))
    uneven = met.where("more > 0").withColumn("copies", F.col("least") + (place <= F.col("more")).cast("long")).where("copies > 0")
    every = met.where("more = 0").select("row", F.col("least").alias("copies")).unionByName(uneven.select("row", "copies"))
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
