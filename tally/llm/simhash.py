"""Operator 10: near-duplicates by SimHash fingerprints, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import chunks, hot_join, settled, text_bytes, text_hash, whole_rows
from tally.llm.components import components

BITS = 64
#: Rows of fingerprints that one block compares with each other; groups beyond it are cut finer.
BLOCK_ROWS = 2048
#: Shingles whose bits are counted at once.
STEP = 1 << 15


_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the lower-cased text's word shingles, so many at once; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return
    joined, size = b" ".join(words), min(shingle, len(words))
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest, total = xxhash.xxh64_intdigest, len(words) - size + 1
    for first in range(0, total, STEP):
        last = min(total, first + STEP)
        yield np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(at[first:last], at[first + size : last + size])), np.uint64, last - first)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half the shingles' hashes."""
    lanes, total = np.zeros((8, 256), np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        lane = hashes[:, None].view(np.uint8).reshape(len(hashes), 8) + np.arange(0, 8 * 256, 256)
        lanes += np.bincount(lane.ravel(), minlength=8 * 256).reshape(8, 256)
    return int(np.packbits(2 * (lanes @ _BIT).ravel() > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row for each row of docs.

    A null text has no words, and no words give a fingerprint of zeros.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Fingerprints of one or more words as bit planes: plane b packs bit b of all values, 64 values to a word."""
    values = values.reshape(len(values), -1)
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_masks(left: np.ndarray, right: np.ndarray, radius: int, lanes: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of left rows its first row and, a row each, the right ones at Hamming distance <= radius as packed bits.

    Distances of one left value to 64 right ones grow in bitwise counters: carry-save adders take planes two at a
    time, counter k holds weight 2**k, and a carry out of the top counter marks the lane as beyond the radius.
    A block of left rows is abandoned once every lane in it is marked, and then isn't returned.
    """
    if not len(left) or not len(right):
        return
    left = left.reshape(len(left), -1)
    sliced, levels = planes(right), max(1, int(radius).bit_length())
    valid = np.packbits(np.arange(sliced.shape[1] * 64) < len(right), bitorder="little").view(np.uint64)
    for top in range(0, len(left), lanes):
        block = left[top : top + lanes]
        ones = np.unpackbits(np.ascontiguousarray(block).view(np.uint8), axis=1, bitorder="little")
        flips = np.where(ones, ~np.uint64(0), np.uint64(0))
        far = np.broadcast_to(~valid, (len(block), sliced.shape[1])).copy()
        counters = [np.zeros_like(far) for _ in range(levels)]
        for plane in range(0, len(sliced), 2):
            a, b = sliced[plane][None] ^ flips[:, plane, None], sliced[plane + 1][None] ^ flips[:, plane + 1, None]
            half = a ^ b
            carry = (a & b) | (half & counters[0])
            counters[0] ^= half
            for k in range(1, levels):
                up = counters[k] & carry
                counters[k] ^= carry
                carry = up
            far |= carry
            if plane % 8 == 6 and bool((far == ~np.uint64(0)).all()):
                break
        else:
            # the counters hold 0 .. 2**levels - 1; compare with the radius from the top bit down
            more, equal = np.zeros_like(far), ~np.zeros_like(far)
            for k in reversed(range(levels)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            yield top, ~(far | more)


def within(left: np.ndarray, right: np.ndarray, radius: int, lanes: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) at Hamming distance <= radius."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for top, near in near_masks(left, right, radius, lanes):
        rows, words = np.nonzero(near)
        at, bit = np.nonzero(np.unpackbits(near[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        pairs.append((rows[at] + top, words[at] * 64 + bit))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The links that join what was apart: at most n - 1 of them, so a group of copies never sends all its pairs."""
    up, kept = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links_in_block(radius: int):
    def task(table: pa.Table) -> pa.Table:
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        left, right = within(values, values, radius)
        order = left < right
        kept = np.array(_spanning(left[order], right[order], len(values)), np.int64).reshape(-1, 2)
        return pa.table({"u": values[kept[:, 0]].view(np.int64), "v": values[kept[:, 1]].view(np.int64)})

    return task


def _bits(offset: int, width: int):
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, radius: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs at distance <= radius would.

    Fingerprints within the radius agree on one of radius + 1 bands. Rows meet by a band's leading bits, as many as
    keep a block near its size; a block too large is cut by the whole band, then by a band of the other bits, and
    what is still too large is compared in tiles. No case is dropped at any step.
    """
    if radius <= 0:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    bands = radius + 1
    width = BITS // bands
    narrow = (BITS - width) // bands
    lead = max(0, min(width, (distinct.count() // (block_rows // 2)).bit_length()))

    def blocks(level: int):
        """The blocks a row is compared in: hashes of the values that its rows share."""
        made = []
        for band in range(bands):
            whole = _bits(band * width, width)
            if level == 0:
                made.append(F.xxhash64(F.lit(band), F.shiftrightunsigned(whole, width - lead)))
            elif level == 1:
                made.append(F.xxhash64(F.lit(band), whole))
            else:
                below = _bits(0, band * width) if band else F.lit(0).cast("long")
                above = F.shiftleft(F.shiftrightunsigned("fp", (band + 1) * width), band * width) if (band + 1) * width < BITS else F.lit(0).cast("long")
                rest = below.bitwiseOR(above)
                made += [F.xxhash64(F.lit(band), whole, F.lit(sub), F.shiftrightunsigned(rest, sub * narrow).bitwiseAND(F.lit((1 << narrow) - 1))) for sub in range(bands)]
        return F.explode(F.array(*made))

    out, rows = None, distinct.select("fp")
    for level in range(3):
        keyed = rows.select(blocks(level).alias("block"), "fp")
        sizes = keyed.groupBy("block").agg(F.count("*").alias("n"))
        large = settled(sizes.where(F.col("n") > 2 * block_rows))
        any_large = not large.isEmpty()
        fit = keyed.join(large, "block", "left_anti") if any_large else keyed
        found = fit.groupBy("block").applyInArrow(_links_in_block(radius), "u long, v long")
        out = found if out is None else out.union(found)
        if not any_large:
            return out
        rows = keyed.join(large, "block", "left_semi").select("fp").distinct() if level < 2 else keyed.join(large, "block")
    # every pair of parts meets in one tile
    tiles = rows.withColumn("parts", F.ceil(F.col("n") / block_rows)).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = tiles.select("block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp")
    return out.union(tiles.groupBy("block", "a", "b").applyInArrow(_links_in_block(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row of docs; root names the component, ids or not.

    Rows link at fingerprints within the radius, every such pair; component_id is the smallest id among all that links
    reach (null only where all ids are). Equal texts share a fingerprint, so a group of copies is one node however
    large. Null and empty texts, and texts without words, have fingerprint 0 and link like any other. Repeated rows
    are repeated in the result. An empty table gives an empty result. Columns other than the two are not read.
    """
    prints = settled(fingerprints(docs, id_col, text_col, shingle))
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = settled(distinct.join(roots, "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "n", "root", "component_id")
    return hot_join(prints, settled(named), ["fp"], "n", prints.count()).select("doc_id", "text_hash", "fp", "root", "component_id")


def first_row(id_col: str = "doc_id", text_col: str = "text_hash") -> Column:
    """What orders rows by id, then text hash, nulls last; the smallest of a group is the row that stays."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("no_text"), F.col(text_col).alias("text_hash"))


def only_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose (id, text) stand in stay (doc_id, text_hash), one row each.

    Of rows that repeat both the first by all its columns stays; they meet by a hash of all columns before one is chosen.
    """
    wanted = stay.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"))
    met = whole_rows(docs, id_col, text_col).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__text")))
    twice = settled(met.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")))
    if twice.isEmpty():
        return met.select("row.*")
    again = F.col("doc_id").eqNullSafe(twice["__id"]) & F.col("text_hash").eqNullSafe(twice["__text"])
    met = met.select("row", "doc_id", "text_hash")
    chosen = met.join(twice, again, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return met.join(twice, again, "left_anti").select("row").unionByName(chosen.select("row")).select("row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component of near_duplicates the smallest by (id, text hash), nulls last.

    Rows without words count as one component; of rows that repeat id and text one stays. Other columns are kept as they are.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    stay = found.groupBy("root").agg(F.min(first_row()).alias("first"))
    return only_rows(docs, settled(stay.select("first.doc_id", "first.text_hash")), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
