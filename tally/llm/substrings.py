"""Operator 6: substring dedup by compressed FM-indexes over shards of repeated passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import _ODD, chunks, hot_join, mixed, run_hashes, settled, sieve, sifted, text_bytes, text_hash, word_hashes, word_spans
from tally.llm.suffixes import suffix_array

#: Words of a window whose repeats are removed.
WINDOW = 35
#: Words of the grams whose smallest hash in a window says to which shard it goes.
GRAM = 8
#: Distinct segments of one shard's index, about.
SHARD_SEGMENTS = 4_000
#: Distinct segments of one gram that a shard takes; those of a gram with more are cut again by grams twice as long.
GRAM_SEGMENTS = 2_000
#: A table of fewer keys, 8 bytes each, is broadcast.
SMALL_KEYS = 1 << 20


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each run of width values."""
    n = len(values) - width + 1
    value, place, size = values, np.arange(len(values)), 1
    best_value = best_place = None
    done = 0
    while True:
        if width & size:
            v, p = value[done : done + n], place[done : done + n]
            if best_value is None:
                best_value, best_place = v, p
            else:
                less = v < best_value
                best_value, best_place = np.where(less, v, best_value), np.where(less, p, best_place)
            done += size
        if done == width:
            return best_place
        less = value[size:] < value[:-size]
        value, place = np.where(less, value[size:], value[:-size]), np.where(less, place[size:], place[:-size])
        size *= 2


class Segments:
    """Maximal runs of consecutive windows of a document that share the place of their smallest gram.

    Equal windows have the same smallest gram, so they come to the same shard whatever surrounds them; and every
    window of a document is in one segment. begin counts words of all texts, key is the gram's hash, content the
    segment's, windows how many it has (at most window - gram + 1).
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int, gram: int):
        counts = np.maximum(0, np.diff(first) - window + 1)
        starts = np.arange(counts.sum()) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
        if not len(starts):
            self.begin = self.windows = self.doc = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        grams = run_hashes(words, gram)
        place = _smallest(grams, window - gram + 1)[starts]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
        at = np.flatnonzero(new)
        self.begin, self.windows = starts[at], np.diff(np.append(at, len(starts)))
        self.doc = np.repeat(np.arange(len(counts)), counts)[at]
        self.key = grams[place[at]]
        power, down = np.empty(len(words) + 1, np.uint64), np.empty(len(words) + 1, np.uint64)
        power[0] = down[0] = 1
        power[1:], down[1:] = _ODD, np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            power, down = np.cumprod(power), np.cumprod(down)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * power[:-1], out=sums[1:])
            size = self.windows + window - 1
            self.content = mixed((sums[self.begin + size] - sums[self.begin]) * down[self.begin] + size.astype(np.uint64))


class WaveletMatrix:
    """A sequence of small integers as one bit vector a bit, each with counts a word, for rank queries."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits, self.n = max(1, (symbols - 1).bit_length()), len(values)
        self.words, self.before, self.zeros = [], [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            raw = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[~one], values[one]])
        self.origin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(reversed(range(self.bits))):
            word, inside = place >> 6, (place & 63).astype(np.uint64)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << inside) - np.uint64(1)))
            place = np.where(symbol >> bit & 1, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._descend(symbol, place) - self.origin[symbol]


class RunLengths:
    """A sequence compressed to its runs of equal symbols: a wavelet matrix over one symbol a run, and where runs start.

    Passages that repeat stand in equal contexts, so their transform has far fewer runs than words.
    """

    def __init__(self, values: np.ndarray, symbols: int):
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.heads = values[self.starts].astype(np.int32)
        length = np.diff(np.append(self.starts, len(values)))
        order = np.argsort(self.heads, kind="stable")
        self.first = np.searchsorted(self.heads[order], np.arange(symbols + 1))
        self.sums = np.concatenate([[0], np.cumsum(length[order])])
        self.matrix, self.starts = WaveletMatrix(self.heads, symbols), np.append(self.starts, len(values))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place: in whole runs, and in the run that the place is in."""
        run = np.searchsorted(self.starts, place, "right") - 1
        whole = self.first[symbol] + self.matrix.rank(symbol, run)
        inside = np.where(self.heads[np.minimum(run, len(self.heads) - 1)] == symbol, place - self.starts[run], 0)
        return self.sums[whole] - self.sums[self.first[symbol]] + inside


class FMIndex:
    """Backward search over the run-length compressed Burrows-Wheeler transform of texts, each closed by the symbol 0.

    Occurrences weigh as much as their text, so a text that stands for n equal ones is indexed once.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        order = suffix_array(text, depth)
        symbols = int(text.max(initial=0)) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.transform = RunLengths(text[order - 1], symbols)
        self.weights = np.concatenate([[0], np.cumsum(weight[order])])
        self.n = len(text)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with the symbol and go on as the ranges given."""
        both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.smaller[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weights[high] - self.weights[low]


def repeated_windows(text: np.ndarray, begin: np.ndarray, size: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Per segment a mask: bit j is set if the window from its word j on weighs two or more in the index of all segments.

    Matching statistics by backward search: from an end, how far to the left does a repeated string reach? All
    windows inside it are repeated; the window that begins just before it may still be, from an end further left.
    """
    index = FMIndex(text, weight, int(size.max(initial=0)) + 1)
    mask, end = np.zeros(len(begin), np.int64), size.copy()
    live = np.flatnonzero(size >= window)
    left, low, high = end[live].copy(), np.zeros(len(live), np.int64), np.full(len(live), index.n)
    while len(live):
        symbol = text[begin[live] + left - 1]
        new_low, new_high = index.back(symbol, low, high)
        goes = index.weight(new_low, new_high) >= 2
        low, high, left = np.where(goes, new_low, low), np.where(goes, new_high, high), left - goes
        stop = ~goes | (left == 0)
        if stop.any():
            at, reach = live[stop], left[stop]
            last = end[at] - window
            found = last - reach + 1
            mask[at] |= np.where(found > 0, ((np.int64(1) << np.maximum(found, 0)) - 1) << reach, 0)
            end[at] = np.where(found > 0, reach - 1 + window, end[at] - 1)
            left[stop], low[stop], high[stop] = end[at], 0, index.n
            going = np.ones(len(live), bool)
            going[stop] = end[at] >= window
            live, left, low, high = live[going], left[going], low[going], high[going]
    return mask


def _search_shard(window: int):
    def task(table: pa.Table) -> pa.Table:
        # a row of the documents that repeats brings its segments again
        key, content = (table.column(c).to_numpy() for c in ("key", "content"))
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        table = table.take(pa.array(order[np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])]))
        data, offsets = text_bytes(table.column("words"))
        start, stop, first = word_spans(data, offsets)
        words, n = word_hashes(data, start, stop), table.num_rows
        size = np.diff(first)
        text = np.zeros(len(words) + n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(n), size)] = np.unique(words, return_inverse=True)[1] + 1
        weight = np.repeat(table.column("n").to_numpy(), size + 1)
        mask = repeated_windows(text, first[:-1] + np.arange(n), size, weight, window)
        return pa.table({"key": table.column("key"), "content": table.column("content"), "mask": mask})

    return task


def _segments_of(window: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(batch.column(2))
            start, stop, first = word_spans(data, offsets)
            found = Segments(word_hashes(data, start, stop), first, window, gram)
            doc = pa.array(found.doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.key.view(np.int64)), pa.array(found.content.view(np.int64)), batch.column(0).take(doc), batch.column(1).take(doc), pa.array((found.begin - first[found.doc]).astype(np.int32)), pa.array(found.windows.astype(np.int32))],
                ["key", "content", "doc_id", "text_hash", "begin", "windows"],
            )

    return task


def _contents(window: int):
    """Cuts the wanted segments' words out of whole texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(batch.column(0))
            start, stop, first = word_spans(data, offsets)
            wanted = batch.column(1)
            rows, owner = wanted.flatten(), pc.list_parent_indices(wanted).to_numpy()
            begin = first[owner] + rows.field("begin").to_numpy()
            words = pa.array([b" ".join(data[start[k] : stop[k]].tobytes() for k in range(a, a + n)) for a, n in zip(begin.tolist(), (rows.field("windows").to_numpy() + window - 1).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.field("key"), rows.field("content"), rows.field("n"), words.cast(pa.string())], ["key", "content", "n", "words"])

    return task


def _cut_again(window: int, gram: int):
    """The segments of these segments' windows by grams of so many words; place says where each lies in its parent."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "words"):
            data, offsets = text_bytes(batch.column(3))
            start, stop, first = word_spans(data, offsets)
            found = Segments(word_hashes(data, start, stop), first, window, gram)
            parent = pa.array(found.doc)
            last = found.begin + found.windows + window - 2
            words = pa.array([data[start[a] : stop[b]].tobytes() for a, b in zip(found.begin.tolist(), last.tolist())], pa.binary()).cast(pa.string())
            of, within = batch.column(0).take(parent), batch.column(1).take(parent)
            yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64)), pa.array(found.content.view(np.int64)), batch.column(2).take(parent), words, of, within, pa.array((found.begin - first[found.doc]).astype(np.int32))], ["key", "content", "n", "words", "of", "within", "place"])

    return task


def _kept_words(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            start, stop, first = word_spans(data, offsets)
            hits = batch.column(2)
            rows, owner = hits.flatten(), pc.list_parent_indices(hits).to_numpy()
            edge = np.zeros(len(start) + 1, np.int32)
            mask = rows.field("mask").to_numpy()[:, None] >> np.arange(window) & 1
            at, bit = np.nonzero(mask)
            begin = first[owner[at]] + rows.field("begin").to_numpy()[at] + bit
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
            kept = np.cumsum(edge[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(kept)])[first]
            place = np.flatnonzero(kept)
            texts = [b" ".join(data[start[k] : stop[k]].tobytes() for k in place[a:b]).decode() for a, b in zip(before[:-1], before[1:])]
            total = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(total - np.diff(before), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return task


def segment_masks(segments: DataFrame, weights: DataFrame, window: int, gram: int, gram_segments: int = GRAM_SEGMENTS) -> DataFrame:
    """(key, content, mask) of the segments (key, content, n, words), keyed by grams of so many words; weights has key and n of each.

    Grams go to shards, and an FM-index of each answers. A gram with very many segments (a passage in ever new
    contexts) is no shard's: its segments are cut again, by the smallest gram of twice the length in each window, up to
    the window itself: there a segment is its key, so the weights have decided, by 64-bit hashes, before an index is asked. Equal windows meet at each length. Segments meet no table but the few grams of very many, so
    their words are shuffled once, to their shards.
    """
    many, rows = settled(weights.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > F.lit(gram_segments if gram < window else 1 << 62))), weights.count()
    known = many.agg(F.count("*").alias("keys"), F.coalesce(F.sum("m"), F.lit(0)).alias("segments")).first()
    if known["keys"]:
        segments = settled(segments)
    keys = F.broadcast(many.select("key")) if known["keys"] < SMALL_KEYS else many.select("key")
    fit = segments.join(keys, "key", "left_anti") if known["keys"] else segments
    shards = 1 + (rows - known["segments"]) // SHARD_SEGMENTS
    masks = fit.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "content", "n", "words").groupBy("shard").applyInArrow(_search_shard(window), "key long, content long, mask long")
    if not known["keys"]:
        return masks
    longer = min(2 * gram, window)
    large = segments.join(keys, "key", "left_semi")
    cut = large.select("key", "content", "n", "words").dropDuplicates(["key", "content"]).mapInArrow(_cut_again(window, longer), "key long, content long, n long, words string, of long, within long, place int")
    # most windows of a passage in ever new contexts are unique by now, and go before their words are shuffled
    heavy = settled(cut.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    cut = cut.join(F.broadcast(heavy) if heavy.count() < SMALL_KEYS else heavy, "key", "left_semi")
    places = settled(cut.drop("words", "n"))
    distinct = settled(cut.groupBy("key", "content").agg(F.sum("n").alias("n"), F.first("words").alias("words")))
    found = segment_masks(distinct, distinct, window, longer, gram_segments).where("mask <> 0")
    back = places.join(found, ["key", "content"])
    back = back.groupBy(F.col("of").alias("key"), F.col("within").alias("content")).agg(F.bit_or(F.call_function("shiftleft", F.col("mask"), F.col("place"))).alias("mask"))
    return masks.unionByName(back)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, gram_segments: int = GRAM_SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, begin, mask): bit j of mask says that the window from word begin + j on occurs anywhere else.

    Segments of windows are keyed by their smallest gram; a gram that occurs once can't be in a repeated window. Equal
    segments are one with a weight; segment_masks has the distinct ones' windows looked up. A window has at most
    gram + 62 words, for a segment's windows are bits of one number.
    """
    if not gram <= window < gram + 63:
        raise ValueError(f"a window of {window} words takes grams of {max(1, window - 62)} to {window}")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    segments = rows.mapInArrow(_segments_of(window, gram), f"key long, content long, doc_id {kind}, text_hash long, begin int, windows int")
    twice = settled(segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    known = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("keys")).first()
    total = known["n"]
    # most segments' grams occur once, and most texts hold no segment's first occurrence: those are not shuffled
    found = settled(hot_join(sifted(segments, "key", sieve(twice, "key", known["keys"])), twice, ["key"], "n", total).drop("n"))
    distinct = settled(found.groupBy("key", "content").agg(F.count("*").alias("n"), F.min_by(F.struct("doc_id", "text_hash", "begin", "windows"), F.struct(F.col("text_hash"), F.col("begin"))).alias("at")))
    wanted = distinct.select("at.doc_id", "at.text_hash", F.struct("key", "content", "n", "at.begin", "at.windows").alias("segment"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("segment").alias("segments")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__text"})
    wanted = settled(wanted)
    rows = sifted(rows, "text_hash", sieve(wanted, "__text", wanted.count()))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["__id"]) & rows["text_hash"].eqNullSafe(wanted["__text"])).select("text", "segments")
    contents = texts.mapInArrow(_contents(window), "key long, content long, n long, words string")
    masks = settled(segment_masks(contents, distinct, window, gram, gram_segments).where("mask <> 0"))
    weighed = masks.join(distinct.select("key", "content", "n"), ["key", "content"])
    return hot_join(found, settled(weighed), ["key", "content"], "n", total).select("doc_id", "text_hash", "begin", "mask")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, gram_segments: int = GRAM_SEGMENTS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed and kept_text, its words outside repeated windows.

    Words part at ASCII white space and are kept as they are, joined by one blank. A null text has no words; rows that
    repeat are each other's repeats and lose all windows; ids may be null or repeat; an empty table gives no rows; a
    long text is read whole, in a step of its own; other columns are not read.
    """
    hits = repeated_passages(docs, id_col, text_col, window, gram, gram_segments).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "mask")).alias("hits")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__text"})
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = settled(hits)
    marked = sieve(hits, "__text", hits.count())
    some, others = sifted(rows, "text_hash", marked), sifted(rows, "text_hash", marked, others=True)
    joined = some.join(hits, some["doc_id"].eqNullSafe(hits["__id"]) & some["text_hash"].eqNullSafe(hits["__text"]), "left").select("doc_id", "text", "hits")
    joined = joined.unionByName(others.select("doc_id", "text", F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")))
    return joined.mapInArrow(_kept_words(window), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones of every document."""
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM twice) GROUP BY r),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d)
         ANTI JOIN (SELECT r, unnest(ps) AS p FROM gone) USING (r, p) GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
