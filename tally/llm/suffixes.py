"""Operator 8: benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import chunks, settled, text_bytes, text_hash, whole_rows, word_hashes, word_spans

#: Window of a match in words.
WINDOW = 10
#: Bytes of test suffixes that one pass sends to all tasks; a larger benchmark is searched in as many passes as it takes.
BLOCK_BYTES = 32 << 20
#: Bytes of documents in one suffix array: every test suffix is searched once in each, so the larger the fewer searches.
SHARD_BYTES = 16 << 20
#: Bytes that a word and the suffix that begins with it take there.
SUFFIX_BYTES = 48

#: Bytes between words: all ASCII but digits and letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word of all texts, and each text's first word (one more entry closes the last)."""
    data, offsets = text_bytes(column)
    begin, end, first = word_spans(data, offsets, BETWEEN)
    return word_hashes(LOWER[data], begin, end), first


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first depth symbols (dense integers from 0).

    Prefix multiplication: each round packs as many ranks as fit in 63 bits, so ranks of 1 symbol become ranks of k,
    then k * k, and so on until all differ or depth is reached.
    """
    rank, step, n = symbols, 1, len(symbols)
    while True:
        bits = int(rank.max(initial=0) + 1).bit_length()
        times = max(2, 63 // bits)
        key = np.zeros(n, np.int64)
        for k in range(min(times, -(-depth // step))):
            key <<= bits
            key[: max(0, n - k * step)] |= rank[k * step :] + 1
        order = np.argsort(key)
        step *= times
        if step >= depth:
            return order
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])[:n]
        if n and new[order[-1]] == n - 1:
            return order
        rank = new


@dataclass
class Queries:
    """Suffixes of the test items, one for each window: words holds all items' hashes, start where a suffix begins, head where its item does."""

    ids: list[str]
    words: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    need: np.ndarray
    item: np.ndarray
    head: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Queries:
        words, first = hashed_words(pa.array([text for _, text in items], pa.large_string()))
        ids, item = np.unique(np.array([name for name, _ in items], object).astype(str), return_inverse=True)
        size = np.diff(first)
        suffixes = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        each = lambda x: np.repeat(x, suffixes)
        inside = np.arange(suffixes.sum()) - each(np.cumsum(suffixes) - suffixes)
        return cls(ids.tolist(), words, each(first[:-1]) + inside, each(first[1:]), each(np.minimum(window, size)), each(item.ravel()), each(first[:-1]))


class Shard:
    """The suffix array of some documents' words; a separator after each document stops matches at its end."""

    def __init__(self, column: pa.Array, window: int):
        hashes, first = hashed_words(column)
        self.first, self.counts = first[:-1] + np.arange(len(first) - 1), np.diff(first)
        self.vocabulary, dense = np.unique(hashes, return_inverse=True)
        self.text = np.zeros(len(hashes) + len(self.counts), np.int64)
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(self.counts)), self.counts)
        self.text[at] = dense + 1
        self.order = suffix_array(self.text, window)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The shard's numbers for words; -1 for a word that it doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray, after: bool) -> np.ndarray:
        low, high, last = low.copy(), high.copy(), len(self.text) - 1
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            place = self.order[np.minimum(middle, last)] + depth
            seen = np.where(place <= last, self.text[np.minimum(place, last)], 0)
            right = open_ & ((seen <= symbol) if after else (seen < symbol))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def find(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix whose window occurs: its number and the range of the suffix array that begins with it."""
        symbols = self.symbols(queries.words)
        live = np.flatnonzero(symbols[queries.start] > 0) if len(queries.start) else np.zeros(0, np.int64)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.text))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(live):
            symbol = symbols[queries.start[live] + depth]
            new_low = self._bound(low, high, depth, symbol, False)
            high = self._bound(new_low, high, depth, symbol, True)
            low, depth = new_low, depth + 1
            some = low < high
            full = some & (queries.need[live] == depth)
            done.append((live[full], low[full], high[full]))
            go = some & ~full
            live, low, high = live[go], low[go], high[go]
        if not done:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([d[k] for d in done]) for k in range(3))

    def occurrences(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Number of a test suffix and a place in text, for every place where its window occurs."""
        number, low, high = self.find(queries)
        count = high - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(number, count), self.order[np.repeat(low, count) + inside]

    def longest(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest verbatim matches: number of a test suffix, place and words, of each that no word before it could lengthen.

        An occurrence whose suffix and place both have a match one word before is the rest of that match.
        """
        number, place = self.occurrences(queries)
        code = lambda n, p: n * (len(self.text) + 1) + p
        before = np.maximum(number - 1, 0)
        follows = (number > 0) & (place > 0) & (queries.start[before] + 1 == queries.start[number]) & (queries.stop[before] == queries.stop[number])
        heads = ~(follows & np.isin(code(number - 1, place - 1), code(number, place)))
        number, place = number[heads], place[heads]
        symbols, length = self.symbols(queries.words), queries.need[number].copy()
        live = np.arange(len(number))
        while len(live):
            a, b = queries.start[number[live]] + length[live], place[live] + length[live]
            fits = (a < queries.stop[number[live]]) & (b < len(self.text))
            live, a, b = live[fits], a[fits], b[fits]
            live = live[symbols[a] == self.text[b]]
            length[live] += 1
        return number, place, length


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _hits(queries: Queries, window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            shard, n, ids = Shard(batch.column(2), window), batch.num_rows, queries.value.ids
            number, place, length = shard.longest(queries.value)
            edge = np.zeros(len(shard.text) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
            start, stop = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
            owner = np.searchsorted(shard.first, start, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(start - shard.first[owner]), pa.array(stop - shard.first[owner])], ["start", "stop"])
            pairs = np.unique((np.searchsorted(shard.first, place, "right") - 1) * max(1, len(ids)) + queries.value.item[number])
            doc, item = pairs // max(1, len(ids)), pairs % max(1, len(ids))
            names = pa.array([ids[k] for k in item], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard.counts.astype(np.int64)), _lists(owner, n, spans), _lists(doc, n, names)], ["doc_id", "text_hash", "n_words", "spans", "items"])

    return task


def _matches(queries: Queries, window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            shard, q = Shard(batch.column(2), window), queries.value
            number, place, length = shard.longest(q)
            owner = np.searchsorted(shard.first, place, "right") - 1
            names = pa.array([q.ids[k] for k in q.item[number]], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(q.start[number] - q.head[number]), batch.column(0).take(pa.array(owner)), pa.array(place - shard.first[owner]), pa.array(length)], ["item_id", "item_at", "doc_id", "doc_at", "words"])

    return task


def _passes(search, schema: str, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> list[DataFrame]:
    """What search finds in the documents for each block of test suffixes; a block's bytes are checked before it is sent.

    With several blocks each pass is written and its block let go before the next one is read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.coalesce(item_text_col, F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("id") + F.octet_length("text") + SUFFIX_BYTES * F.size(F.split("text", SEPARATORS))), F.lit(0)).alias("n")).first()["n"]
    blocks, found = 1 + size // block_bytes, []
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast(Queries.of([(r["id"], r["text"]) for r in part.collect()], window))
        hits = rows.mapInArrow(search(sent, window), schema)
        found.append(settled(hits) if blocks > 1 else hits)
        if blocks > 1:
            sent.unpersist()
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, spans of hit words, ids of the items found in it.

    A task builds the suffix array of each few MB of documents it reads and binary-searches every test suffix in it; the
    words of the longest matches are hit. The documents aren't shuffled. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; an item
    of fewer words than the window is one window, one without words is none. A null text has no words; a null
    item_id is the empty id; repeated rows are searched and returned each by itself. A benchmark over block_bytes is
    searched in several passes, whose results are merged per (id, text). Empty tables give no rows or no hits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>"
    found = _passes(_hits, schema, docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes)
    if len(found) == 1:
        return found[0]
    # the rows of all passes meet by (id, text); copies of a row have the same spans, so only distinct lists are held
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("doc_id", "text_hash").agg((F.count("*") / len(found)).cast("int").alias("copies"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def join_up(done, span):
        """Spans come by start: a span that reaches into the last one lengthens it."""
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when(last["stop"] >= span["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    step = F.aggregate("spans", F.array().cast("array<struct<start: bigint, stop: bigint>>"), join_up)
    return merged.withColumn("spans", step).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*found[0].columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_at, doc_id, doc_at, words): each longest verbatim match of a window or more, and where it is in item and document.

    What contamination rests on: repeated rows have their matches each, null texts none, empty tables give no rows.
    """
    schema = f"item_id string, item_at long, doc_id {docs.schema[id_col].dataType.simpleString()}, doc_at long, words long"
    out, *more = _passes(_matches, schema, docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes)
    for other in more:
        out = out.unionByName(other)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; null texts and repeated rows stay, other columns are kept as they are."""
    dirty = contamination(docs, benchmark, id_col, text_col, **options).where(F.size("items") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    rows = whole_rows(docs, id_col, text_col)
    return rows.join(dirty, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__text")), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and items found of every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
      FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
win AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
hit AS (SELECT win.r, win.i, win.k, q.item FROM win JOIN q ON win.k = q.k AND win.g = q.g),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(found.names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
