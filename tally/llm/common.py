"""What the training-data operators share: checkpoints, row keys and word spans over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.lineage import settled, shared_folder  # noqa: F401  the operators take them from here

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step inside a task works on; a longer document is taken alone.
CHUNK_BYTES = 4 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def text_hash(text: Column) -> Column:
    """With the id, this names a document: rows equal in both get equal verdicts."""
    return F.xxhash64(text)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_hash): all columns of docs as one struct, so that none can clash with ours; select("row.*") gives them back."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(id_col)).alias("doc_id"), text_hash(F.col(quoted(text_col))).alias("text_hash"))


#: Rows of a small table that one task takes, and the fewest tasks it is dealt over.
TASK_ROWS, LEAST_TASKS = 100_000, 8


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in as many tasks as so many narrow rows ask for, if it has more: empty ones cost the driver as much as full ones."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


#: A key of more rows than this, and than a thousandth of all, is joined by broadcast: there are at most a thousand such keys.
HOT_ROWS = 1000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row a key and in n how many of the total rows have that key.

    Rows of a hot key stay where they are, so none of them meet in one task; all others are shuffled. Keys have no nulls.
    """
    limit = max(HOT_ROWS, total // 1000)
    hot, rest = table.where(F.col(n) > limit), table.where(F.col(n) <= limit)
    if hot.isEmpty():
        return rows.join(table, on, how)
    met = rows.join(F.broadcast(hot), on)
    return met.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


#: Most words of 64 bits in a sieve, which is broadcast.
SIEVE_WORDS = 1 << 19


def sieve(table: DataFrame, column: str, n: int) -> DataFrame:
    """(word, bits): a bit map of the n 64-bit hashes in a column of table, some 16 bits a hash and 4 MB at most; sifted takes it."""
    words = min(SIEVE_WORDS, 1 << max(4, (n // 4).bit_length()))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(column, 58).cast("int"))
    return settled(table.groupBy(F.col(column).bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(mark).alias("bits"))).withColumn("words", F.lit(words))


def sifted(rows: DataFrame, column: str, marked: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose hash may be one of those marked in a sieve, or with others those whose hash surely is none; no row is shuffled for it.

    A sieve of too many hashes lets more rows pass, and a join must follow anyway. Hashes have no nulls.
    """
    words = marked.select("words").first()
    if words is None:
        return rows if others else rows.limit(0)
    bit = F.call_function("shiftright", F.col("__bits"), F.shiftrightunsigned(column, 58).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    met = rows.withColumn("__word", F.col(column).bitwiseAND(F.lit(words[0] - 1))).join(F.broadcast(marked.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", "left" if others else "inner")
    return met.where(F.col("__bits").isNull() | ~bit if others else bit).select(*rows.columns)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on these columns."""
    on = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        on = on & left[name].eqNullSafe(right[name])
    return on


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets that part them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most limit bytes of text, or of one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's first word (one more entry closes the last)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(between[data], out=inside[:-1])
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C55)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS[name]
    while len(have) < n:
        with np.errstate(over="ignore"):
            step = have[-1] * base
            have = np.concatenate([have, have * step])
        if len(have) <= 2 * CHUNK_BYTES:  # a longer word's powers are not held
            _POWERS[name] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from running sums over blocks of the text."""
    out, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK_BYTES, "right")))
        head, tail = begin[i], end[j - 1]
        n = int(tail - head) + 1
        up, down = _powers("up", _ODD, n), _powers("down", np.uint64(pow(int(_ODD), -1, 1 << 64)), n)
        sums = np.zeros(n, np.uint64)
        a, b = begin[i:j] - head, end[i:j] - head
        with np.errstate(over="ignore"):
            np.cumsum((data[head:tail].astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=sums[1:])
            out[i:j] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words (word hashes in, one value per start)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = np.zeros(n, np.uint64), 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                out = mixed(out * _ODD + power[done : done + n])
                done += size
            if done == length:
                return out
            power = mixed(power[:-size] * _ODD + power[size:] + np.uint64(size))
            size *= 2
