"""Operator 4: language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import chunks, mixed, settled, text_bytes

#: Dimensions of a letter's vector, and letters of an n-gram.
DIMENSIONS = 1024
GRAM = 3
#: N-grams whose vectors are in memory at once, and documents that are compared at once.
GRAMS_AT_ONCE = 8192
DOCS_AT_ONCE = 128
#: Bytes of prototypes that are sent to all tasks at once; more of them are compared in blocks, the best so far kept.
PROTOTYPE_BYTES = 64 << 20
SPACE = 0x20
_symbol: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """For each code point its symbol: letters lower-cased, all else a space."""
    if not _symbol:
        table = np.full(0x110000, SPACE, np.int32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _symbol.append(table)
    return _symbol[0]


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random vector of -1 and 1 for each code, drawn from a hash of the code."""
    blocks = mixed((codes.astype(np.uint64)[:, None] << np.uint64(20)) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64)[None])
    return np.unpackbits(mixed(blocks + np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Binds letters into n-grams: the first letter's vector rotated by n - 1 times the second's by n - 2 and so on."""
    letters, out = letter_vectors(codes, dimensions), None
    for k in range(GRAM):
        part = np.roll(letters, GRAM - 1 - k, axis=1)[grams // len(codes) ** (GRAM - 1 - k) % len(codes)]
        out = part if out is None else out * part
    return out


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the distinct n-grams, their alphabet, each place's n-gram (an index), each text's first place, and its letters.

    Runs of other characters than letters are one space, and a text begins and ends with one.
    """
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # code points before each text
    sizes = np.diff(heads)
    n = len(sizes)
    # each text between two spaces
    text = np.full(len(points) + 2 * n, SPACE, np.int32)
    text[np.arange(len(points)) + np.repeat(2 * np.arange(n) + 1, sizes)] = symbols()[points]
    first = heads[:-1] + 2 * np.arange(n)
    blank = text == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[first] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    text, start = text[keep], np.append(before[first], before[-1])
    letters = np.add.reduceat(text != SPACE, start[:-1]) if n else np.zeros(0, np.int64)
    codes = np.flatnonzero(np.bincount(text, minlength=1))
    dense = np.zeros(int(codes[-1]) + 1 if len(codes) else 1, np.int64)
    dense[codes] = np.arange(len(codes))
    text = dense[text]
    places = max(0, len(text) - GRAM + 1)
    gram = np.zeros(places, np.int64)
    for k in range(GRAM):
        gram = gram * len(codes) + text[k : k + places]
    if len(codes) ** GRAM <= 1 << 22:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        index = np.zeros(len(codes) ** GRAM, np.int64)
        index[seen] = np.arange(len(seen))
        gram = index[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    return seen, codes, gram, start, letters


def _histograms(gram: np.ndarray, start: np.ndarray, docs: range, kinds: int) -> np.ndarray:
    """Counts of n-grams (columns) in documents (rows); an n-gram that reaches into the next text is none."""
    out = np.zeros((len(docs), kinds), np.float32)
    for row, d in enumerate(docs):
        stop = max(int(start[d]), int(start[d + 1]) - GRAM + 1)
        out[row] = np.bincount(gram[start[d] : stop], minlength=kinds)
    return out


def _bundled(counts: np.ndarray, seen: np.ndarray, codes: np.ndarray, dimensions: int) -> np.ndarray:
    out = np.zeros((len(counts), dimensions), np.float64)
    for a in range(0, len(seen), GRAMS_AT_ONCE):
        out += counts[:, a : a + GRAMS_AT_ONCE] @ gram_vectors(seen[a : a + GRAMS_AT_ONCE], codes, dimensions).astype(np.float32)
    return out


def _profiles(dimensions: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            seen, codes, gram, start, letters = gram_counts(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            names, owner = np.unique(langs.astype(str), return_inverse=True)
            counts = np.zeros((len(names), len(seen)), np.float64)
            for d in range(len(langs)):
                stop = max(int(start[d]), int(start[d + 1]) - GRAM + 1)
                if letters[d]:
                    counts[owner[d]] += np.bincount(gram[start[d] : stop], minlength=len(seen))
            for name, vector in zip(names.tolist(), _bundled(counts, seen, codes, dimensions)):
                total[name] = total.get(name, 0.0) + vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.round().astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    return task


def prototypes(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, place, value): per language the sum of its texts' n-gram vectors, of all rows with a lang."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    partial = rows.mapInArrow(_profiles(dimensions), "lang string, vector array<long>")
    return partial.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))


def _predictions(known, dimensions: int):
    """Names the nearest of a block of prototypes where it is nearer than what an earlier block gave (lang_pred, score)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = known.value
        for batch in chunks(batches, "text"):
            seen, codes, gram, start, letters = gram_counts(batch.column(2))
            langs, scores = batch.column(3).to_pylist(), batch.column(4).to_numpy().copy()
            vectors = [gram_vectors(seen[a : a + GRAMS_AT_ONCE], codes, dimensions).astype(np.float32) for a in range(0, len(seen), GRAMS_AT_ONCE)] if len(seen) <= 4 * GRAMS_AT_ONCE else None
            for top in range(0, batch.num_rows, DOCS_AT_ONCE):
                docs = range(top, min(batch.num_rows, top + DOCS_AT_ONCE))
                counts = _histograms(gram, start, docs, len(seen))
                if vectors is None:
                    bundle = _bundled(counts, seen, codes, dimensions)
                else:
                    bundle = np.zeros((len(docs), dimensions), np.float32)
                    for k, part in enumerate(vectors):
                        bundle += counts[:, k * GRAMS_AT_ONCE : (k + 1) * GRAMS_AT_ONCE] @ part
                norm = np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
                cosine = bundle / norm @ matrix.T
                best = cosine.argmax(axis=1)
                for row, k, near in zip(docs, best.tolist(), cosine[np.arange(len(docs)), best].tolist()):
                    if letters[row] and near > scores[row]:
                        langs[row], scores[row] = names[k], near
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "text", "lang_pred", "score"])

    return task


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, block_bytes: int = PROTOTYPE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred and score, the cosine with the nearest prototype.

    Prototypes come from all rows with a lang whose crc32(id as text) mod 5 is not 0 (held_out is false); a null id
    counts as an empty one. A text that is null or has no letters, or a table with no language to learn, gives und
    and 0. Equal cosines go to the first lang by code point. Repeated rows are learned and judged each; an empty table
    gives no rows. Whole texts are read, and no other column in predicting.
    """
    spark = docs.sparkSession
    held_out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out")
    learned = settled(prototypes(docs.where(~held_out), lang_col, text_col, dimensions))
    names = [r["lang"] for r in learned.select("lang").distinct().orderBy("lang").collect()]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out, F.coalesce(text_col, F.lit("")).alias("text"), F.lit("und").alias("lang_pred"), F.lit(-2.0).alias("score"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, text string, lang_pred string, score double"
    block = max(1, block_bytes // (8 * dimensions))
    for top in range(0, len(names), block):
        of_block = learned.where(F.col("lang").between(names[top], names[min(len(names), top + block) - 1]))
        table = of_block.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector")).orderBy("lang").collect()
        matrix = np.array([r["vector"] for r in table], np.float64)
        matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        rows = rows.mapInArrow(_predictions(spark.sparkContext.broadcast(([r["lang"] for r in table], matrix)), dimensions), schema)
    return rows.select("doc_id", "held_out", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
