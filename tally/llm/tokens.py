"""Operator 13: token counts by public tokenizers, encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import CHUNK_BYTES, chunks, quoted, text_bytes

#: Letters of every version of Unicode that a tokenizer may have been built with.
LETTERS = "A-Za-zÀ-ÖØ-öЀ-ҁぁ-ゔァ-ヺ一-龥가-힣"
#: Where the byte-level pattern ends a token whatever stands around: before white space, and where letters or digits end.
BYTE_LEVEL = re.compile(rf"(?<=[!-~{LETTERS}])(?=[ \t\n\r])|(?<=[{LETTERS}])(?=[ -@\[-`{{-~、。，])|(?<=[0-9])(?=[ -/:-~])")
#: One blank between words: each piece gets the blank that a piece starts with, so this one is left out.
BLANK = re.compile(r"(?<=[!-~]) (?=[!-~])")

#: Such a cut at one blank, which the piece after it begins with.
BEFORE_BLANK = re.compile(rf"(?<=[!-~{LETTERS}]) ")
#: Characters of a word whose count a task remembers, and words that it remembers.
WORD_CHARS, KNOWN_WORDS = 64, 1 << 18

Encode = Callable[[list[str]], list[int]]


def place(tokenizer: str) -> str:
    """The file's path: as given, or that of a public tokenizer of this name where the task runs."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _json(path: str) -> tuple[Encode, re.Pattern | None, list[str]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    before = own.get("pre_tokenizer") or {}
    plain = own.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = own.get("added_tokens", [])
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return lambda texts: [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)], BYTE_LEVEL if plain else None, [t["content"] for t in added]


def _model(path: str) -> tuple[Encode, re.Pattern | None, list[str]]:
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_file=path)
    pieces = (made.id_to_piece(i) for i in range(made.vocab_size()))
    apart = not any("▁" in p.lstrip("▁") for p in pieces) and made.encode("a b") == made.encode("a") + made.encode("b")
    return lambda texts: [len(x) for x in made.encode(texts, num_threads=1)], BLANK if apart else None, []


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> tuple[Encode, re.Pattern | None, list[str]]:
    """What encodes texts to their lengths, where a text may be cut (None: nowhere known), and strings no cut may touch."""
    return _model(path) if path.endswith(".model") else _json(path)


def pieces_of(text: str, length: int, cuts: re.Pattern | None, whole: list[str]) -> Iterator[str]:
    """The text in pieces of about length characters whose tokens are together the text's own; longer where there is no safe cut."""
    first = 0
    reach = max((len(s) for s in whole), default=1)
    if cuts is not None:
        at = length
        while at < len(text):
            found = cuts.search(text, at)
            if found is None:
                break
            low = max(first, found.start() - reach + 1)
            if any(s in text[low : found.end() + reach - 1] for s in whole):  # near a special string: go past it
                at = found.end() + reach
                continue
            yield text[first : found.start()]
            first = found.end()
            at = first + length
    yield text[first:]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, piece: int = 1 << 16, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit).

    tokenizer is a .json file of the library tokenizers or a .model file of sentencepiece: its path, or the name of a
    public one. No begin, end or other special tokens are added; strings of special tokens in a text count as the
    library counts them. Texts longer than piece characters are cut where the tokenizer's own split is sure to cut
    (byte-level files, and models none of whose pieces goes over a blank; others take a text whole), and pieces are
    encoded in batches of about batch_bytes, so a task holds one batch's ids and no row is ever shuffled. A byte-level text is cut
    at all blanks that are sure cuts, and a task encodes a word with its blank once and then remembers its count. Null and
    empty texts have no tokens; ids may be null or repeat; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cuts, whole = loaded(place(tokenizer))
        by_word, known = cuts == BYTE_LEVEL and not any(" " in s for s in whole), {}
        for batch in chunks(batches, "text", CHUNK_BYTES):
            column = batch.column(1)
            n_bytes = np.diff(text_bytes(column)[1])
            found, held, owners, size = np.zeros(batch.num_rows, np.int64), [], [], 0

            def emptied(held=held, owners=owners, found=found) -> None:
                np.add.at(found, owners, encode(held))
                held.clear()
                owners.clear()

            for row, text in enumerate(column):
                parts = [text.as_py() or ""]
                if by_word:
                    first, *words = BEFORE_BLANK.split(parts[0])
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    new = [w for w in set(words).difference(known) if len(w) <= WORD_CHARS]
                    if new:
                        known.update(zip(new, encode([" " + w for w in new]), strict=True))
                    parts = [first, *(" " + w for w in words if len(w) > WORD_CHARS)]
                    found[row] = sum(known[w] for w in words if w in known) if len(parts) > 1 else sum(map(known.__getitem__, words))
                for part in (x for p in parts for x in pieces_of(p, piece, cuts, whole)):
                    held.append(part)
                    owners.append(row)
                    size += len(part)
                    if size >= batch_bytes:
                        emptied()
                        size = 0
            if held:
                emptied()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(found)], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
