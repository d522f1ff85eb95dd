"""Token counts by remembered words are those of the library on whole texts, and each word is encoded once."""

from __future__ import annotations

import random

from tally.llm import tokens

ODD = [" ", "  ", "\n ", " \n", "\t ", "a", "Zebra", "don't", "it's ", " 'll", "1,234.5", "é", "é", " ", " x", "漢字", "。", "ー", "🙂", "<|endoftext|>", " <|endoftext|> ", "x" * 70, "�", "​", "ا", "ไทย", "-", "...", "_", "\r\n"]


def test_remembered_words_count_as_the_library_counts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice([*ODD, " ", " word", " the"]) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    encode = tokens.loaded(tokens.place("byte_bpe_50k.json"))[0]
    assert [found[k] for k in range(len(texts))] == encode(texts)


def test_a_word_is_encoded_once(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "asked")
    encode, cuts, whole = tokens.loaded(tokens.place("byte_bpe_50k.json"))

    def logged(texts):
        with open(path, "a") as file:
            file.write("x" * sum(map(len, texts)))
        return encode(texts)

    monkeypatch.setattr(tokens, "loaded", lambda _: (logged, cuts, whole))
    taken = {}
    docs = spark.createDataFrame([(1, "same words again " * 5000)], "doc_id long, text string")

    def run(self, function, schema):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["same words again " * 5000]})
        taken["n"] = sum(sum(b.column(2).to_pylist()) for b in function(iter([batch])))
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(docs), "mapInArrow", run)
    tokens.token_counts(docs)
    assert taken["n"] == encode(["same words again " * 5000])[0]
    assert len(open(path).read()) < 100
