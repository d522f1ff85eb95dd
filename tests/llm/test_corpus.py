"""Resampling, phrases and token counts against brute force, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tally.llm import phrases, resampling, tokens
from tests.conftest import SMALL
from tests.llm.test_operators import BENCHMARK, _odd_documents

RUNS = {
    "resampled": lambda d, b: resampling.resampled(d, b),
    "tokens": lambda d, b: tokens.token_counts(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, name):
    docs, items = _odd_documents(spark), spark.createDataFrame(BENCHMARK, "item_id string, text string")
    assert RUNS[name](docs, items).count() == docs.count()
    assert RUNS[name](docs, items.limit(0)).count() == docs.count()
    assert RUNS[name](docs.limit(0), items.limit(0)).count() == 0


def _plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _held_resampling(spark, docs, items, buckets, found):
    def counts(text):
        w = _plain_words(text)
        return Counter(crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)), len(w)

    ours, theirs = [(d, *counts(t)) for d, t in docs], [counts(t)[0] for t in items]
    s, t = sum((c for _, c, _ in ours), Counter()), sum(theirs, Counter())
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for doc, c, n in ours:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append((doc, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = fit[: 5 * len(fit) // 100]
    assert sorted(map(str, ((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found))) == sorted(map(str, (r[:4] for r in rows)))
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_equals_brute_force(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = resampling.query(spark, SMALL).collect()
    _held_resampling(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()], 10_000, found)


def test_resampling_in_small_blocks(spark, monkeypatch):
    """Few buckets, many blocks and groups, repeated rows and null ids: nothing is lost between them, and ties keep their order."""
    monkeypatch.setattr(resampling, "GROUP_BLOCKS", 2)
    rng = random.Random(3)
    rows = [(k % 150 if k % 7 else None, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(60)))) for k in range(300)] + [(1000 + k, "x " * 30) for k in range(40)]
    items = [(k, f"a b c {k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = resampling.resampled(docs, spark.createDataFrame(items, "item_id long, text string"), buckets=50).collect()
    _held_resampling(spark, rows, [t for _, t in items], 50, found)


def test_long_counts_in_postings(spark):
    """A word found 300,000 times needs four bytes in its list."""
    rows = [(1, "a " * 300_000), (2, "b " * 30)]
    found = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")).collect()
    _held_resampling(spark, rows, ["b"], 10_000, found)


def _plain_phrases(docs, support, top=2000, most=5):
    n, f = Counter(), {}
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in many.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and b >= a for q, b in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_words", [1 << 20, 40])
def test_phrases_equal_brute_force(spark, shard_words):
    rng = random.Random(8)
    docs = []
    for k in range(120):
        text = " ".join(rng.choice(["new york city", "New York", "a b c d e f", "é 漢", "x", "y\tz", "the", "of the", "q\x00q"]) + rng.choice(["", "", "", ".", ",", "\n", " ;", "!x", " "]) for _ in range(rng.randrange(1, 60)))
        docs.append((rng.choice(["en", "fr", None, "und"]), text))
    docs += [("en", None), ("de", ""), (None, " \n\t")]
    table = spark.createDataFrame(docs, "lang string, text string").withColumns({"shard": F.lit(1), "words": F.lit("w"), "a.b": F.lit(2)}).repartition(5)
    found = phrases.collocations(table, support=8, shard_words=shard_words).collect()
    assert sorted(map(tuple, found)) == _plain_phrases(docs, 8)
    few = phrases.collocations(table, support=8, top=3, shard_words=shard_words).collect()
    assert sorted(map(tuple, few)) == _plain_phrases(docs, 8, top=3)


def test_phrases_on_odd_rows(spark):
    docs = _odd_documents(spark)
    found = phrases.collocations(docs, support=20).collect()
    assert sorted(map(tuple, found)) == _plain_phrases([(r["lang"], r["text"]) for r in docs.collect()], 20)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    rng = random.Random(1)
    rows = [("en", f"a{k} b{k}", 2, rng.randrange(10**11, 10**12)) for k in range(50)]
    parts = [("en", w, 1, rng.randrange(10**12, 10**13)) for r in rows for w in r[1].split()]
    found = phrases.lowest_cuts(spark.createDataFrame(rows + parts, "lang string, phrase string, words int, n long"), spark.createDataFrame([("en", 10**15 + 7)], "lang string, n long")).collect()
    of = {p: n for _, p, _, n in rows + parts}
    assert len(found) == 50
    for r in found:
        a, b = r["phrase"].split()
        assert r["score"] == 1000 * of[r["phrase"]] * (10**15 + 7) // (of[a] * of[b])


def _texts():
    rng = random.Random(6)
    bits = ["it's", " we'll", "<|endoftext|>", "<|endo", "text|>", "  ", "\n\n", "\t", "漢字。", "Ünï", "a" * 90, "123", "4,5", "…", " ", "\u0085", "　", "don't", "'s", "😀", "é́", "</s>", "<s>", "▁", "_", "\r\n", "x" , "ß", "᠎", "ǅ", "Hello", " world", "!?", "（", "٣"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(200))) for _ in range(60)] + ["", " ", "word " * 30_000, None]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("piece", [7, 64, 1 << 16])
def test_tokens_equal_the_library(spark, name, piece):
    texts = _texts()
    found = {r["doc_id"]: r for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=name, piece=piece, batch_bytes=500).collect()}
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        made = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        lengths = [len(made.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(public_tokenizers.path(name))
        lengths = [len(made.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for k, t in enumerate(texts):
        assert (found[k]["n_bytes"], found[k]["n_tokens"], found[k]["over_limit"]) == (len((t or "").encode()), lengths[k], lengths[k] > 1024), (k, t and t[:50])


def test_long_texts_are_cut(spark):
    """Pieces stay near their length wherever the text has a safe cut."""
    _, cuts, whole = tokens.loaded(tokens.place("byte_bpe_50k.json"))
    text = "word and 漢字。more<|endoftext|> " * 2000
    made = list(tokens.pieces_of(text, 1000, cuts, whole))
    assert "".join(made) == text and max(map(len, made)) < 1100
    assert list(tokens.pieces_of("a" * 5000, 1000, cuts, whole)) == ["a" * 5000]
