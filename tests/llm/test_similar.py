"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tally.llm import similar
from tests.conftest import SMALL


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _texts():
    """Copies with words changed, about half of them below a similarity of 0.8, and texts alike only by what they repeat."""
    rng = random.Random(11)
    out = []
    for _ in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        out.append(words)
        for _ in range(3):
            near = list(words)
            for at in rng.sample(range(len(near)), max(1, len(near) * rng.randrange(10, 45) // 1000)):
                near[at] = f"n{rng.randrange(5000)}"
            out.append(near)
    out += [["same", "line", "here", "again"] * 500 + [f"{name}{k}" for k in range(40)] for name in "ab"]
    return [" ".join(words) for words in out]


def _roots(texts):
    sets, up, pairs = [_shingles(t) for t in texts], list(range(len(texts))), [0, 0]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both)
            pairs[linked] += bool(both)
            if linked:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(texts))], pairs


def test_stage_equals_brute_force_jaccard(spark):
    texts = _texts() + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    roots, (below, linked) = _roots(texts)
    assert below > 20 and linked > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_tiles_lose_no_link(spark):
    texts = _texts()
    roots, _ = _roots(texts)
    found = similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile_sets=1)
    least = {r["root"]: r["least"] for r in found.groupBy("root").agg(F.min("doc_id").alias("least")).collect()}
    assert [least[r["root"]] for r in found.orderBy("doc_id").collect()] == roots


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "A  b"), (None, "a b"), (None, None), (5, None), (6, ""), (7, " \n"), (8, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == [1, 5, 8]
    assert similar.drop_similar(docs.limit(0)).count() == 0


def _planted(rng, jaccard, n):
    """Pairs of 500 words of a shingle similarity about as asked: single words changed, each of which touches five shingles."""
    out = []
    for _ in range(n):
        words = [f"v{rng.randrange(20000)}" for _ in range(500)]
        near, at = list(words), 3
        for _ in range(round(496 * (1 - jaccard) / (1 + jaccard) / 5)):
            near[at] = f"n{rng.randrange(20000)}"
            at += 7
        out += [" ".join(words), " ".join(near)]
    return out


def test_recall_and_precision_at_the_threshold(spark):
    """200 planted pairs at each of 0.70, 0.75, 0.80 (just above), 0.85 and 0.9: recall of 0.99 or more, nothing below linked."""
    rng = random.Random(5)
    texts = [t for jaccard in (0.7, 0.75, 0.805, 0.85, 0.9) for t in _planted(rng, jaccard, 200)]
    found = similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    root = [r["root"] for r in found.orderBy("doc_id").collect()]
    true = linked = both = 0
    for k in range(0, len(texts), 2):
        a, b = _shingles(texts[k]), _shingles(texts[k + 1])
        same = 5 * len(a & b) >= 4 * len(a | b)
        true, linked, both = true + same, linked + (root[k] == root[k + 1]), both + (same and root[k] == root[k + 1])
    assert true >= 400 and linked == both and both >= 0.99 * true
    assert len(set(root)) == len(texts) - linked


def test_large_blocks_lose_no_link(spark):
    """A large group of near copies among which some are similar to a part of it only: every way of cutting, against brute force."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 1, 1, 2, 4])):
            words[at] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    roots, _ = _roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (4, 16, 2048):
        found = similar.similar_documents(docs, tile_sets=tile)
        least = {r["root"]: r["least"] for r in found.groupBy("root").agg(F.min("doc_id").alias("least")).collect()}
        assert [least[r["root"]] for r in found.orderBy("doc_id").collect()] == roots
