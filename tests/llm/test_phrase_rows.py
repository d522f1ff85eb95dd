"""What op12 deals over tasks, and words that share a hash."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from tally.llm import common, phrases
from tests.llm.test_corpus import _plain_phrases


def _shuffled(spark, run):
    """MB and rows that all stages of run wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {x.stageId(): (x.shuffleWriteBytes() / 1e6, x.shuffleWriteRecords()) for x in (found.apply(k) for k in range(found.length()))}

    before, made = set(stages()), run()
    return made, *(sum(x) for x in zip(*(v for k, v in stages().items() if k not in before), strict=True))


def test_rare_phrases_are_not_extended(spark):
    """op12: before, a phrase was extended while its pairs were frequent, and the shards themselves went through shuffles twice."""
    rng = random.Random(3)
    docs = [("en", " ".join(rng.choice("abcdefgh") for _ in range(500))) for _ in range(160)]
    found, mb, rows = _shuffled(spark, lambda: phrases.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(8), support=600, shard_words=5000).collect())
    assert sorted(map(tuple, found)) == _plain_phrases(docs, 600)
    assert rows < 20_000 and mb < 1  # 64 pairs and 512 triples a shard, no longer ones


def test_words_of_one_hash_are_told_apart(spark):
    """The hash of words is a sum of powers of an odd number modulo 2 to the 64th, which these two words defeat."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    data, offsets = common.text_bytes(pa.array([one, other]))
    assert len(np.unique(common.word_hashes(data, offsets[:-1], offsets[1:]))) == 1
    docs = [("en", f"{one} x y z w. {other} x y")] * 7 + [("en", f"{other} x q, {one}")] * 5 + [("fr", f"{other} x")] * 6
    found = phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), support=6).collect()
    assert sorted(map(tuple, found)) == _plain_phrases(docs, 6)
