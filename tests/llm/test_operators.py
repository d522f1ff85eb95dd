"""The training-data operators against SQL, brute force, round trips and held-out accuracy; and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tally.llm import chat, languages, lines, mixing, quality, sharding, similar, simhash, substrings, suffixes, urls
from tally.llm import queries as llm
from tally.llm.components import components
from tests.conftest import SMALL

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(llm.queries()[name], SQL[name])


WORDS = [f"w{k}" for k in range(40)]


def _odd_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, equal texts, a clashing column."""
    rng = random.Random(5)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base + " more", None, "a"), (None, base, "en", None), (None, None, None, None), (5, None, "en", "a"), (6, "", "en", "b"), (7, " \n\t", "fr", "b"), (8, "word " * 200_000, "en", "c"), (9, "\n".join(["same line here"] * 40), "en", "c"), (10, "é́ 漢字 😀 \u0000 x", "zz", "c"), (11, base.upper(), "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"hash": F.lit("x"), "size": F.lit(1), "key": F.lit(None).cast("string"), "n_chars": F.length("text"), "repeated": F.lit("r"), "__id": F.lit(1), "__text": F.lit("t"), "__copies": F.lit(2), "row": F.lit(0), "shard": F.lit("old"), "a.b": F.col("doc_id")})


BENCHMARK = [("q1", " ".join(WORDS[:12])), (None, None), ("q2", "漢字"), ("q3", ""), ("q2", "漢字")]
RUNS = {
    "lines": lambda d, b: lines.without_repeated_lines(d),
    "languages": lambda d, b: languages.identified(d),
    "mixing": lambda d, b: mixing.mixture(d),
    "mixed": lambda d, b: mixing.mixed_documents(d),
    "substrings": lambda d, b: substrings.without_repeats(d),
    "quality": lambda d, b: quality.quality_rules(d),
    "clean": lambda d, b: quality.clean_documents(d),
    "suffixes": lambda d, b: suffixes.contamination(d, b),
    "decontaminated": lambda d, b: suffixes.decontaminated(d, b),
    "sharding": lambda d, b: sharding.shards(d, limit=2000),
    "with_shards": lambda d, b: sharding.with_shards(d, limit=2000),
    "longest": lambda d, b: suffixes.longest_matches(d, b),
    "urls": lambda d, b: urls.judged_pages(d, id_col="doc_id", url_col="text", html_col="source"),
    "chat": lambda d, b: chat.examples(d, id_col="doc_id", turn_col="n_chars", role_col="lang", trained="en"),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "dropped": lambda d, b: simhash.drop_near_duplicates(d),
    "similar": lambda d, b: similar.similar_documents(d),
    "drop_similar": lambda d, b: similar.drop_similar(d),
}
FEWER = {"mixed", "clean", "decontaminated", "dropped", "drop_similar", "longest", "chat"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, name):
    docs, items = _odd_documents(spark), spark.createDataFrame(BENCHMARK, "item_id string, text string")
    found = RUNS[name](docs, items).collect()
    assert 0 < len(found) <= 3 * docs.count() if name in FEWER else len(found) == docs.count()
    assert RUNS[name](docs.limit(0), items.limit(0)).count() == 0
    if name in FEWER - {"longest", "chat"}:
        assert all(r["a.b"] == r["doc_id"] and (r["__id"], r["__text"], r["__copies"], r["repeated"]) == (1, "t", 2, "r") for r in found)


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(_odd_documents(spark).where("doc_id < 8").select(F.col("doc_id") + 900_000, "text"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]

    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    expected = sorted((d, prints[i], least[top(i)]) for i, (d, _) in enumerate(rows))
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    b = np.concatenate([a ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64)), rng.integers(0, 1 << 63, 61, dtype=np.uint64)])
    for radius in (0, 3, 25):
        left, right = simhash.within(a, b, radius)
        assert set(zip(left.tolist(), right.tolist())) == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= radius}


def test_blocks_that_are_cut_lose_nothing(spark):
    """Tiny blocks force every way of cutting; the components stay."""
    rng = random.Random(3)
    values = {0}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(20)))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = components(simhash.links(df, 3, block_rows=8))
    assert roots.select("root").distinct().count() == 1 and roots.count() == 300


def test_near_copies_leave_one(spark):
    rng = random.Random(9)
    texts = [[rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(300)] for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(20):  # one word in 300 changed: shingle similarity of 0.97
        near = list(texts[k])
        near[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(near)))
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "&lt;s> &amp; <|im_end|>", "", None, "<|im_start|>user\nhi<|im_end|>\n", "a\nb"]
    rows = [(c, t, "assistant" if t % 2 else "user", tricky[(c + t) % len(tricky)]) for c in range(6) for t in range(4)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = made.withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(got) == 12
    for r in got:
        shown = rows[r["conv_id"] * 4 : r["conv_id"] * 4 + r["example"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3] or "") for x in shown]
        assert Counter(re.findall(r"<\|im_start\|>", r["formatted"])) == {"<|im_start|>": r["example"]}


def test_languages_on_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = languages.identified(docs).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND length(text) > 20 AND lang_pred <> 'und'").collect()
    assert len(found) > 10 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mixture(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    weights, goals, open_, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(names), sum(sizes.values())
    while open_:
        level = (total - sum(goals.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        goals |= {s: 3.0 * sizes[s] for s in over} if over else {s: weights[s] * level for s in open_}
        open_ = open_ - over if over else set()
    for s in names:
        assert by[s][0]["target"] == pytest.approx(goals[s])
        miss = abs(sum(r["taken"] for r in by[s]) - goals[s])
        free = [r["size"] for r in by[s] if r["size"] and r["copies"] == goals[s] // sizes[s]]
        assert miss <= max(1, 0.01 * goals[s]) or miss <= min(free) / 2, (s, miss, goals[s])
        assert all(r["taken"] <= 3 * r["size"] for r in by[s])


def _substrings_hold(spark, docs, **options):
    seen = Counter(tuple(w[i : i + 35]) for _, t in docs for w in [t.split()] for i in range(len(w) - 34))
    for r in substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect():
        w = docs[r["doc_id"]][1].split()
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))


def _passages(rng, n, distinct=40):
    """A passage of 60 words, all or part of it, in ever new contexts."""
    passage = [rng.choice(WORDS) for _ in range(60)]
    other = lambda k: [f"u{rng.randrange(distinct)}" for _ in range(k)]
    return [(k, " ".join(other(rng.randrange(80)) + passage[rng.randrange(20) : 40 + rng.randrange(21)] + other(30))) for k in range(n)]


def test_substrings_equal_brute_force(spark):
    _substrings_hold(spark, _passages(random.Random(2), 30))


def test_substrings_of_a_frequent_passage(spark):
    """A gram with more segments than a shard takes is cut by longer grams, up to the window."""
    _substrings_hold(spark, _passages(random.Random(6), 60, 10**6), gram_segments=4)


def test_compressed_ranks():
    rng = np.random.default_rng(3)
    values = np.repeat(rng.integers(0, 9, 200), rng.integers(1, 6, 200))
    made = substrings.RunLengths(values, 10)
    for symbol in range(10):
        counts = np.concatenate([[0], np.cumsum(values == symbol)])
        assert (made.rank(np.full(len(counts), symbol), np.arange(len(counts))) == counts).all()


def test_lines_keep_a_first_copy(spark):
    block = [f"line {k}" for k in range(6)]
    docs = [(1, "\n".join(["a", *block, "b"])), (2, "\n".join(["c", *block, "d"])), (3, "\n".join(block[:2])), (4, None)]
    got = {r["doc_id"]: r for r in lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[4]["kept_text"] == ""
    assert got[2]["n_removed"] == 6 and got[2]["kept_text"] == "c\nd"


def test_urls_equal_brute_force(spark):
    rows = [("http://Shop.COM/a?x", None), ("http://example.com/en/1", '<a href="http://spam.org/">x</a>'), ("http://www.example.com/en/2", None), ("http://x.net/es/#y", None), ("http://far.org/", '<a href="http://x.net/es/z">'), ("http://good.org", None), ("nothing", None), (None, None), ("http://shop.com/q", '<a href="//good.org/p">')]
    found = urls.judged_pages(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["rule"] for r in found] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, "com/"]
    assert [r["verdict"] for r in found] == ["allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (found[0]["host"], found[0]["path"], found[6]["host"]) == ("shop.com", "/a", "")
    assert urls.judged_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards_fit_and_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.shards(docs, limit=20_000).collect()
    assert len(rows) == docs.count() and all(r["shard_bytes"] <= 20_000 or r["shard_docs"] == 1 for r in rows)
    names = {r["shard"] for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 200_000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_benchmark_in_blocks_is_the_same(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, many = suffixes.contamination(docs, items), suffixes.contamination(docs, items, block_bytes=4000)
    plain = lambda df: sorted((r["doc_id"], r["n_words"], str(r["spans"]), tuple(sorted(r["items"]))) for r in df.collect())
    assert plain(one) == plain(many)


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs, was = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL).persist()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        if number == 0:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
        if number == 2:
            window = lambda t: {tuple(w[i : i + 10]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for i in range(max(1, len(w) - 9)) if w}
            bad = set().union(*(window(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()))
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.collect() if not window(r["text"]) & bad)
        docs, was = out, docs
    assert docs.count() == was.count()


def test_repeated_rows_at_a_boundary(spark):
    """Equal rows are documents of their own: the mix's rows hold as many words as its plan."""
    docs = spark.createDataFrame([(1, "one two three four five six", "a")] * 200 + [(2, " ".join(["w"] * 400), "b")], "doc_id long, text string, source string")
    plan = mixing.mixture(docs)
    planned = {r["source"]: r["t"] for r in plan.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    written = {r["source"]: r["t"] for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t")).collect()}
    assert planned == written


def test_mixture_takes_whole_epochs_then_smallest_keys(spark):
    """Against a plain run of the method: keys from hash and weight, whole epochs first, then ascending keys up to the budget, then whatever fits."""
    import math

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in mixing.mixture(docs).collect()]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(0), F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = {(r["doc_id"], r["text_hash"]): r for r in hashed.collect()}
    by = {}
    for r in rows:
        own = drawn[r["doc_id"], r["text_hash"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", own["text"])
        mean, symbols = sum(map(len, words)) / max(1, len(words)), sum(c in "#*$%&|<>" for c in own["text"])
        weight = (0.5 + 0.5 * math.exp(-abs(mean - 4.5) / 4.5)) * (1 - 0.5 * min(1, symbols / len(words))) if words else 0.5
        r["key"] = -math.log(((own["h"] % (1 << 64) >> 11) + 0.5) / 2**53) / weight
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        size, target = group[0]["source_size"], group[0]["target"]
        whole = int(target / size + 1e-9)
        left, taken, stopped = target - whole * size, set(), False
        order = [r for r in sorted(group, key=lambda r: r["key"]) if r["size"]]
        for k, r in enumerate(order):
            if r["size"] > left and not stopped:
                stopped = True
                if left <= max(0.5, 0.001 * target):
                    break
            if r["size"] <= left:
                taken.add(k)
                left -= r["size"]
        free = [(r["size"], r["key"], k) for k, r in enumerate(order) if k not in taken]
        if left > max(0.5, 0.001 * target) and free and min(free)[0] < 2 * left:
            taken.add(min(free)[2])
        assert [r["copies"] - whole for r in order] == [int(k in taken) for k in range(len(order))]


def test_a_long_document_ends_no_selection(spark):
    """One document of 5000 words among 198 of 20, in several draws: what follows it still counts."""
    rows = [(0, "w " * 5000, "a")] + [(k, "w " * 20, "a") for k in range(1, 199)] + [(1000, "w " * 3000, "b"), (1001, "w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        for target, r in {(r["source"], r["target"]): r for r in mixing.mixture(docs, seed=seed).collect()}.items():
            own = [x for x in mixing.mixture(docs, seed=seed).where(F.col("source") == target[0]).collect()]
            miss, least = abs(sum(x["taken"] for x in own) - target[1]), min((x["size"] for x in own if x["copies"] == target[1] // x["source_size"]), default=0)
            assert miss <= max(1, target[1] / 100, least / 2), (seed, target, miss)


def test_trust_equals_power_iteration(spark):
    """Hosts in a random graph with two chains longer than any fixed number of rounds reaches: dense power iteration agrees."""
    rng = random.Random(12)
    hosts = [f"h{k}.org" for k in range(60)] + ["shop.com", "www.good.com"] + ["x.net", "y.example.com"]
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(120)] + [(k, k + 1) for k in range(40, 50)] + [(k + 1, k) for k in range(50, 59)] + [(60, 40), (60, 3), (61, 7), (50, 62), (9, 62), (11, 63)]
    urls_of = [f"http://{h}/" for h in hosts[:62]] + ["http://x.net/es/", "http://y.example.com/en/"]
    links = sorted({(a, b) for a, b in links if a != b})
    html = [" ".join(f'<a href="{urls_of[b]}">' for a, b in links if a == k) for k in range(64)]
    found = urls.judged_pages(spark.createDataFrame([(k, urls_of[k], html[k]) for k in range(64)], "page_id long, url string, html string"), tolerance=1e-5).collect()

    def rank(edges, seeds):
        go = np.zeros((64, 64))
        for a, b in edges:
            go[b, a] = 1
        out = go.sum(axis=0)
        seed = np.zeros(64)
        seed[seeds] = 1 / len(seeds)
        score = seed.copy()
        for _ in range(400):
            score = 0.85 * (go @ np.where(out > 0, score / np.maximum(out, 1), 0)) + seed * (0.15 + 0.85 * score[out == 0].sum())
        return score

    trust, distrust = rank(links, [60, 61]), rank([(b, a) for a, b in links], [62, 63])
    for r in found:
        k = r["page_id"]
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust[k], abs=1e-4), pytest.approx(distrust[k], abs=1e-4))
        if k < 60:
            assert r["verdict"] == ("block" if distrust[k] > 0.5 * (trust[k] + distrust[k]) else "allow")
    assert {r["verdict"] for r in found if r["page_id"] < 60} == {"allow", "block"}
    pages = pd.DataFrame({"page_id": range(64), "url": urls_of, "html": html})
    sql = duckdb.connect().register("pages", pages).execute(urls.ORACLE_SQL).fetchall()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == sorted(sql)


def test_languages_equal_plain_profiles(spark):
    """Prototypes and cosines recomputed one n-gram at a time, and blocks of one prototype give the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60)
    rows = docs.collect()
    found = {r["doc_id"]: r for r in languages.identified(docs).collect()}
    for r in languages.identified(docs, block_bytes=8192).collect():
        own = found[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"], r["score"]) == (own["held_out"], own["lang_pred"], pytest.approx(own["score"], abs=1e-6))

    def profile(text):
        out = np.zeros(languages.DIMENSIONS)
        plain = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text or "")).strip() + " "
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
        for gram, n in Counter(plain[i : i + 3] for i in range(len(plain) - 2)).items():
            a, b, c = languages.letter_vectors(np.array([ord(x) for x in gram])).astype(int)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    known = {}
    for r in rows:
        if not found[r["doc_id"]]["held_out"] and r["lang"] is not None and r["text"]:
            known[r["lang"]] = known.get(r["lang"], 0) + profile(r["text"])
    for r in rows:
        mine, got = profile(r["text"]), found[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        cosine = {lang: float(mine @ p / np.linalg.norm(mine) / np.linalg.norm(p)) for lang, p in known.items()}
        assert got["score"] == pytest.approx(max(cosine.values()), abs=1e-4) and cosine[got["lang_pred"]] == pytest.approx(max(cosine.values()), abs=1e-4)


def test_splits_equal_sql(spark, same_rows):
    """The directory at a limit that splits it several times, in the SQL as well."""
    same_rows(lambda s, folder: sharding.query(s, folder, limit=20_000), sharding.ORACLE_SQL.replace("8388608", "20000"))


def test_longest_matches(spark):
    rng = random.Random(7)
    item = [rng.choice(WORDS) + str(k) for k in range(30)]
    docs = [(1, " ".join(["x", *item, "y"])), (2, " ".join(item[5:20])), (3, " ".join([*item[:9], "z", *item[9:30]])), (4, " ".join([*item[:12], *item[:12]])), (5, None)]
    found = suffixes.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("q", " ".join(item))], "item_id string, text string")).collect()
    assert sorted((r["doc_id"], r["item_at"], r["doc_at"], r["words"]) for r in found) == [(1, 0, 1, 30), (2, 5, 0, 15), (3, 9, 10, 21), (4, 0, 0, 12), (4, 0, 12, 12)]


def test_frequent_lines_on_hosts_of_any_size(spark):
    """A line in 30 % of the texts goes on a host of 30 texts as on one of 300; one in 3 of 30 texts stays."""
    rows = []
    for host, n in (("small", 30), ("large", 300)):
        for k in range(n):
            own = "\n".join(" ".join(f"{host}{k}x{i}y{j}" for j in range(12)) for i in range(6))
            rows.append((len(rows), own + ("\nread more about us here" if k % 10 < 3 else "") + ("\na rare line" if k < 3 else ""), host))
    kept = {r["doc_id"]: r["text"] for r in quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(kept) == len(rows) and not any("read more" in t for t in kept.values())
    assert sum("a rare line" in t for t in kept.values()) == 6


def test_pipeline_on_odd_rows(spark):
    """Nulls, repeats, a long text and clashing columns go through all stages; an empty table stays empty."""
    import corpus_pipeline

    docs = _odd_documents(spark).drop("shard")
    for some in (docs, docs.limit(0)):
        at = some
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, SMALL)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns, name
                at = spark.createDataFrame(at.collect(), at.schema)  # as if written and read
        assert (at.count() > 0) == (some is docs)
