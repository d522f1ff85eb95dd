"""Operator 12: phrase collocations by position bitmaps a word: shift, AND and popcount, depth-first."""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tally.llm.common import chunks, mixed, quoted, settled, shared_folder, sieve, text_bytes, word_hashes

#: Upper-case letters to lower-case ones, what ends a piece to \n, tabs to blanks; other bytes to themselves.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256))
#: Stands in the word list where a piece ends; no UTF-8 text holds this byte.
END = b"\xff"
#: Words of one shard about, and words that a task holds in unfinished shards.
SHARD_WORDS, HELD_WORDS = 1 << 19, 1 << 21
#: Bits of a bitmap's block. Blocks without a bit are not stored.
BITS = 16
#: Blocks of phrases that are shifted and met with all words' blocks at once.
BATCH = 1 << 15
#: Bytes of a row group about, and rows after which pages and row groups are measured. Parquet measures after 100 rows and reads a row group's
#: columns at once: 100 shards are hundreds of MB, held by each task that writes or reads them.
GROUP_BYTES, MEASURED_ROWS = 4 << 20, 1
#: A run's hash takes its next word's by this odd factor.
STEP = np.uint64(0x9E3779B97F4A7C55)
#: Parts that a language's longer phrases are summed in: so few at least, and one for so many shards.
LEAST_PARTS, PART_SHARDS = 64, 50
#: Parts that a language's candidates are ranked in before its best of all.
RANK_PARTS = 64


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, words, vocabulary, counts): the words of many texts of one language as numbers in its vocabulary, -1 where a piece ends."""
    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text_col)).alias("text"))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, numbers, words, held = TaskContext.get().partitionId() << 32, {}, {}, 0

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number, held
            ids, named = np.concatenate(words.pop(lang)), list(numbers.pop(lang))
            held -= len(ids)
            number += 1
            ids -= 1  # the first number is the end of a piece
            counts = np.bincount(ids[ids >= 0], minlength=len(named) - 1)
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([lang]), pa.array([ids.tobytes()]), pa.array([[w.decode() for w in named[1:]]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["shard", "lang", "words", "vocabulary", "counts"])

        for batch in chunks(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = ((text or b"").translate(PLAIN) + b"\n").replace(b"\n", b" \xff ").split()
                if len(own) <= own.count(END):
                    continue
                if lang not in numbers:
                    numbers[lang], words[lang] = defaultdict(), []
                    numbers[lang].default_factory = numbers[lang].__len__
                    numbers[lang][END]
                words[lang].append(np.fromiter(map(numbers[lang].__getitem__, own), np.int32, len(own)))
                held += len(own)
                if sum(map(len, words[lang])) >= shard_words:
                    yield closed(lang)
                elif held >= HELD_WORDS:
                    yield from [closed(x) for x in list(words)]
        yield from [closed(x) for x in list(words)]

    return rows.mapInArrow(sharded, "shard long, lang string, words binary, vocabulary array<string>, counts array<long>")


class Bitmaps:
    """Where each word stands, as the non-empty blocks of a bitmap a word; positions of no word have no bit.

    Blocks are held by block number, and words are numbered from 0, -1 is none. So one pass over the blocks of a shifted
    bitmap meets the blocks of all words there, and an AND with every word's bitmap costs only the blocks both have.
    """

    def __init__(self, words: np.ndarray, n_words: int):
        self.n_words = max(1, n_words)
        at = np.flatnonzero(words >= 0)
        block, bit = at // BITS, (1 << (at % BITS)).astype(np.uint16)
        key = block * self.n_words + words[at]
        order = np.argsort(key, kind="stable")
        key, block, bit = key[order], block[order], bit[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block, self.word = block[first], words[at][order][first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.begin = np.searchsorted(self.block, np.arange(len(words) // BITS + 3))
        self.order = np.argsort(self.word, kind="stable")

    def extended(self, group: np.ndarray, block: np.ndarray, bits: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, ...]:
        """Shift and AND for many phrases at once: which phrase, which word follows, the popcount, and the longer phrases' bitmaps.

        group has the phrase of each block; wanted, if given, says which phrases may be extended by which words.
        """
        over = np.flatnonzero(bits >> np.uint16(BITS - 1))
        group, block, shifted = np.concatenate([group, group[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([bits << np.uint16(1), np.ones(len(over), np.uint16)])
        sizes = self.begin[block + 1] - self.begin[block]
        ends = np.cumsum(sizes)
        met = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[block] - (ends - sizes), sizes)
        both = self.bits[met] & np.repeat(shifted, sizes)
        hit = np.flatnonzero(both)
        met, both, group = met[hit], both[hit], group[np.searchsorted(ends, hit, "right")]
        word = self.word[met]
        if wanted is not None:
            found = wanted(group, word)
            group, word, met, both = group[found], word[found], met[found], both[found]
        key = group * self.n_words + word
        order = np.argsort(key, kind="stable")
        key, met, both = key[order], met[order], both[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.add.reduceat(np.bitwise_count(both).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        again = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        return key[first] // self.n_words, key[first] % self.n_words, counts, again, self.block[met], both

    def phrases(self, least: int, most: int, wanted: Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of least to most words (a row of word numbers each) and their popcounts; wanted takes a batch's phrases and says what may extend them.

        Depth-first: a stack holds batches of phrases that share a length, each at most BATCH blocks, or one phrase; the
        longer ones a batch yields are followed to their end before the next batch.
        """
        every = np.arange(self.n_words)
        own = self.word[self.order].astype(np.int64)
        stack = [(every[:, None], own, self.block[self.order], self.bits[self.order])]
        while stack:
            paths, group, block, bits = stack.pop()
            if len(block) > BATCH and len(paths) > 1:
                cut = len(paths) // 2
                at = int(np.searchsorted(group, cut))
                stack += [(paths[cut:], group[at:] - cut, block[at:], bits[at:]), (paths[:cut], group[:at], block[:at], bits[:at])]
                continue
            of, word, counts, group, block, bits = self.extended(group, block, bits, wanted and wanted(paths))
            paths = np.column_stack([paths[of], word])
            if least <= paths.shape[1] and len(paths):
                yield paths, counts
            if paths.shape[1] < most and len(paths):
                stack.append((paths, group, block, bits))


def _hashes(words: pa.Array, langs: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each word in its language; seeds other than 0 take a slower hash that no text is made to defeat."""
    langs = langs.dictionary_encode()
    short = lambda text, salt: int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, salt=salt.to_bytes(8)).digest())
    of = np.array([short(lang, 0) for lang in langs.dictionary.to_pylist()], np.uint64)
    if seed:
        own = np.array([short(word, seed) for word in words.to_pylist()], np.uint64)
    else:
        data, offsets = text_bytes(words)
        own = word_hashes(data, offsets[:-1], offsets[1:])
    return mixed(own ^ of[langs.indices.to_numpy()]) if len(own) else own


def _followed(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run with one more word, of both their hashes."""
    with np.errstate(over="ignore"):
        return mixed(run * STEP + word)


def _marked(frequent: DataFrame, size: int, seed: int) -> Broadcast:
    """A bit map of the hashes of all runs of 1 to size words in these phrases (lang, phrase) of size words: 4 MB at most, and larger tables let more pass."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.columns
            words = pc.split_pattern(phrases, " ").flatten()
            of = _hashes(words, langs.take(pa.array(np.repeat(np.arange(len(langs)), size))), seed).reshape(-1, size)
            made = []
            for start in range(size):
                run = of[:, start]
                made.append(run)
                for end in range(start + 1, size):
                    run = _followed(run, of[:, end])
                    made.append(run)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(made)).view(np.int64))], names=["hash"])

    hashes = settled(frequent.select("lang", "phrase").mapInArrow(runs, "hash long").distinct())
    rows = sieve(hashes, "hash", 16 * hashes.count()).toArrow()
    bits = np.zeros(rows["words"][0].as_py() if rows.num_rows else 1, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] >> (hashes >> np.uint64(58)) & np.uint64(1) == 1


def _rows(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array, np.ndarray]]:
    """Each shard with its vocabulary, the vocabulary's language and hashes."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            named = row.column("vocabulary").flatten()
            langs = row.column("lang").take(pa.array(np.zeros(len(named), np.int64)))
            yield row, named, langs, _hashes(named, langs, seed)


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for row, named, langs, hashes in _rows(batches, seed):
        yield pa.RecordBatch.from_arrays([langs, named, pa.array(hashes.view(np.int64)), row.column("counts").flatten()], names=["lang", "word", "hash", "n"])


def _maps(row: pa.RecordBatch, kept: np.ndarray, size: int) -> Bitmaps:
    """Bitmaps of the shard's kept words, numbered by their places in kept."""
    new = np.full(size + 1, -1, np.int32)  # the last is for -1, the end of a piece
    new[kept] = np.arange(len(kept), dtype=np.int32)
    return Bitmaps(new[np.frombuffer(row.column("words")[0].as_py(), np.int32)], len(kept))


def _pairs(batches: Iterator[pa.RecordBatch], frequent: Broadcast, seed: int) -> Iterator[pa.RecordBatch]:
    """How often each frequent word stands right after another in a shard; a pair is the two words' places among the frequent words' hashes."""
    known = frequent.value
    for row, named, _, hashes in _rows(batches, seed):
        place = np.searchsorted(known, hashes)
        kept = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes) if len(known) else []
        if len(kept):
            place = place[kept]
            for paths, counts in _maps(row, kept, len(named)).phrases(2, 2):
                first, second = place[paths.T]
                yield pa.RecordBatch.from_arrays([pa.array(first << 32 | second), pa.array(counts)], names=["pair", "n"])


def _longer(batches: Iterator[pa.RecordBatch], marked: Broadcast, size: int, least: int, most: int, parts: int, seed: int) -> Iterator[pa.RecordBatch]:
    """How often each phrase of least to most words, all of whose runs of size words are marked, stands in a shard: a row for each part that it has phrases of."""
    bits = marked.value
    for row, named, langs, hashes in _rows(batches, seed):
        kept = np.flatnonzero(_in(bits, hashes))
        if not len(kept):
            continue
        own, names = hashes[kept], named.take(pa.array(kept))

        def run(paths, own=own):
            made = own[paths[:, 0]]
            for k in range(1, paths.shape[1]):
                made = _followed(made, own[paths[:, k]])
            return made

        def wanted(paths, own=own, run=run):
            tail = run(paths[:, max(0, paths.shape[1] + 1 - size) :])
            return lambda group, word: _in(bits, _followed(tail[group], own[word]))

        part, texts, numbers = [], [], []
        for paths, counts in _maps(row, kept, len(named)).phrases(least, most, wanted):
            part.append((run(paths) % np.uint64(parts)).astype(np.int64))
            texts.append(pc.binary_join_element_wise(*(names.take(pa.array(p)) for p in paths.T), " "))
            numbers.append(counts)
        if part:
            part = np.concatenate(part)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            at = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, x.take(pa.array(order))) for x in (pa.concat_arrays(texts), pa.array(np.concatenate(numbers)))]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(np.zeros(len(first), np.int64))), pa.array(part[order][first]), *lists], names=["lang", "part", "phrases", "counts"])


def _summed(key, rows: pa.Table, support: int) -> pa.Table:
    """The phrases of a language's part that its shards have support times together."""
    whole = pa.table({"phrase": pc.list_flatten(rows.column("phrases")), "n": pc.list_flatten(rows.column("counts"))}).group_by("phrase").aggregate([("n", "sum")])
    whole = whole.filter(pc.greater_equal(whole.column("n_sum"), support))
    return pa.table({"lang": pa.array([key[0].as_py()] * whole.num_rows, pa.string()), "phrase": whole.column("phrase"), "n": whole.column("n_sum")})


def _written(df: DataFrame, name: str) -> str:
    """Rows as compressed Parquet in the shared folder, in row groups of a few. Pages of many MB, which other codecs would hold twice outside the heap, go through zstd as streams."""
    small = {"parquet.block.size": GROUP_BYTES} | {f"parquet.{what}.size.row.check.{end}": MEASURED_ROWS for what in ("block", "page") for end in ("min", "max")}
    df.write.options(compression="zstd", **small).parquet(path := f"{shared_folder(df.sparkSession)}/phrases-{uuid.uuid4().hex}/{name}")
    return path


def counted_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, support: int = 100, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, words, n), every phrase of 1 to most words found support times or more, and (lang, n), all words of a language."""
    table = docs.sparkSession.read.parquet(_written(shards(docs, text_col, lang_col, shard_words), "shards"))
    totals = settled(table.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    words, seed = _hashed_words(table)
    words = settled(words.where(F.col("n") >= support))
    texts = table.select("lang", "words", "vocabulary")
    parts = max(LEAST_PARTS, table.count() // PART_SHARDS)

    def longer(known: DataFrame, size: int, least: int, most: int) -> DataFrame:
        marked = _marked(known, size, seed)
        rows = texts.mapInArrow(lambda batches: _longer(batches, marked, size, least, most, parts, seed), "lang string, part long, phrases array<string>, counts array<long>")
        return settled(rows.groupBy("lang", "part").applyInArrow(lambda key, rows: _summed(key, rows, support), "lang string, phrase string, n long"))

    known = np.sort(words.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
    frequent = docs.sparkSession.sparkContext.broadcast(known)
    rows = texts.mapInArrow(lambda batches: _pairs(batches, frequent, seed), "pair long, n long")
    pairs = settled(rows.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= support))
    single = words.select("lang", F.col("word").alias("phrase"), "n")
    pairs = _named(pairs, frequent, words)
    found = single.unionByName(pairs)
    if most > 2:
        found = found.unionByName(triples := longer(pairs, 2, 3, 3))
    if most > 3:
        found = found.unionByName(longer(triples, 3, 4, most))
    return found.withColumn("words", F.size(F.split("phrase", " "))), totals


def _named(pairs: DataFrame, frequent: Broadcast, words: DataFrame) -> DataFrame:
    """(lang, phrase, n) of pairs (pair, n)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value.view(np.int64)
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(known[pair >> 32]), pa.array(known[pair & 0xFFFFFFFF]), batch.column("n")], names=["first", "second", "n"])

    first, second = words.select(F.col("hash").alias("first"), "lang", F.col("word").alias("first_word")), words.select(F.col("hash").alias("second"), F.col("word").alias("second_word"))
    found = pairs.mapInArrow(hashed, "first long, second long, n long").join(first, "first").join(second, "second")
    return settled(found.select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "n"))


def _hashed_words(table: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, hash, n) of all words, and the first seed by which no two of them share a hash."""
    seed = 0
    while True:
        words = settled(table.select("lang", "vocabulary", "counts").mapInArrow(lambda batches, seed=seed: _words(batches, seed), "lang string, word string, hash long, n long").groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")))
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def _joined(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def lowest_cuts(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase of two words or more, at the cut whose floor(1000 a n / (l r)) is least; ties to the first.

    found has (lang, phrase, words, n) of the phrases and of all their parts, totals (lang, n). Products have 38 digits.
    """
    cuts = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("parts"), F.lit(1), F.col("k")).alias("head"), _joined(F.col("parts"), F.col("k") + 1, F.size("parts") - F.col("k")).alias("rest"))
    heads, rests = found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast({wide('1000')} * {wide('a')} * {wide('n')} as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))"))
    return cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 5, support: int = 100, inside_percent: int = 100, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to most words by their lowest-scoring cut.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and into words at blanks and tabs. Shards of half
    a million words of one language hold a bitmap of positions for each word, with an empty place between pieces, so that
    no phrase goes over one. Shards stay in their files, and popcounts are summed over them four times: words, pairs of
    words found support times, phrases of three words whose pairs are, and longer ones, which each shard extends
    depth-first while every three words in them are found support times anywhere; a phrase that is found so often has no
    rarer part, so none is lost. Which parts are is told by a bit map of their hashes, which lets some more pass and none
    less; the sums decide. Words go by hashes that were seen to differ. Numbers are exact. A null text is empty, a null
    language is "und", repeated rows count again, an empty table gives no rows; a piece is never cut, so a text without
    an end of piece makes a shard as long as itself. A phrase inside a longer one with inside_percent of its count goes.
    """
    found, totals = counted_phrases(docs, text_col, lang_col, most, support, shard_words)
    found = settled(found)
    scored, many = lowest_cuts(found, totals), found.where("words > 1").withColumn("parts", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: _joined(F.col("parts"), start, size))))
    inside = many.where("words > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS pno FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents)),
words AS (
  SELECT doc, lang, pno, w FROM (SELECT doc, lang, pno, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, n AS a, string_split(phrase, ' ') AS parts FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, h.n AS l, t.n AS r, total.n AS n, cut,
         (1000::HUGEINT * a * total.n) // (h.n::HUGEINT * t.n) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(parts[1:cut], ' ')
  JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(parts[cut + 1:size], ' ')
  JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = best.lang AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' ') AND c.phrase <> best.phrase AND c.a >= best.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
