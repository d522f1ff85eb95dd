"""Operator 10 at a similarity: SimHash fingerprints compared bit-sliced make candidates, exact Jaccard of word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import _ODD, chunks, hot_join, mixed, run_hashes, settled, text_bytes, text_hash, word_hashes, word_spans
from tally.llm.components import components
from tally.llm.simhash import _spanning, first_row, near_masks, only_rows, within

#: Words of 64 bits in a fingerprint, and the bits in which the fingerprints of a pair at 0.8 may differ. They differ in
#: 15 % of the bits (39 of 256, deviation 6), at most in 19 % where a set has few shingles; fingerprints of texts that
#: share nothing differ in 128.
WORDS, RADIUS = 4, 72
#: Fingerprints are compared in blocks of rows that share so many least hashes of their shingles, once for each such band:
#: a pair at 0.8 shares none with probability (1 - 0.8 ** 5) ** 24, 7e-5, and one at 0.2 shares any with 0.8 %.
ROWS, BANDS = 5, 24
#: Rows of a block, and shingles, that one task compares; a larger block is compared with one of its rows first, then in tiles.
TILE_SETS, TILE_SHINGLES = 2048, 1 << 21
#: Runs of equal keys up to this length are compared pair by pair, a lane each; longer ones row against rows.
SHORT_RUN = 16

_FACTORS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A byte's eight bits as eight bytes: sums of up to 255 of them don't carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes, ASCII lower-cased; a shorter text is one shingle."""
    data = _LOWER[data]
    begin, end, first = word_spans(data, offsets)
    words = word_hashes(data, begin, end)
    runs = run_hashes(words, shingle)
    cut = lambda a, b: runs[a : b - shingle + 1] if b - a >= shingle else run_hashes(words[a:b], b - a) if b > a else words[:0]
    return [np.unique(cut(a, b)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set, a row of WORDS words: a bit is 1 if over half its hashes have it."""
    out, full = np.zeros((len(sets), WORDS), np.uint64), [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat, sizes = np.concatenate([sets[k] for k in full]), np.array([len(sets[k]) for k in full])
    parts = -(-sizes // 255)
    head = np.cumsum(parts) - parts
    at = np.append(np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(head, parts)), len(flat))
    counts = np.empty((len(at) - 1, WORDS * 64), np.uint8)
    for a in range(0, len(counts), 1024):
        b = min(len(counts), a + 1024)
        piece = flat[at[a] : at[b]]
        for w in range(WORDS):
            with np.errstate(over="ignore"):
                spread = _SPREAD[mixed(piece + np.uint64((w + 1) * int(_ODD) % (1 << 64))).view(np.uint8).reshape(-1, 8)]
            counts[a:b, w * 64 : w * 64 + 64] = np.add.reduceat(spread, at[a:b] - at[a], axis=0).view(np.uint8)
    ones = np.add.reduceat(counts.astype(np.int64), head, axis=0)
    out[full] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A key for each band of each set; an empty set has none."""
    full = [k for k, s in enumerate(sets) if len(s)]
    keys = [np.zeros(0, np.int64)] * len(sets)
    if not full:
        return keys
    flat = np.concatenate([sets[k] for k in full])
    starts = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
    made = np.zeros((len(full), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            made[:, k // ROWS] = mixed(made[:, k // ROWS] + np.minimum.reduceat(flat * factor, starts) + np.uint64(k))
    for row, k in enumerate(full):
        keys[k] = made[row].view(np.int64)
    return keys


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def near_in_runs(key: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of equal keys (sorted) that join what all pairs within the radius join.

    In short runs a lane is a pair: its difference is held against zero. In a long run all rows are held against the
    first, which joins those near to it; only the others are then held against all.
    """
    first, size = _runs(key)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rank, length = np.arange(len(key)) - np.repeat(first, size), np.repeat(size, size)
    for lag in range(1, SHORT_RUN):
        at = np.flatnonzero((length <= SHORT_RUN) & (rank + lag < length))
        for top in range(0, len(at), 4096):
            some = at[top : top + 4096]
            _, hit = within(np.zeros((1, prints.shape[1]), np.uint64), prints[some] ^ prints[some + lag], radius)
            left.append(some[hit])
            right.append(some[hit] + lag)
    for a, n in zip(first[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        rows = prints[a : a + n]
        _, hit = within(rows[:1], rows, radius)
        left.append(np.full(len(hit), a))
        right.append(a + hit)
        rest = np.setdiff1d(np.arange(n), hit)
        i, j = within(rows[rest], rows, radius)
        left.append(a + rest[i])
        right.append(a + j)
    return np.concatenate(left), np.concatenate(right)


def _links_of_keys(radius: int):
    def task(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key, node = table.column("key").to_numpy()[order], table.column("node").to_numpy()[order]
        prints = np.stack([table.column(f"p{w}").to_numpy().view(np.uint64)[order] for w in range(WORDS)], axis=1)
        left, right = near_in_runs(key, prints, radius)
        kept = np.array(_spanning(left, right, len(key)), np.int64).reshape(-1, 2)
        return pa.table({"u": node[kept[:, 0]], "v": node[kept[:, 1]]})

    return task


def candidate_links(nodes: DataFrame, radius: int = RADIUS, block_rows: int = TILE_SETS) -> DataFrame:
    """(u, v) of nodes (node, keys, p0 ..) that join what all pairs do that share a key and are within the radius.

    The keys of a block or more rows are held against one of their rows first; only rows beyond its radius are then
    held against all the others, in tiles, so a group of near copies costs a comparison a row. A node of null or no keys
    meets none; an empty table gives no links.
    """
    prints = [f"p{w}" for w in range(WORDS)]
    keyed = nodes.select("node", *prints, F.explode("keys").alias("key"))
    shared = settled(nodes.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1"))
    known = shared.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    buckets = 1 + (known["rows"] or 0) // (8 * block_rows)
    fit = keyed.join(shared.where(F.col("n") <= 2 * block_rows).select("key"), "key", "left_semi")
    out = fit.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(_links_of_keys(radius), "u long, v long")
    if (known["most"] or 0) <= 2 * block_rows:
        return out
    large = shared.where(F.col("n") > 2 * block_rows)
    centres = large.join(nodes.select(F.col("node").alias("centre"), *(F.col(p).alias(f"c{p}") for p in prints)), "centre")
    centres = settled(centres.withColumn("parts", F.ceil(F.col("n") / block_rows)))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"c{p}"))) for p in prints), F.lit(0))
    held = settled(hot_join(keyed, centres, ["key"], "n", known["rows"]).select("key", "node", *prints, "centre", "parts", (apart <= radius).alias("near"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")))
    out = out.unionByName(held.where("near AND node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")))
    return out.unionByName(_rest_by_all(held, "near", ["key"], [*prints], block_rows, _links_of_rest(radius)))


def _rest_by_all(held: DataFrame, near: str, group: list[str], columns: list[str], block_rows: int, task) -> DataFrame:
    """Tiles in which each row of held that isn't near its group's centre meets all rows of the group."""
    rest = held.where(~F.col(near))
    sizes = settled(rest.groupBy(*group).agg(F.ceil(F.count("*") / block_rows).alias("rest_parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = held.join(sizes, group)
    ask = met.where(~F.col(near)).select(*group, F.pmod(F.xxhash64("node"), F.col("rest_parts")).alias("a"), every("parts").alias("b"), F.lit(True).alias("asks"), "node", *columns)
    told = met.select(*group, every("rest_parts").alias("a"), F.col("part").alias("b"), F.lit(False).alias("asks"), "node", *columns)
    return ask.unionByName(told).groupBy(*group, "a", "b").applyInArrow(task, "u long, v long")


def _links_of_rest(radius: int):
    def task(table: pa.Table) -> pa.Table:
        node, asks = table.column("node").to_numpy(), table.column("asks").to_numpy()
        prints = np.stack([table.column(f"p{w}").to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
        i, j = within(prints[asks], prints, radius)
        i = np.flatnonzero(asks)[i]
        kept = np.array(_spanning(i, j, len(node)), np.int64).reshape(-1, 2)
        return pa.table({"u": node[kept[:, 0]], "v": node[kept[:, 1]]})

    return task


class Tile:
    """Sets of one task: which are candidates by their fingerprints, and how many shingles they have in common."""

    def __init__(self, sets: list[np.ndarray], percent: int, radius: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.parts, self.marked = np.split(tokens, np.cumsum(self.sizes)[:-1]), np.zeros(len(tokens), bool)
        prints, n = set_prints(sets), len(sets)
        if n <= SHORT_RUN:  # too few to fill the lanes of bit planes
            self.near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius
        else:
            self.near = np.zeros((n, n), bool)
            for top, mask in near_masks(prints, prints, radius):
                self.near[top : top + len(mask)] = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :n]

    def linked(self, at: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose Jaccard similarity with at is percent or more."""
        others, sizes, percent = others[self.near[at, others]], self.sizes, self.percent
        others = others[(100 * sizes[others] >= percent * sizes[at]) & (100 * sizes[at] >= percent * sizes[others])]
        if not len(others):
            return others
        self.marked[self.parts[at]] = True
        common = np.add.reduceat(self.marked[np.concatenate([self.parts[k] for k in others])].astype(np.int64), np.cumsum([0, *sizes[others[:-1]]]))
        self.marked[self.parts[at]] = False
        return others[common * (100 + percent) >= percent * (sizes[at] + sizes[others])]


def similar_links(sets: list[np.ndarray], percent: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a Jaccard similarity of percent or more that join what all such pairs would.

    Each set reached is held against those not yet reached, so a group of near copies takes few comparisons a set.
    """
    if len(sets) < 2:
        return []
    tile, left, found = Tile(sets, percent, radius), np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = tile.linked(at, left)
            found += [(at, int(k)) for k in hit]
            todo += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return found


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, size, keys, p0 ..) for each row of docs: node is a hash of the text's whole set of shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            sets = shingle_sets(*text_bytes(batch.column(2)), shingle)
            sizes, prints = np.array([len(s) for s in sets], np.int64), set_prints(sets)
            with np.errstate(over="ignore"):
                node = mixed(np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64) + sizes.astype(np.uint64)).view(np.int64)
            lanes = [pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(sizes), pa.array(band_keys(sets), pa.list_(pa.int64())), *lanes], ["doc_id", "text_hash", "node", "size", "keys", *(f"p{w}" for w in range(WORDS))])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, size long, keys array<long>, " + ", ".join(f"p{w} long" for w in range(WORDS)))


def _tile_sets(table: pa.Table, shingle: int) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for batch in chunks(iter(table.to_batches()), "text"):
        sets += shingle_sets(*text_bytes(batch.column(batch.schema.get_field_index("text"))), shingle)
    return sets


def _links_in_groups(shingle: int, percent: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part_of", "ascending"), ("node", "ascending")])
        node, (first, size), sets, kept = table.column("node").to_numpy(), _runs(table.column("part_of").to_numpy()), _tile_sets(table, shingle), []
        for a, n in zip(first.tolist(), size.tolist()):
            distinct = [k for k in range(a, a + n) if k == a or node[k] != node[k - 1]]  # rows that repeat id and text
            kept += [(distinct[i], distinct[j]) for i, j in similar_links([sets[k] for k in distinct], percent)]
        at = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({"u": node[at[:, 0]], "v": node[at[:, 1]]})

    return task


def _held_to_centre(shingle: int, percent: int):
    def task(table: pa.Table) -> pa.Table:
        node, sets = table.column("node").to_numpy(), _tile_sets(table, shingle)
        at = int(np.flatnonzero(node == table.column("centre").to_numpy())[0])
        near = np.isin(np.arange(len(sets)), Tile(sets, percent, RADIUS).linked(at, np.delete(np.arange(len(sets)), at)))
        near[node == node[at]] = True
        return pa.table({"node": node, "near": near})

    return task


def _links_to_rest(shingle: int, percent: int):
    def task(table: pa.Table) -> pa.Table:
        node, asks = table.column("node").to_numpy(), table.column("asks").to_numpy()
        order = np.lexsort((~asks, node))
        keep = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]  # a row that asks is also told
        table, node, asks = table.take(pa.array(keep)), node[keep], asks[keep]
        tile = Tile(_tile_sets(table, shingle), percent, RADIUS)
        found = [(int(u), int(k)) for u in np.flatnonzero(asks) for k in tile.linked(u, np.delete(np.arange(len(node)), u))]
        at = np.array(_spanning(np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64), len(node)), np.int64).reshape(-1, 2)
        return pa.table({"u": node[at[:, 0]], "v": node[at[:, 1]]})

    return task


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows of shingled, and one row a node: n rows have it, first is the smallest of them by (id, text hash)."""
    prints = settled(shingled(docs, id_col, text_col, shingle))
    lanes = [F.first(f"p{w}").alias(f"p{w}") for w in range(WORDS)]
    return prints, settled(prints.groupBy("node").agg(F.count("*").alias("n"), F.min(first_row()).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), *lanes))


def similar_nodes(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, tile_sets: int = TILE_SETS) -> DataFrame:
    """(node, root) of nodes that links of similarity percent or more join with others.

    Components of candidates are small groups, which tasks take several of, or large ones: of these all texts are held
    against one of them, and then only those not similar to it against all. Every link rests on whole sets of
    shingles; a pair is missed only if it shares no band, or its fingerprints differ beyond the radius, and nothing
    in between joins it. Nodes without a link are left out, so an empty table gives none; null texts are one node. Texts
    of one template that share much and stay below percent are compared each with each: this part is quadratic in them.
    """
    groups = components(candidate_links(nodes, block_rows=tile_sets)).withColumnRenamed("root", "part_of")
    members = settled(groups.join(nodes.select("node", "size", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__text")), "node"))
    totals = members.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    parts = members.groupBy("part_of").agg(F.greatest(F.ceil(F.count("*") / tile_sets), F.ceil(F.sum("size") / TILE_SHINGLES)).alias("parts"), F.count("*").alias("n"), F.min("node").alias("centre"))
    chosen = hot_join(members, settled(parts), ["part_of"], "n", totals["n"])
    texts = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    texts = settled(texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__text"))).select("node", "part_of", "parts", "centre", "text"))
    buckets = 1 + max(totals["n"] // tile_sets, totals["size"] // TILE_SHINGLES)
    out = texts.where("parts = 1").groupBy(F.pmod(F.xxhash64("part_of"), F.lit(buckets)).alias("bucket")).applyInArrow(_links_in_groups(shingle, percent), "u long, v long")
    large = texts.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    if not large.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        dealt = large.where("node <> centre").unionByName(large.where("node = centre").withColumn("part", every))
        near = settled(dealt.groupBy("part_of", "part").applyInArrow(_held_to_centre(shingle, percent), "node long, near boolean").distinct())
        held = large.join(near, "node")
        out = out.unionByName(held.where("near AND node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")))
        out = out.unionByName(_rest_by_all(held, "near", ["part_of"], ["text"], tile_sets, _links_to_rest(shingle, percent)))
    return components(out)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, tile_sets: int = TILE_SETS) -> DataFrame:
    """(doc_id, text_hash, node, root) for each row of docs: root names what links of similarity percent or more join.

    Texts of equal sets of shingles (ASCII lower-cased, words part at ASCII white space, a text of fewer words is one
    shingle) are one node, and so are all null texts and texts without words. Null ids and repeated rows are rows like
    others; an empty table gives none; a long text is read whole; no other column is read.
    """
    prints, nodes = shingle_nodes(docs, id_col, text_col, shingle)
    roots = nodes.select("node", "n").join(similar_nodes(docs, nodes, id_col, text_col, shingle, percent, tile_sets), "node", "left")
    named = settled(roots.select("node", "n", F.coalesce("root", "node").alias("root")))
    return hot_join(prints.select("doc_id", "text_hash", "node"), named, ["node"], "n", prints.count()).select("doc_id", "text_hash", "node", "root")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, tile_sets: int = TILE_SETS) -> DataFrame:
    """The rows of docs that stay: of each component of similar_documents the smallest by (id, text hash), nulls last.

    Of rows that repeat id and text one stays; an empty table gives an empty one; other columns are kept as they are.
    """
    _, nodes = shingle_nodes(docs, id_col, text_col, shingle)
    roots = nodes.select("node", "first").join(similar_nodes(docs, nodes, id_col, text_col, shingle, percent, tile_sets), "node", "left")
    stay = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return only_rows(docs, settled(stay.select("first.doc_id", "first.text_hash")), id_col, text_col)
