"""SimHash fingerprints and the groups that near fingerprints link, found by forests of vantage-point trees.

Two fingerprints that differ in at most ``bits`` of 64 differ in at most ``bits // blocks`` of at least one of
``blocks`` bit blocks. Each block has a vantage-point tree, built from a bounded sample: a node holds a vantage
fingerprint and a threshold and parts fingerprints by their Hamming distance to it within the block, or over all 64
bits where the block no longer tells them apart. A leaf is a shard; one that gets too many fingerprints is split by a
tree of its own, built where its sample is, until all fit. A fingerprint lives in one shard of each tree and also visits those shards that its ball overlaps, by the triangle bound; of two near fingerprints one so meets the other
at home. Each shard searches with a tree of its own, compares exactly, and passes on only the links of a star for each
local group, so a group of many near copies costs links in proportion to its size. Stars are then contracted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import chunks, meet, own, remove, save, ship

#: Fixed by the operator's contract.
SEED, SHINGLE = 42, 4
#: Fingerprints that a tree is built from, about; its shards number this over SAMPLE_A_SHARD at most.
SAMPLE, SAMPLE_A_SHARD = 32_768, 16
#: Fingerprints that live in a shard, about; one that holds twice as many is split.
SHARD_ROWS = 16_384
#: A node that has more than one of so many links is a hub: there are at most as many hubs.
HUBS = 2048
#: Fingerprints in a leaf of a shard's own tree, about, and most comparisons held at once.
LEAF, TILE = 96, 1 << 20
#: One of so many distinct texts, however many there are, tells which shingles are common: those that so many of them hold.
SAMPLED, COMMON_FROM = 8, 2
#: The most common shingles, by rank; bits of the table that marks the others for each of them, and in all at most.
RANKED, MARK_BITS, MOST_BITS = 65_536, 16, 1 << 27
#: Longs of a set's parities.
PARITIES = 16
#: What rounding may take from a bound.
SLACK = 1e-6


def fingerprints(texts: list[str], width: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each whole text: bits set in over half of its shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: A-Z fold and the six ASCII spaces part words, nothing else
        if words:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: max(1, len(words) - width + 1)].tolist()
            hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)]
            counts[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        got = fingerprints(pc.fill_null(batch.column(1), "").to_pylist(), width)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


# ---------------------------------------------------------------- vantage-point trees


def blocks_of(bits: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each tree its measures, in order of preference: (mask, radius) of its block, then of all bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [[(m, bits // blocks), ((1 << 64) - 1, bits)] for m in masks]


def distance(fps: np.ndarray, vantage: np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def best_split(points: np.ndarray, measures: list[tuple[int, int]], tries: int = 6) -> tuple[int, int, int, int] | None:
    """(mask, radius, vantage, threshold) with the fewest points near the border for the balance it gives."""
    some = points[:: max(1, len(points) // 2048)]
    for mask, radius in measures:
        best, found = np.inf, None
        for vantage in some[:: max(1, len(some) // tries)][:tries]:
            d = distance(some, vantage, mask)
            for at in np.unique(np.quantile(d, [0.3, 0.4, 0.5, 0.6, 0.7]).astype(int)):
                left = np.mean(d <= at)
                if 0.15 <= left <= 0.85:
                    border = np.mean((d - radius <= at) & (d + radius > at))
                    cost = (1 + border) ** 2 * max(left, 1 - left)
                    if cost < best:
                        best, found = cost, (mask, radius, int(vantage), int(at))
        if found:
            return found
    return None


def build(points: np.ndarray, leaves: int, measures: list[tuple[int, int]], numbers: Iterator[int]):
    """A tree: a leaf's number, or (mask, radius, vantage, threshold, near side, far side)."""
    split = best_split(points, measures) if leaves > 1 and len(points) > 1 else None
    if not split:
        return next(numbers)
    near = distance(points, split[2], split[0]) <= split[3]
    share = min(leaves - 1, max(1, round(leaves * near.mean())))
    return (*split, build(points[near], share, measures, numbers), build(points[~near], leaves - share, measures, numbers))


def route(tree, fps: np.ndarray, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, lives there) for the leaf where each fingerprint lives and the earlier leaves its ball overlaps.

    Those that aren't ``at_home`` live nowhere and visit all leaves that their balls overlap.
    """
    out = []
    at_home = np.ones(len(fps), bool) if at_home is None else at_home

    def walk(node, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, np.full(len(rows), node), home))
            return
        mask, radius, vantage, at, near, far = node
        d = distance(fps[rows], vantage, mask)
        to_near, to_far = d - radius <= at, d + radius > at
        walk(near, rows[to_near], (home & (d <= at))[to_near])
        walk(far, rows[to_far], (home & (d > at))[to_far])

    walk(tree, np.arange(len(fps)), at_home)
    rows, leaves, home = (np.concatenate(x) for x in zip(*out, strict=True))
    lives = np.full(len(fps), np.iinfo(np.int64).max)
    lives[rows[home]] = leaves[home]
    keep = leaves <= lives[rows]
    return rows[keep], leaves[keep], home[keep]


ROUTED = "tree int, leaf long, fp long, home boolean"


def _routed(tree: np.ndarray, leaf: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int64)), pa.array(fps.view(np.int64)), pa.array(home)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ROUTED.split(", ")])


def _route(batches: Iterator[pa.RecordBatch], trees: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for number, tree in enumerate(trees):
            if len(fps):
                rows, leaves, home = route(tree, fps)
                yield _routed(np.full(len(rows), number), leaves, fps[rows], home)


def _reroute(batches: Iterator[pa.RecordBatch], grown, ways: int) -> Iterator[pa.RecordBatch]:
    """Rows of the leaves that ``grown`` has a tree for go on to that tree's leaves; a leaf's number is its path in base ``ways``."""
    for batch in batches:
        tree, leaf, fps, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        fps = fps.view(np.uint64)
        order = np.lexsort((leaf, tree))
        new = np.flatnonzero(np.append(True, (np.diff(tree[order]) != 0) | (np.diff(leaf[order]) != 0))) if len(order) else []
        for rows in np.split(order, new[1:]) if len(order) else []:
            number, base = int(tree[rows[0]]), int(leaf[rows[0]]) * ways
            found = grown.value.get((number, int(leaf[rows[0]])))
            if found is None:
                yield _routed(tree[rows], np.full(len(rows), base), fps[rows], home[rows])
            else:
                at, leaves, lives = route(found, fps[rows], home[rows])
                yield _routed(np.full(len(at), number), base + leaves, fps[rows][at], lives)


def _grow(group: pd.DataFrame, forest: list, shard_rows: int, ways: int) -> pd.DataFrame:
    number, leaf, n = int(group["tree"].iloc[0]), int(group["leaf"].iloc[0]), int(group["n"].iloc[0])
    points = np.random.default_rng(0).permutation(np.sort(group["fp"].to_numpy().view(np.uint64)))
    tree = build(points, min(ways, -(-n // shard_rows)), forest[number], count())
    return pd.DataFrame({"tree": [number], "leaf": [leaf], "grown": [pickle.dumps(tree)]})


def stars(points: np.ndarray, queries: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, smaller fingerprint of its group) links that join all pairs of the two sides within ``bits``."""
    out = []
    step = max(1, TILE // max(1, min(len(points), 1024)))
    for i in range(0, len(points), 1024):
        for j in range(0, len(queries), step):
            p, q = points[i : i + 1024], queries[j : j + step]
            near = np.bitwise_count(p[:, None] ^ q[None, :]) <= bits
            near &= p[:, None] != q[None, :]
            rows, cols = near.any(axis=1), near.any(axis=0)
            if not rows.any():
                continue
            near, p, q = near[np.ix_(rows, cols)], p[rows], q[cols]
            label_p, label_q, top = p.copy(), q.copy(), np.uint64(2**64 - 1)
            while True:
                new_q = np.minimum(label_q, np.where(near, label_p[:, None], top).min(axis=0))
                new_p = np.minimum(label_p, np.where(near, new_q[None, :], top).min(axis=1))
                if (new_p == label_p).all() and (new_q == label_q).all():
                    break
                label_p, label_q = new_p, new_q
            a, b = np.concatenate([p, q]), np.concatenate([label_p, label_q])
            out.append((a[a != b], b[a != b]))
    return out


def search(points: np.ndarray, queries: np.ndarray, measures: list[tuple[int, int]], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of all near pairs between ``points`` and ``queries``, by a tree over the points that both descend."""
    if not len(points) or not len(queries):
        return []
    split = best_split(points, measures) if len(points) > LEAF else None
    if not split:
        return stars(points, queries, bits)
    mask, radius, vantage, at = split
    d, e = distance(points, vantage, mask), distance(queries, vantage, mask)
    return search(points[d <= at], queries[e - radius <= at], measures, bits) + search(points[d > at], queries[e + radius > at], measures, bits)


def _search(group: pd.DataFrame, forest: list, bits: int) -> pd.DataFrame:
    fps = group["fp"].to_numpy().view(np.uint64)
    found = search(fps[group["home"].to_numpy()], fps, forest[int(group["tree"].iloc[0])], bits)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 2
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()


# ---------------------------------------------------------------- groups


def contract(links: DataFrame) -> DataFrame:
    """Groups of linked nodes: (node, root) for each node but the roots, the smallest of their groups.

    Turns of large and small stars until nothing moves; each turn is written to the shared folder. The mins are combined
    before they are shuffled, and those of hubs are broadcast, so a hub's links don't meet in one task.
    """
    spark = links.sparkSession
    edges, path = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state, n = None, edges.count()

    def with_low(pairs: DataFrame, low: DataFrame) -> DataFrame:
        """``pairs`` (u, v) with m, what ``low`` (u, m, n) says of u."""
        return meet(pairs, low, "u", ["m"], low.where(F.col("n") > 2 * n // HUBS))

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_low(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_low(large, low).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        small, small_path = save(small, "small")
        now = tuple(small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        n = now[0]
        remove(spark, path, large_path)
        edges, path = small, small_path
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_links(fps: DataFrame, bits: int, blocks: int, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that join all pairs of distinct fingerprints (column fp) within ``bits`` of each other.

    Trees are fitted to bounded samples, drawn by a hash of the fingerprint; every row is routed by them. Shards of more
    than ``2 * shard_rows`` are split again by trees fitted to samples of their own rows, all at once; the driver and a
    broadcast hold a few numbers per shard.
    """
    spark, forest, ways = fps.sparkSession, blocks_of(bits, blocks), max(2, sample // SAMPLE_A_SHARD)
    total = fps.count()
    share = lambda n: F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < float(1 << 40) * sample / F.greatest(n, F.lit(1))
    drawn = np.sort(np.array([r["fp"] for r in fps.where(share(F.lit(total))).collect()], np.int64).view(np.uint64))
    drawn = np.random.default_rng(0).permutation(drawn)
    trees = [build(drawn, max(1, min(ways, -(-total // shard_rows))), measures, count()) for measures in forest]
    routed, path = save(fps.mapInArrow(lambda b: _route(b, trees), ROUTED), "routed")
    while True:
        sizes = routed.where("home").groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
        # One row per shard that is too large, half as many as shards at most.
        grown = routed.where("home").join(F.broadcast(sizes), ["tree", "leaf"]).where(share(F.col("n"))).groupBy("tree", "leaf")
        got = grown.applyInPandas(lambda g: _grow(g, forest, shard_rows, ways), "tree int, leaf long, grown binary").collect()
        found = {(r["tree"], r["leaf"]): pickle.loads(r["grown"]) for r in got}
        # What no vantage parts any more stays one shard.
        if not any(isinstance(tree, tuple) for tree in found.values()):
            return routed.groupBy("tree", "leaf").applyInPandas(lambda g: _search(g, forest, bits), "a long, b long")
        sent = spark.sparkContext.broadcast(found)
        old, (routed, path) = path, save(routed.mapInArrow(lambda b, sent=sent: _reroute(b, sent, ways), ROUTED), "routed")
        remove(spark, old)


def simhash_groups(docs: DataFrame, bits: int = 4, blocks: int = 3, width: int = SHINGLE) -> DataFrame:
    """Fingerprints and groups of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; ``component_id`` is the smallest doc_id
    that links reach (null if all are null). Null, empty and blank texts have fingerprint zero; long ones are read whole.
    Equal fingerprints are one node however many documents have them. Repeated rows are documents of their own; an empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    printed, _ = save(own(docs, "doc_id", "text").mapInArrow(lambda b: _fingerprint(b, width), "doc_id long, fp long"), "fingerprints")
    nodes, _ = save(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes")
    roots = contract(near_links(nodes.select("fp"), bits, blocks))
    rooted, _ = save(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
    total, different = rooted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = meet(rooted.select("fp", "root"), lowest, "root", ["component_id"], lowest.where(F.col("k") > different // HUBS))
    got = meet(printed, groups, "fp", ["component_id"], rooted.where(F.col("n") > total // HUBS))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by resemblance


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Further hashes from one, by a published 64-bit finaliser; arithmetic wraps."""
    x = h + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    # Fixed values of the finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Marks:
    """A table of bits: holds all members it was made of, and few others."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.bits, self.table = bits, np.zeros(max(1, bits // 64), np.uint64)
        self.table[words] = values

    @classmethod
    def of(cls, members: DataFrame, column: str, n: int) -> Marks:
        """Marks of about ``n`` bigints, a word of the table to a row that is collected: MOST_BITS / 64 rows at most."""
        bits = min(MOST_BITS, 1 << max(6, (MARK_BITS * max(1, n) - 1).bit_length()))
        # The low bits of a hash: 6 of them within a word.
        at = F.xxhash64(column)
        word, mask = F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(bits // 64 - 1)), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")
        got = members.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toPandas()
        return cls(bits, got["word"].to_numpy(np.int64), got["mask"].to_numpy(np.int64).view(np.uint64))

    def hold(self, values: np.ndarray) -> np.ndarray:
        at = spark_hash(values.astype(np.int64, copy=False).view(np.uint64))
        word = (at >> np.uint64(6)) & np.uint64(self.bits // 64 - 1)
        return (self.table[word.astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def spark_hash(x: np.ndarray) -> np.ndarray:
    """XXH64 of 8 bytes each with Spark's seed, 42, by the published steps; arithmetic wraps."""
    # Fixed values of the hash.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.uint64((0x27D4EB2F165667C5 + 42 + 8) % (1 << 64)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class Common:
    """Which shingles are common: ``rank`` is 0 for others, 1 for the marked, and rises from 2 with the most common."""

    def __init__(self, marks: Marks | None = None, top: np.ndarray | None = None):
        self.marks, self.top = marks, np.empty(0, np.uint64) if top is None else top
        self.by = np.argsort(self.top)

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.int64) if self.marks is None else self.marks.hold(shingles.view(np.int64)).astype(np.int64)
        if len(self.top):
            near = np.minimum(np.searchsorted(self.top[self.by], shingles), len(self.top) - 1)
            out = np.where(self.top[self.by][near] == shingles, self.by[near] + 2, out)
        return out


def shingle_sets(texts: list[str], width: int, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in turn, how many each has), by rank among the common ones, then by value."""
    import xxhash

    words = [t.encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for some in words for w in some), np.uint64, int(sizes.sum()))
    n = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    end = np.repeat(np.cumsum(sizes), n)
    got = np.zeros(len(doc), np.uint64)
    for k in range(width):  # a text of fewer words is one shingle of all of them
        some = at + k < end
        got[some] = mixed(got[some] + h[at[some] + k], k + 1)
    order = np.lexsort((got, doc) if common is None else (got, common.rank(got), doc))
    doc, got = doc[order], got[order]
    new = np.ones(len(got), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (got[1:] != got[:-1])
    return got[new], np.bincount(doc[new], minlength=len(texts))


def set_prints(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's SimHash, and its parities: bit b tells whether an odd number of members fall on b of 64 * PARITIES.

    Parities differ in at most as many bits as two sets have members that are in one of them only.
    """
    prints, parities = np.zeros(len(sizes), np.uint64), np.zeros((len(sizes), PARITIES), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        firsts = (np.cumsum(sizes) - sizes)[some]
        bits = np.unpackbits(mixed(shingles, 9).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        prints[some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view("<u8").ravel()
        at = mixed(shingles, 10)
        cell = np.repeat(np.arange(len(some)), sizes[some]) * PARITIES + (at >> np.uint64(6) & np.uint64(PARITIES - 1)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        odd = np.bitwise_xor.reduceat((np.uint64(1) << (at & np.uint64(63)))[order], new)
        parities[some[cell[new] // PARITIES], cell[new] % PARITIES] = odd
    return prints, parities


def set_keys(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, whatever the order of its members."""
    keys = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        keys[some] = np.add.reduceat(mixed(shingles, 7), (np.cumsum(sizes) - sizes)[some])
    return mixed(keys, 8) + sizes.astype(np.uint64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


SETS = "key long, shingles array<long>"
PRINTS = "doc_id long, row long, key long, size int, fp long, " + "".join(f"p{i} long, " for i in range(PARITIES)) + "first array<long>"


def _shingles(batches: Iterator[pa.RecordBatch], width: int, wanted=None) -> Iterator[pa.RecordBatch]:
    """(key, distinct shingles) of each (doc_id, text) whose id is marked as wanted; a null id always is."""
    for batch in chunks(batches):
        texts = batch.column(1)
        if wanted is not None:
            ids = batch.column(0).cast(pa.int64())
            keep = wanted.value.hold(pc.fill_null(ids, 0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            texts = texts.filter(pa.array(keep))
        flat, sizes = shingle_sets(pc.fill_null(texts, "").to_pylist(), width)
        yield pa.RecordBatch.from_arrays([pa.array(set_keys(flat, sizes).view(np.int64)), _lists(flat, sizes)], names=["key", "shingles"])


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common) -> Iterator[pa.RecordBatch]:
    """PRINTS of each (doc_id, text, row): ``first`` are as many shingles as two sets that share enough must share one of."""
    for batch in chunks(batches):
        flat, sizes = shingle_sets(pc.fill_null(batch.column(1), "").to_pylist(), width, common.value)
        firsts = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - SLACK).astype(np.int64) + 1, 0)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prints, parities = set_prints(flat, sizes)
        arrays = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(set_keys(flat, sizes).view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(prints.view(np.int64))]
        arrays += [pa.array(p.view(np.int64)) for p in parities.T.copy()] + [_lists(flat[nth < np.repeat(firsts, sizes)], firsts)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PRINTS.split(", ")])


def common_shingles(docs: DataFrame, width: int) -> Common:
    """Shingles that several of the sampled texts hold: an order that pairs are looked for in, and no more.

    The sample grows with the input, so what passes for rare is held by a bounded number of texts, about.
    """
    drawn = F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0
    sets = docs.where(drawn).select("text").distinct().select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _shingles(b, width), SETS)
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM)
    counted, path = save(counted, "common")
    # A row for each number of texts, the largest of which are few: where the table is full, the most common are marked.
    room, n, least = MOST_BITS // MARK_BITS, 0, None
    for r in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():
        if n + r["k"] > room and n:
            break
        n, least = n + r["k"], r["n"]
    if not n:
        return Common()
    marks = Marks.of(counted.where(F.col("n") >= least), "shingle", n)
    top = counted.orderBy(F.desc("n"), "shingle").limit(RANKED).collect()
    remove(docs.sparkSession, path)
    return Common(marks, np.array([r["shingle"] for r in reversed(top)], np.int64).view(np.uint64))


def near_roots(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Groups of ``docs`` (doc_id, text, row), as ``near_copies`` says: doc_id, row and root, the same for all of a group."""
    spark = docs.sparkSession
    ship(spark)
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    printed, _ = save(docs.select("doc_id", "text", "row").mapInArrow(lambda b: _prefixes(b, width, similarity, common), PRINTS), "prefixes")
    parities = [f"p{i}" for i in range(PARITIES)]
    alone = printed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "fp", *parities, "first")])
    nodes, _ = save(alone, "texts")
    postings = nodes.select("key", "size", F.posexplode("first").alias("pos", "shingle"))
    # A set holds a shingle once, so a count tells which shingles two sets hold; those of very many are HUBS at most.
    shared, _ = save(postings.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    total, different = shared.agg(F.sum("n")).first()[0] or 0, nodes.count()
    hot = shared.where(F.col("n") > total // HUBS)
    postings, _ = save(meet(postings, shared, "shingle", ["n"], hot).where("n is not null").drop("n"), "postings")

    def possible(x: str, y: str):
        """Whether sizes and the shingle's places leave room: no pair that holds is ruled out at the first shingle it shares."""
        least = similarity / (1 + similarity) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - SLACK
        room = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos")) >= least
        return room & (F.least(f"{x}.size", f"{y}.size") >= similarity * F.greatest(f"{x}.size", f"{y}.size") - SLACK)

    def alike(pairs: DataFrame) -> DataFrame:
        """The links that hold: parities rule out most others, and the rest is compared shingle by shingle."""
        of = lambda c: nodes.select(F.col("key").alias(c), F.col("size").alias(f"{c}s"), *[F.col(p).alias(c + p) for p in parities])
        apart = sum((F.bit_count(F.col("x" + p).bitwiseXOR(F.col("y" + p))) for p in parities), F.lit(0))
        most = (1 - similarity) / (1 + similarity) * (F.col("xs") + F.col("ys")) + SLACK
        pairs, pairs_path = save(pairs.join(of("x"), "x").join(of("y"), "y").where(apart <= most).select("x", "y"), "pairs")
        ids = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct().join(nodes.select("key", "doc_id"), "key").select("doc_id")
        ids, ids_path = save(ids, "wanted")
        wanted = spark.sparkContext.broadcast(Marks.of(ids.where("doc_id is not null"), "doc_id", ids.count()))
        sets, path = save(docs.select("doc_id", "text").mapInArrow(lambda b: _shingles(b, width, wanted), SETS).dropDuplicates(["key"]), "shingles")
        of = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}"))
        both = F.size(F.array_intersect("sx", "sy"))
        held = pairs.join(of("x"), "x").join(of("y"), "y").where(both >= similarity * (F.size("sx") + F.size("sy") - both))
        held, _ = save(held.select(F.col("x").alias("a"), F.col("y").alias("b")), "alike")
        remove(spark, path, pairs_path, ids_path)
        return held

    ordered = lambda x, y: (F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    # First the pairs that the fingerprints' trees link; texts of one fingerprint go with that of the smallest key.
    lowest, _ = save(nodes.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "lowest")
    same = meet(nodes.select("key", "fp"), lowest, "fp", ["low"], lowest.where(F.col("n") > different // HUBS)).where("key <> low").select(*ordered("key", "low"))
    ends = lambda c: lowest.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}"))
    near, _ = save(near_links(lowest.select("fp"), bits=4, blocks=3).distinct(), "near")
    # A star's middle is the ``b`` of all its links.
    centres = near.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > near.count() // HUBS)
    near = meet(near.join(ends("a"), "a"), ends("b"), "b", ["low_b"], centres).select(*ordered("low_a", "low_b"))
    # Then each set with the two that stand for its shingle: the one with fewest rarer shingles, which copies are made from, and the smallest key.
    heads = postings.groupBy("shingle").agg(F.min(F.struct("key", "pos", "size")).alias("low"), F.min(F.struct("pos", "key", "size")).alias("head"))
    heads = heads.select("shingle", F.array(*[F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("key", "pos", "size")]) for c in ("low", "head")]).alias("both"))
    met = meet(postings, heads, "shingle", ["both"], hot).select(F.struct("key", "pos", "size").alias("p"), F.explode("both").alias("h"))
    met = met.where((F.col("p.key") != F.col("h.key")) & possible("p", "h"))
    pairs, _ = save(met.select(*ordered("p.key", "h.key")).union(same).union(near).distinct(), "proposed")
    links = alike(pairs)
    # Then every pair that shares a first shingle and isn't linked yet, but for those whose sizes or places rule it out.
    roots = contract(links)
    left = postings.join(roots, postings["key"] == roots["node"], "left").select("shingle", "key", "size", "pos", F.coalesce("root", "key").alias("root"))
    parted = left.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    left, _ = save(left.join(parted, "shingle", "left_semi"), "left")
    mine, other = (left.select("shingle", F.struct("key", "size", "pos", "root").alias(c)) for c in "ab")
    more = mine.join(other, "shingle").where((F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & possible("a", "b"))
    more, _ = save(more.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct().join(pairs, ["x", "y"], "left_anti"), "more")
    roots = contract(links.union(alike(more)))
    copied = nodes.where(F.col("n") > printed.count() // HUBS)
    got = meet(printed.select("doc_id", "row", "key"), roots.withColumnRenamed("node", "key"), "key", ["root"], copied)
    return got.select("doc_id", "row", F.coalesce("root", "key").alias("root"))


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = SHINGLE + 1) -> DataFrame:
    """Groups of ``docs`` (doc_id, text) that share ``similarity`` of their distinct ``width``-word shingles: doc_id, component_id.

    Vantage-point trees over SimHash fingerprints of the shingle sets propose the closest pairs. What Hamming distance can't
    promise comes from an exact prefix filter: with all shingles in one order, those that a sample finds common last, two
    sets of that resemblance share one of the first ``1 - similarity`` of their shingles. A pair is left out only where
    verified links join it already, or where sizes, places or parities rule it out; all others are compared exactly,
    shingle by shingle. Texts of the same set of shingles are one. Words fold A-Z; words and shingles are 64-bit hashes.
    ``component_id`` is the smallest doc_id that links reach (null if all are null). Null, empty and blank texts are each
    other's copies; long ones are compared whole; repeated rows are documents of their own; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    rooted, _ = save(near_roots(own(docs, "doc_id", "text").withColumn("row", F.lit(0).cast("long")), similarity, width), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    got = meet(rooted.select("doc_id", "root"), least, "root", ["component_id"], least.where(F.col("n") > rooted.count() // HUBS))
    return got.select("doc_id", "component_id")
