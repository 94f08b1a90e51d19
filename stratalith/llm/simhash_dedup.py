"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Distinct fingerprints are split into shards by a vantage-point tree: a node
holds a vantage fingerprint and a radius, and sends what is nearer to the left.
A fingerprint lives in one home shard and also visits every later shard that
the triangle inequality cannot rule out for its search radius, so each linked
pair meets in exactly one shard of a tree. Within a shard the same bounds prune
a second, finer tree over rings of equal distance, and what is left is compared
exactly.

Random fingerprints crowd at the boundaries of a tree: with radius 3 of 64 bits
every level sends half of them both ways, so copies grow as the number of
shards to the power 0.6. Two fingerprints within r bits lie within r // p bits
in one of p equal parts, so there may be a tree for each part instead, over the
distances of that part and with that radius: power 0.3 for two parts, and just
four copies for four. The plan with the fewest copies on the sample is taken.

A shard of more rows than a task should hold (a family of very many unlike
fingerprints within few bits of each other, which no distance tells apart) is
compared in tiles of blocks of its rows.

A shard returns a spanning forest of its links, never all pairs, and components
are found over those edges; copies of one text are one fingerprint throughout.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalith.llm.components import connected
from stratalith.llm.keys import NULL_ID, ensure_checkpoint_dir, id_key, table
from stratalith.llm.words import buffers, chunks, mix

U64 = np.uint64
log = logging.getLogger(__name__)
#: Fingerprints in the sample from which the driver builds the top of the tree: at least, for each shard, at most.
SAMPLE, SAMPLE_EACH, SAMPLE_MOST = 4096, 16, 1 << 20
#: Fingerprints at home in one shard, about; rows in one task at most (twice as many in a tile).
SHARD, BOUND = 100_000, 400_000
TILE = 1 << 18
#: How many parts a fingerprint may be cut into.
PARTS = (1, 2, 4)


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42); A-Z count as a-z."""
    words = data.lower().split()  # for bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    if shingle == 3:
        hashes = [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 18):
        h = np.array(hashes[lo : lo + (1 << 18)], U64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, also: dict[str, Column] | None = None) -> DataFrame:
    """_id (as given), _k (null as the largest), the long columns `also` and fp (long) for each row."""
    also = also or {}
    carried = ["_id", "_k", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("_text"))
            for lo, hi in chunks(offsets):
                fps = np.fromiter((fingerprint(raw[offsets[i] : offsets[i + 1]].tobytes(), shingle) for i in range(lo, hi)), U64, hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in carried), pa.array(fps.view(np.int64))], names=[*carried, "fp"])

    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), id_key(id_col).alias("_k"), *(x.alias(c) for c, x in also.items()), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return df.mapInArrow(run, "".join(f"{c} long, " for c in carried) + "fp long")


# ---------------------------------------------------------------- the top of the tree, on the driver


def build_tree(sample: np.ndarray, leaves: int, radius: int = 3) -> list:
    """Nodes as (vantage, radius, left, right), a negative child -1-k is leaf k.

    Of some vantages and of all distances that leave 30 % on either side the
    split is taken that makes the fewest visitors for what it tells apart.
    """
    nodes: list = []
    count = [0]

    def leaf() -> int:
        count[0] += 1
        return -count[0]

    def grow(part: np.ndarray, want: int) -> int:
        if want <= 1 or len(part) < 8:
            return leaf()
        tries, n, best = part[:: max(1, len(part) // 16)][:16], len(part), None
        for t in tries:
            upto = np.cumsum(np.bincount(np.bitwise_count(part ^ t), minlength=65))
            able = np.flatnonzero((upto >= 0.3 * n) & (upto <= 0.7 * n))
            for r in able.tolist() or [int(np.searchsorted(upto, n / 2))]:
                p = upto[r] / n
                if p < 1:
                    visits = (upto[min(64, r + radius)] - upto[max(0, r - radius)]) / n
                    cost = np.log2(1 + visits) / -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
                    if best is None or cost < best[0]:
                        best = (cost, t, r, p)
        if best is None:
            return leaf()
        _, vantage, r, p = best
        near = np.bitwise_count(part ^ vantage) <= r
        me, first = len(nodes), min(max(1, round(want * p)), want - 1)
        nodes.append(None)
        left = grow(part[near], first)
        right = grow(part[~near], want - first)
        nodes[me] = (int(vantage), r, left, right)
        return me

    root = grow(sample, leaves)
    return nodes if root >= 0 else []


def route(nodes: list, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, at home) for each fingerprint's home shard and each later one that it has to visit."""
    if not nodes:
        n = len(fps)
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    out: list = []

    def walk(node: int, idx: np.ndarray, home: np.ndarray) -> None:
        if len(idx) == 0:
            return
        if node < 0:
            out.append((idx, np.full(len(idx), -1 - node, np.int64), home))
            return
        vantage, r, left, right = nodes[node]
        d = np.bitwise_count(fps[idx] ^ U64(vantage)).astype(np.int16)
        near = d <= r
        # to the left go those at home there; a visitor only moves right of its home
        go = near if not (~home).any() else (near | (~home & (d - radius <= r)))
        walk(left, idx[go], home[go] & near[go])
        go = ~near | (d + radius > r)
        walk(right, idx[go], home[go] & ~near[go])

    walk(0, np.arange(len(fps)), np.ones(len(fps), bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)


# ---------------------------------------------------------------- inside a shard


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[i] = r
                return r
            r = s

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            differ = a != b
            if not differ.any():
                return
            lo, hi = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            self.up[hi] = lo  # of several writes to one place the last holds; the rest follow in the next turn
            i, j = i[differ], j[differ]


def part_of(fps: np.ndarray, parts: int, k: int) -> np.ndarray:
    """The k-th of `parts` equal parts of the fingerprints' bits."""
    width = 64 // parts
    return (fps >> U64(k * width)) & U64((1 << width) - 1)


def link(fps: np.ndarray, home: np.ndarray, radius: int, part: np.ndarray | None = None, part_radius: int = 0) -> Forest:
    """Union of the pairs within `radius` (and, if a part is given, within part_radius there) of which one is at home here; others may be found too."""
    forest, mine = Forest(len(fps)), np.flatnonzero(home)
    metrics = ([] if part is None else [(part, part_radius)]) + [(fps, radius)]

    def brute(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, TILE // max(1, min(len(b), TILE)))
        for lo in range(0, len(a), step):
            x = a[lo : lo + step]
            for lb in range(0, len(b), TILE):
                y = b[lb : lb + TILE]
                rx, ry = forest.find(x), forest.find(y)
                if (rx == rx[0]).all() and (ry == rx[0]).all():
                    continue
                i, j = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= radius)
                i, j = x[i], y[j]
                forest.join(i[i != j], j[i != j])

    def search(a: np.ndarray, b: np.ndarray, depth: int, level: int) -> None:
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= TILE or depth > 24:
            return brute(a, b)
        of, reach = metrics[level]
        vantage = of[a[(len(a) * 7 + depth * 13) // 11 % len(a)]]
        da, db = np.bitwise_count(of[a] ^ vantage), np.bitwise_count(of[b] ^ vantage)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        a, da, b, db = a[oa], da[oa].astype(np.int16), b[ob], db[ob].astype(np.int16)
        if da[-1] - da[0] <= reach and db[-1] <= da[-1] + reach and db[0] >= da[0] - reach:
            if level + 1 < len(metrics):
                return search(a, b, depth, level + 1)
            half = len(a) // 2  # all in one ring: no bound helps, so the block is halved
            search(a[:half], b, depth + 1, level)
            return search(a[half:], b, depth + 1, level)
        for v in range(int(da[0]), int(da[-1]) + 1, reach + 1):
            x = a[np.searchsorted(da, v, "left") : np.searchsorted(da, v + reach, "right")]
            y = b[np.searchsorted(db, v - reach, "left") : np.searchsorted(db, v + 2 * reach, "right")]
            search(x, y, depth + 1, level)

    search(mine, np.arange(len(fps)), 0, 0)
    return forest


def plan(sample: np.ndarray, leaves: int, radius: int) -> tuple[float, list[list]]:
    """Copies of each fingerprint, and a tree for each part, of the plan that makes the fewest."""
    best = None
    for parts in PARTS:
        trees = [build_tree(part_of(sample, parts, k), leaves, radius // parts) for k in range(parts)]
        copies = sum(len(route(t, part_of(sample, parts, k), radius // parts)[0]) for k, t in enumerate(trees)) / max(1, len(sample))
        if best is None or copies < best[0]:
            best = (copies, trees)
    return best


def linked(distinct: DataFrame, radius: int = 3, shard: int = SHARD, bound: int = BOUND) -> DataFrame:
    """Edges (a, b) of a spanning forest, shard by shard, over distinct fingerprints (column fp)."""
    n = distinct.count()
    leaves, trees = max(1, math.ceil(n / shard)), [[]]
    if leaves > 1:
        want = max(SAMPLE, min(SAMPLE_EACH * leaves, SAMPLE_MOST))
        some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(min(1.0, want / n) * (1 << 30)))).collect()
        copies, trees = plan(np.array([r.fp for r in some], np.int64).view(U64), leaves, radius)
        log.info("%d fingerprints, %d trees of %d shards, %.1f copies of each", n, len(trees), leaves, copies)
    parts = len(trees)

    def routed(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k, nodes in enumerate(trees):
            idx, where, home = route(nodes, part_of(fps, parts, k), radius // parts)
            yield idx, where + (k << 32), home

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, where, _ in routed(np.asarray(batch.column("fp")).astype(np.int64).view(U64)):
                shards, rows = np.unique(where, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(rows.astype(np.int64))], names=["shard", "n"])

    counted = distinct.mapInArrow(sizes, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    blocks = {r.shard: math.ceil(r.n / bound) for r in counted.where(F.col("n") > bound).collect()}  # the shards are as many as the leaves

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp")).astype(np.int64)
            for idx, where, home in routed(fps.view(U64)):
                some = np.isin(where, list(blocks)) if blocks else np.zeros(len(where), bool)
                zero = np.zeros(int((~some).sum()), np.int64)
                out = [(where[~some], zero, zero, fps[idx][~some], home[~some])]
                for s in np.unique(where[some]).tolist():
                    x, h, k = fps[idx][where == s], home[where == s], blocks[s]
                    mine = (mix(x.view(U64), 5) % U64(k)).astype(np.int64)
                    for i in range(k):
                        # block i of those at home meets the home rows of blocks from i on, and the visitors of all blocks
                        with_ = ~h | (mine >= i)
                        out.append((np.full(int(with_.sum()), s), np.full(int(with_.sum()), i), mine[with_], x[with_], (h & (mine == i))[with_]))
                        for j in (j for j in range(k) if j != i):
                            a = x[h & (mine == i)]
                            out.append((np.full(len(a), s), np.full(len(a), i), np.full(len(a), j), a, np.ones(len(a), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["shard", "i", "j", "fp", "home"])

    def solve(t: pa.Table) -> pa.Table:
        fps, k = t.column("fp").to_numpy().astype(np.int64), t.column("shard")[0].as_py() >> 32
        part = None if parts == 1 else part_of(fps.view(U64), parts, k)
        forest = link(fps.view(U64), t.column("home").to_numpy().astype(bool), radius, part, radius // parts)
        root = forest.find(np.arange(len(fps)))
        at = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[at], "b": fps[root[at]]})

    return distinct.mapInArrow(spread, "shard long, i long, j long, fp long, home boolean").groupBy("shard", "i", "j").applyInArrow(solve, "a long, b long")


def _rooted(marked: DataFrame, radius: int, shard: int) -> DataFrame:
    """Each fingerprint (fp) with its least id (k) and the root of its component."""
    by_fp = marked.groupBy("fp").agg(F.min("_k").alias("k"))
    roots = connected(linked(by_fp.select("fp"), radius, shard))
    return by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "k", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Fingerprint and component of every document.

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest
    doc_id reachable over links of `radius` or fewer differing bits.

    Null and empty texts, and texts of white space, have fingerprint zero and
    link like any other. A null id counts as the largest; a component of only
    null ids has a null component_id. Repeated rows come back as often as they
    are given. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    marked = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    named = _rooted(marked, radius, shard)
    least = named.groupBy("root").agg(F.min("k").alias("c"))
    of = named.join(least, "root").select("fp", "c")
    return marked.join(of, "fp").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"), F.col("_k").alias("_k")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """One row of docs, with all columns, for each component: that of smallest id (null as the largest), then of least text hash.

    Rows are told apart by id and text, so neither a repeated id nor a null one
    stands for more than its own component. Of rows equal in both, the one of
    least hash of the other columns (as far as Spark can hash them) stays.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    hashes = {"_stx_a": F.xxhash64(text), "_stx_b": F.xxhash64(F.lit(1), text)}
    marked = fingerprints(docs, id_col, text_col, shingle, hashes).checkpoint()
    best = marked.join(_rooted(marked, radius, shard).select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct("_k", *hashes)).alias("m")).select(F.col("m._k").alias("_stx_k"), *(f"m.{c}" for c in hashes))
    key = ["_stx_k", *hashes]
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    w = Window.partitionBy(*key).orderBy(F.xxhash64(*rest))
    # copies of a row go first, as far as possible before the shuffle
    keyed = docs.withColumns({"_stx_k": id_key(id_col), **hashes}).withColumn("_stx_n", F.row_number().over(w)).where("_stx_n = 1")
    return keyed.join(best, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("_k")
