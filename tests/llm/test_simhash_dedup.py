import random

import numpy as np
import xxhash

from stratalith.llm import simhash_dedup as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    comp = list(range(len(items)))
    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= 3:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_shards_find_every_link():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[rnd.integers(0, 400, 1200)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rnd.integers(0, 64, 1200).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    nodes = S.build_tree(fps[::3], 8)
    idx, shard, home = S.route(nodes, fps, 3)
    assert home.sum() == len(fps) and len(set(shard.tolist())) >= 6
    forest = S.Forest(len(fps))
    for s in set(shard.tolist()):
        at = shard == s
        f = S.link(fps[idx[at]], home[at], 3)
        forest.join(idx[at], idx[at][f.find(np.arange(at.sum()))])
    got = forest.find(np.arange(len(fps)))
    want = brute_components([int(x) for x in fps])
    assert got.tolist() == want


def test_classes(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["Aa", "b", "c", "dd", "é", "zz"]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 80))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts[:30])] + [(200 + i, t + " tail") for i, t in enumerate(texts[:60])]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "one two"), (None, texts[0]), (None, "never seen before this"), (1, texts[1]), (305, "w " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, _k string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.classes(df, shard=40).collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, 2**63 - 1), 2**63 - 1 if i is None else i)
    want = sorted((str(i), f"{f:016x}", "None" if least[c] == 2**63 - 1 else str(least[c])) for (i, _), f, c in zip(rows, fps, comp))
    assert got == want
    assert S.classes(df.where("doc_id < 0")).collect() == []


def test_keep_one_row_of_each_component(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, e), (3, c), (None, e.upper())]  # a, b, c, d, e: two null ids, a repeated id of two texts
    df = spark.createDataFrame([(*r, {"k": n}, n) for n, r in enumerate(rows)], "doc_id long, text string, extra map<string,int>, fp int")
    got = S.keep_one(df, shard=3)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("None", a), ("None", b), ("1", c), ("1", d), ("3", e)])


def near_family(rnd, n, base=400):
    base = rnd.integers(0, 2**63, base, dtype=np.uint64)
    near = base[rnd.integers(0, len(base), n)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([base, near]))


def test_a_tree_for_each_part_finds_every_link():
    fps = near_family(np.random.default_rng(4), 1500)
    want = brute_components([int(x) for x in fps])
    for parts in (2, 4):
        forest = S.Forest(len(fps))
        for k in range(parts):
            of = S.part_of(fps, parts, k)
            idx, shard, home = S.route(S.build_tree(of[::2], 8, 3 // parts), of, 3 // parts)
            assert home.sum() == len(fps) and len(set(shard.tolist())) >= 6
            for s in set(shard.tolist()):
                at = shard == s
                f = S.link(fps[idx[at]], home[at], 3, of[idx[at]], 3 // parts)
                forest.join(idx[at], idx[at][f.find(np.arange(at.sum()))])
        assert forest.find(np.arange(len(fps))).tolist() == want


def test_copies_and_shard_sizes_as_shards_grow():
    rnd = np.random.default_rng(5)
    fps = rnd.integers(0, 2**64, 60_000, dtype=np.uint64)
    for leaves, most in ((8, 3), (500, 4.1), (10_000, 4.1)):
        copies, trees = S.plan(rnd.integers(0, 2**64, max(4096, 16 * leaves), dtype=np.uint64), leaves, 3)
        parts, total = len(trees), 0
        for k, nodes in enumerate(trees):
            idx, shard, home = S.route(nodes, S.part_of(fps, parts, k), 3 // parts)
            at_home = np.bincount(shard[home])
            total += len(idx)
            assert len(nodes) + 1 >= 0.9 * leaves and at_home.max() <= 8 * len(fps) / leaves + 20
        assert total / len(fps) <= most and abs(copies - total / len(fps)) < 1


def test_a_crowded_shard_is_compared_in_tiles(spark):
    rnd = np.random.default_rng(6)
    centre = int(rnd.integers(0, 2**63))
    crowd = {centre ^ sum(1 << int(b) for b in set(rnd.integers(0, 64, rnd.integers(0, 6)))) for _ in range(1500)}  # within five bits of each other's centre
    fps = np.unique(np.concatenate([np.array(list(crowd), np.uint64), near_family(rnd, 300, 100)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want = brute_components([int(x) for x in fps])
    for shard, bound in ((10**6, 200), (300, 150)):
        forest = S.Forest(len(fps))
        edges = S.linked(df, 3, shard, bound).collect()
        forest.join(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
        assert forest.find(np.arange(len(fps))).tolist() == want
