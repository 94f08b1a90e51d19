import hashlib
import random

from stratalith.llm import fingerprints as P


def make():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefghijkl") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(1000 + i, t + " z") for i, t in enumerate(texts[:20])] + [(2000, None), (2001, ""), (2002, "\n "), (2003, "ein"), (2004, "é" * 10), (-5, "日本 語"), (2005, "w v " * 100_000)]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, _id string")
    got = {r.doc_id: r for r in P.fingerprint_documents(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    bits = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", got[i]
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - (1 - bin(bits[i] ^ int(r.edited_fingerprint, 16)).count("1") / 128)) < 1e-12
        assert abs(r.near_next - (1 - bin(bits[i] ^ bits[j]).count("1") / 128)) < 1e-12
        assert r.n_near == len({x for x in bits.values() if 0 < bin(x ^ bits[i]).count("1") <= 3})
    # the fingerprint itself, from Spark's hash of the terms
    term = spark.createDataFrame([(i, (t or "").lower().split()) for i, t in rows if i != 2005], "i long, w array<string>")
    h = term.selectExpr("i", "transform(w, x -> xxhash64(x)) h").selectExpr("i", "if(size(h) = 1, h, transform(slice(h, 1, greatest(size(h) - 1, 0)), (x, k) -> xxhash64(x, h[k + 1]))) t")
    for r in h.selectExpr("i", "transform(t, x -> array(xxhash64(x, 0), xxhash64(x, 1))) t").collect():
        if r.i == 2004 or r.i == 2002:
            continue
        want = 0
        for lane in (0, 1):
            v = [x[lane] % 2**64 for x in r.t]
            want |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in v) > len(v)) << (64 * (1 - lane))
        assert bits[r.i] == want, r.i
    assert got[2000].fingerprint == got[2001].fingerprint == got[2002].fingerprint == "0" * 32


def test_edges(spark):
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    r = P.fingerprint_documents(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert P.fingerprint_documents(one.where("doc_id = 2")).collect() == []
    rows = [(1, "a b c"), (1, "a b c"), (None, "q r s"), (2, None)]
    got = P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]


def test_every_pair_within_the_radius(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(128) for _ in range(40)]
    some = set(base) | {b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(1, 6))) for b in base for _ in range(6)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([([signed(x & (2**64 - 1)), signed(x >> 64)],) for x in some], "fp array<long>")
    got = {(r.fp[0] % 2**64) | (r.fp[1] % 2**64) << 64: r.n_near for r in P.near_links(df, 3).collect()}
    assert got == {x: sum(0 < (x ^ y).bit_count() <= 3 for y in some) for x in some}


def test_many_rows_without_an_id(spark):
    rnd = random.Random(6)
    rows = [(None if i % 3 == 0 else i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 20)))) for i in range(90)]
    got = P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 90 and sum(r.doc_id is None for r in got) == 30
    prints = {t: r.fingerprint for (i, t) in rows for r in got if r.doc_id == i and i is not None}
    again = P.fingerprint_documents(spark.createDataFrame([(7, t) for _, t in rows], "doc_id long, text string")).collect()
    assert set(prints.values()) <= {r.fingerprint for r in again} and {r.fingerprint for r in again} == {r.fingerprint for r in got}
