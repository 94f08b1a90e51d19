import hashlib
import random

from stratalith.llm.substring_dedup import longest_repeats, remove_repeats


def brute(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    earlier, out, i = {}, [None] * len(rows), 0
    while i < len(order):
        same = [j for j in order if rows[j][0] == rows[order[i]][0]]
        new = set()
        for j in same:
            w = (rows[j][1] or "").encode().split()
            gone, own = [False] * len(w), set()
            for s in range(len(w) - window + 1):
                g = tuple(w[s : s + window])
                if g in earlier or g in own:
                    gone[s : s + window] = [True] * window
                own.add(g)
            new |= own
            kept = b" ".join(x for x, y in zip(w, gone) if not y)
            out[j] = (rows[j][0], len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        earlier.update(dict.fromkeys(new))
        i += len(same)
    return out


def run(spark, rows, window):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _k string, h int")
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in remove_repeats(df, window=window).collect()]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 40))) for _ in range(12)]
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join([rnd.choice(pool) for _ in range(rnd.randint(0, 4))] + [str(rnd.random()) for _ in range(rnd.randint(0, 30))])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "é " * 60), (203, rows[5][1]), (204, rows[5][1]), (204, rows[5][1]), (None, rows[7][1]), (None, "a b"), (205, "x " * 19), (206, "q\x0br\x0cs\x85t " * 30)]
    rows.append((207, " ".join(str(i % 5000) for i in range(400_000))))
    for window in (20, 11):
        key = lambda r: (str(r[0]), r)
        assert sorted(run(spark, rows, window), key=key) == sorted(brute(rows, window), key=key)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_rows_without_an_id(spark):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    rows = [(None if i % 3 else i, " ".join(rnd.choice(pool) if rnd.random() < 0.5 else str(rnd.random()) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (3, rows[6][1]), (None, None)]
    key = lambda r: (str(r[0]), r)
    assert sorted(run(spark, rows, 20), key=key) == sorted(brute(rows, 20), key=key)


def test_doubling_goes_on_until_nothing_survives(spark):
    rnd = random.Random(4)
    fresh = lambda n: [f"{rnd.random():.9f}" for _ in range(n)]
    a, b, c = fresh(170), fresh(25), fresh(85)
    rows = [(0, fresh(30) + a + fresh(5)), (1, a + fresh(50)), (2, fresh(3) + b), (3, b + fresh(40)), (4, fresh(300)), (5, c + c), (6, fresh(19)), (None, a[:45] + fresh(9)), (8, None), (9, fresh(10))]
    rows.append((10, rows[4][1]))
    got = {r.doc_id: r.repeated for r in longest_repeats(spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert got == {0: 160, 1: 160, 2: 20, 3: 20, 4: 0, 5: 80, 6: 0, None: 40, 8: 0, 9: 0, 10: -1}
    assert longest_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
