import random

import numpy as np

from stratalith.llm import decontaminate as D


def edit_slow(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def make(seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)] + ["the"] * 60
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, words(rnd.randint(15, 60))) for i in range(40)]
    docs, planted = [], {}
    for d in range(300):
        text = words(rnd.randint(0, 400))
        if d % 2:
            i, item = items[rnd.randrange(40)]
            item, share = list(item), rnd.choice([0, 0.05, 0.1, 0.15])
            for _ in range(int(share * len(item))):
                k = rnd.randrange(len(item))
                kind = rnd.choice("sid")
                item[k : k + 1] = [rnd.choice(vocab)] if kind == "s" else [item[k], rnd.choice(vocab)] if kind == "i" else []
            at = rnd.randint(0, len(text))
            text[at:at] = item
            planted[d] = i
        docs.append((d, text))
    return items, docs, planted


def test_distance():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)
        assert D.passage_distance(a, b)[0] == edit_slow(a.tolist(), b.tolist())


def test_recall_and_precision(spark):
    items, docs, planted = make()
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "the"), (None, "")], "item_id long, text string")
    rows = [(d, rnd_case(t)) for d, t in docs] + [(1000, None), (1001, ""), (None, " ".join(items[3][1])), (1002, " ".join(items[4][1])), (1003, "pad " * 300_000 + " ".join(items[5][1]))]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, item_id int, _text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in D.contaminated(df, i).collect()}
    text = dict(docs)
    truth = {(d, k) for d, t in docs for k, w in items if planted.get(d) == k and edit_slow(w, t) <= int(0.2 * len(w))}
    assert {(None, 3), (1002, 4), (1003, 5)} <= set(got)
    exact = {x for x in truth if edit_slow(dict(items)[x[1]], text[x[0]]) == 0}
    assert exact <= set(got)
    assert len(truth & set(got)) / len(truth) >= 0.97, (len(truth & set(got)), len(truth))
    for (d, k), n in got.items():
        if d in text:
            assert edit_slow(dict(items)[k], text[d]) <= int(0.2 * len(dict(items)[k]))
    assert D.contaminated(df.where("doc_id < 0"), i).collect() == [] and D.contaminated(df, i.where("item_id < 0")).collect() == []


def rnd_case(words):
    return " ".join(w.upper() if k % 3 else w + "," for k, w in enumerate(words))


def test_short_items():
    classes = D.make_classes([(1, "a b c d e"), (2, "a b c d e f g"), (3, "x y")])
    from stratalith.llm.words import WORDISH, Words, buffers
    import pyarrow as pa

    raw, off = buffers(pa.array(["q a b c d e", "a b c d e f g", "a b c z e f g"]))
    assert sorted((r, i, d) for r, i, d, _ in D.search(Words(raw, off, WORDISH), classes)) == [(0, 1, 0), (1, 1, 0), (1, 2, 0), (2, 1, 1), (2, 2, 1)]


def found(items, docs, **how):
    from stratalith.llm.words import WORDISH, Words, buffers
    import pyarrow as pa

    raw, off = buffers(pa.array([" ".join(t) for t in docs]))
    return {(r, i): d for r, i, d, _ in D.search(Words(raw, off, WORDISH), D.make_classes([(i, " ".join(t)) for i, t in items], **how))}


def test_no_occurrence_within_the_edits_is_lost():
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate([15, 28, 28, 40, 59, 22])]
    docs = []
    for _, t in items:
        tau = len(t) // 5
        docs += [t[tau:], t[:-tau], words(200) + t[tau:], words(37) + t[tau:] + words(50), words(tau) + t[tau:]]  # cut or rewritten at an end; alone, last, inside
        for _ in range(20):
            cut = list(t)
            for k in rnd.sample(range(len(t)), tau):
                cut[k] = rnd.choice(["other", None])
            docs.append(words(rnd.randrange(60)) + [x for x in cut if x] + words(rnd.choice([0, 30])))
    want = {(r, i): d for r, t in enumerate(docs) for i, w in items if (d := edit_slow(w, t)) <= len(w) // 5}
    assert len(want) >= len(docs)
    assert found(items, docs) == want


def test_short_items_and_least_edits():
    short = [(1, ["x"]), (2, ["x", "y"]), (3, "p q r s".split())]
    docs = ["a x b".split(), "x y".split(), "z p q r s".split(), "p q r t".split(), "xy".split(), ["y", "x"]]
    assert found(short, docs, min_words=1) == {(0, 1): 0, (1, 1): 0, (1, 2): 0, (2, 3): 0, (5, 1): 0}
    assert found(short, docs) == {}
    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(12)]
    items = [(i, [rnd.choice(vocab) for _ in range(20)]) for i in range(4)]
    docs = []
    for _ in range(40):  # several places of one item, near each other, of unlike edits
        out = []
        for _ in range(3):
            t = list(rnd.choice(items)[1])
            for k in rnd.sample(range(20), rnd.randint(0, 4)):
                t[k] = rnd.choice(vocab)
            out += t[rnd.randint(0, 3) :]
        docs.append(out)
    want = {(r, i): d for r, t in enumerate(docs) for i, w in items if (d := edit_slow(w, t)) <= 4}
    assert found(items, docs) == want


def planted(seed, sizes, share=0.2, per=12):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items, docs = [(i, words(rnd.randint(lo, hi))) for i, (lo, hi) in enumerate(sizes)], []
    for i, item in items:
        for _ in range(per):
            t = list(item)
            for _ in range(int(share * len(item))):
                k, kind = rnd.randrange(len(t)), rnd.choice("sid")
                t[k : k + 1] = [rnd.choice(vocab)] if kind == "s" else [t[k], rnd.choice(vocab)] if kind == "i" else []
            docs.append((i, words(rnd.randrange(80)) + t + words(rnd.randrange(80))))
    return items, docs


def test_recall_over_lengths_at_the_full_edit_budget():
    items, docs = planted(11, [(5, 9), (10, 14), (15, 29), (30, 60), (60, 100), (150, 290), (400, 790), (1000, 1000)])
    got = found(items, [t for _, t in docs])
    for r, (i, t) in enumerate(docs):  # by construction all are within the edits
        assert (r, i) in got
        if len(t) < 300:
            assert got[r, i] == edit_slow(dict(items)[i], t)


def test_repetitions_reach_the_target_where_windows_may_hold_edits():
    items, docs = planted(12, [(12, 20), (20, 40), (40, 90)], per=60)
    got = found(items, [t for _, t in docs], window_edits=1, target=0.95)
    assert sum((r, i) in got for r, (i, _) in enumerate(docs)) / len(docs) >= 0.95
    assert D.repeats(8, 0, 0.95) == 1 < D.repeats(8, 1, 0.95) < D.repeats(8, 1, 0.99) < D.MOST_REPEATS
