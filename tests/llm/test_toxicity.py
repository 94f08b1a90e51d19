import itertools
import random
import zlib

import numpy as np

from stratalith.llm import toxicity as T


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    emit = rng.normal(0, 2, 31)
    first = np.zeros(31, bool)
    first[[0, 1, 9, 20]] = True
    f = T.Field(np.zeros(1), 0.0, np.array([[0.9, 0.2], [0.4, 1.3]]), 0.3)
    p, _, _ = T.marginals(emit, first, f)
    ends = [*np.flatnonzero(first), 31]
    for a, b in zip(ends, ends[1:]):
        total, on = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            w = f.start ** path[0]
            for t, s in enumerate(path):
                w *= np.exp(emit[a + t]) ** s * (f.trans[path[t - 1], s] if t else 1)
            total += w
            on += w * np.array(path)
        assert np.allclose(p[a:b], on / total)


def docs(n, seed):
    rnd, out = random.Random(seed), []
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "an", "os"]) for _ in range(rnd.randint(1, 4)))
    for i in range(n):
        bad = rnd.random() < 0.2
        words = [word() for _ in range(rnd.randint(20, 200))]
        if bad:
            for _ in range(rnd.randint(2, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(["Grobian", "schuft", "vexu" + word(), "vexu" + word()])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = docs(1500, 1)
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "schuft grobian", "x"), (9003, "ka " * 400_000, "x"), (5, rows[5][1], "x")], "doc_id long, text string, _text string")
    l = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    f = T.fit(d, l)
    got = T.score(d, f).collect()
    assert len(got) == 1505 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    right = [(by[i].score >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(right) / len(right) > 0.95
    assert by[9001].score == by[9002].score < 0.5 and by[9003].score < 0.7 and by[None].score >= 0.5
    for i, t, y in rows[:100]:
        for s in by[i].spans:
            assert t.lower().encode()[s.start : s.end].decode().startswith(("grob", "schuft", "vexu")) or not y
    assert T.score(d.where("doc_id < 0"), f).collect() == []
    empty = T.fit(d, l.where("doc_id < 0"))
    assert {r.score >= 0.7 for r in T.score(d.limit(5), empty).collect()} == {False}
