import math
import random

import pytest

from stratalith.llm import mixing as M


def make(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        source = rnd.choices(["a", "b", "c", None], [20, 5, 2, 1])[0]
        rows.append((i, "w " * rnd.randint(0, 50), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "x y z", "b"), (5, "again", rows[5][2])]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, place string"), rows


def totals(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + len((t or "").split())
    return out


def test_entropy_and_budget(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 16)
    df, rows = make(spark)
    got = M.mix(df, target_entropy=0.9).collect()
    n = totals(rows)
    w = {r.source: r.weight for r in got}
    assert abs(sum(w.values()) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w.values() if x) - 0.9 * math.log(4)) < 1e-6
    total = sum(n.values())
    longest = max(r.n_tokens for r in got)
    for s, tokens in n.items():
        used = sum(r.copies * r.n_tokens for r in got if r.source == s)
        budget = round(w[s] * total)
        assert budget - longest <= used <= budget or tokens == 0
        assert not tokens or max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s and r.n_tokens) <= 1


def test_repeats_keep_every_document(spark):
    df, rows = make(spark)
    plan = M.mix(df, max_repeats=2.0)
    got = plan.collect()
    assert all(1 <= r.copies <= 2 for r in got) and max(r.copies for r in got) == 2
    out = M.realise(df, plan)
    assert out.columns == df.columns
    copies = {(r.doc_id, r.source): r.copies for r in got}
    assert out.count() == sum(copies[i, s] for i, _, s in rows)
    assert M.mix(df.where("doc_id < 0"), max_repeats=2.0).collect() == []
    with pytest.raises(ValueError):
        M.mix(df)


def test_a_target_below_the_plain_entropy_and_one_source(spark):
    df, rows = make(spark)
    n = [x for x in totals(rows).values() if x]
    plain = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(4)
    w = {r.source: r.weight for r in M.mix(df, target_entropy=plain / 2).collect()}
    assert abs(-sum(x * math.log(x) for x in w.values() if x) - plain / 2 * math.log(4)) < 1e-6 and w["a"] > max(n) / sum(n)
    assert {r.weight for r in M.mix(df.where("source = 'b'"), target_entropy=0.5).collect()} == {1.0}
