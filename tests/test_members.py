"""Operators without SQL against brute force, their edges, and registered queries against DuckDB."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.functions import dates as D, mathfn as M, random as R, stats, text as N
from stratalith.operators import functional, joins, ml, timeseries
from stratalith.operators.shapes import Frame, Series
from stratalith.plans import array_members, catalog, checks, frame_members, io_members, model_members, scalar_members  # noqa: F401
from stratalith.sources import csvio


def stump(rows, depth, least=2):
    """A tree by trying everything: rows of (features, y)."""
    y = [r[1] for r in rows]
    mean, best = sum(y) / len(y), None
    if depth and len(rows) >= least:
        for f in range(len(rows[0][0])):
            for v in sorted({r[0][f] for r in rows})[:-1]:
                a, b = [r[1] for r in rows if r[0][f] <= v], [r[1] for r in rows if r[0][f] > v]
                gain = sum(a) ** 2 / len(a) + sum(b) ** 2 / len(b) - sum(y) ** 2 / len(y)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, v)
    if best is None:
        return lambda x: mean
    _, f, v = best
    left, right = stump([r for r in rows if r[0][f] <= v], depth - 1, least), stump([r for r in rows if r[0][f] > v], depth - 1, least)
    return lambda x: left(x) if x[f] <= v else right(x)


def test_trees_and_boosting_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [((rnd.randint(0, 12) * 1.0, round(rnd.random(), 2)), rnd.choice([0.0, 1.0, 5.0]) + rnd.random()) for _ in range(120)]
    rows += [((5.0, 0.5), 9.0)] * 40  # one value holds a quarter
    df = spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, y double")
    tree = stump(rows, 3)
    for how in ("exhaustive", "histogram"):
        t = ml.RegressionTree(df, ["a", "b"], "y", 3, split=how)
        got = {(r.a, r.b): r.p for r in df.select("a", "b", t.predict().alias("p")).collect()}
        assert all(got[x] == pytest.approx(tree(x)) for x, _ in rows), how
    g = ml.GradientBoosting(df, ["a", "b"], "y", boosts=3, max_depth=2, rate=0.5)
    mean = sum(y for _, y in rows) / len(rows)
    value = {x: mean for x, _ in rows}
    for _ in range(3):
        t = stump([(x, y - value[x]) for x, y in rows], 2)
        value = {x: v + 0.5 * t(x) for x, v in value.items()}
    got = {(r.a, r.b): r.p for r in df.select("a", "b", g.predict().alias("p")).collect()}
    assert all(got[x] == pytest.approx(value[x]) for x in value)
    flat = ml.RegressionTree(df.withColumn("y", F.lit(2.0)), ["a"], "y", 2)
    assert df.select(flat.predict().alias("p")).distinct().collect()[0].p == 2.0


def test_kmeans_is_a_fixed_point_and_the_best_start(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    centers, out, inertia = ml.kmeans(df, "v", 3)
    label = {r.id: r.cluster for r in out.collect()}
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert label.pop(999) is None and [label[i] for i in range(len(x))] == d.argmin(axis=1).tolist()
    assert inertia == pytest.approx(d.min(axis=1).sum())
    assert all(np.allclose(centers[c], x[d.argmin(axis=1) == c].mean(axis=0)) for c in range(3)) and inertia < 0.09 * 3 * len(x) * 1.2


def test_solvers_agree_and_classes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=300) > 0.3).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fits = [ml.logistic_regression(df, ["a", "b"], "y", solver=s) for s in ("newton", "majorization", "trust_region")]
    assert np.allclose(fits[0], fits[1], atol=1e-3) and np.allclose(fits[0], fits[2], atol=1e-4)
    m = ml.logistic_classes(df, ["a", "b"], "y")
    assert np.allclose(m[0.0], -m[1.0]) and ml.accuracy(df, F.col("y"), ml.predict_class(m, ["a", "b"])) > 0.8
    sv = ml.SupportVectors(df.withColumn("c", (F.abs("a") > 1).cast("int")), ["a"], "c", "rbf", 100.0, 1.0)
    assert ml.accuracy(df, (F.abs("a") > 1).cast("int"), sv.predict()) > 0.97
    with pytest.raises(ValueError):
        ml.SupportVectors(df, ["a"], "y", most=10)


def test_quantiles_with_ties_and_nulls(spark):
    values = [3.0] * 50 + [1.0, 2.0, None, None, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    at = [0.0, 0.01, 0.42, 0.98, 1.0]
    got = {r.p: r.q for r in stats.quantiles(df, "v", at).collect()}
    assert all(got[p] == pytest.approx(np.quantile([v for v in values if v is not None], p)) for p in at)
    assert [r.q for r in stats.quantiles(df.where("v > 99"), "v", [0.5]).collect()] == [None]
    with pytest.raises(ValueError):
        stats.quantiles(df, "v", [1.1])
    lo, hi = df.agg(F.min("v"), F.max("v")).first()
    five = stats.estimate_five(df, "v").first()
    assert (five["min"], five["max"]) == (lo, hi) and abs(five["median"] - 3.0) <= (hi - lo) / 10_000


def test_averages_over_series_in_several_partitions(spark):
    rnd = random.Random(5)
    rows = [(s, float(t) + rnd.random() / 2, rnd.random()) for s, n in ((1, 900), (2, 3), (3, 1), (4, 400)) for t in range(n)]
    want, last = {}, {}
    for s, t, x in sorted(rows):
        if s in last:
            t0, x0, e0 = last[s]
            r = math.exp(-(t - t0) * 0.1)
            e = (1 - r) * x0 + r * e0
        else:
            e = x
        want[s, t], last[s] = e, (t, x, e)
    df = spark.createDataFrame(rows, "series long, t double, x double").repartition(7)
    got = {(r.series, r.t): r.ema for r in timeseries.ema(df, 0.1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert timeseries.ema(df.where("t < 0"), 0.1).collect() == []
    times = spark.createDataFrame([(-1.0,), (0.5,), (450.2,), (9999.0,)], "at double")
    one = df.where("series = 1")
    held = {r.at: r.x for r in joins.as_of(one, times, "t", "x").collect()}
    mine = sorted((t, x) for s, t, x in rows if s == 1)
    assert held == {a: next((x for t, x in reversed(mine) if t <= a), None) for a in (-1.0, 0.5, 450.2, 9999.0)}


def test_user_functions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v")).repartition(5)
    got = {r.k: r.value for r in functional.fold(df, ["k"], lambda t: t.v, max, max, "double").collect()}
    assert got == {k: float(max(v for v in range(5000) if v % 7 == k)) for k in range(7)}
    rows = functional.flat(spark.range(4), lambda r: ((r["id"], i) for i in range(r["id"])), "id long, i int").collect()
    assert sorted(map(tuple, rows)) == [(a, b) for a in range(4) for b in range(a)]
    assert functional.flat(spark.range(0), lambda r: [(1,)], "a int").collect() == []
    with pytest.raises(ValueError):
        functional.download_small(spark.range(50), 49)
    with pytest.raises(ZeroDivisionError):
        functional.submit(lambda: 1 // 0).result()


def test_shapes(spark):
    f = Frame.of_columns(spark, {"a": [3, 1, 2], "b": [1.0, None, 2.0]})
    assert f.shape == (3, 2) and f[-1] == f[2] and f[0].a == 3 and f["a"].to_list() == [3, 1, 2]
    assert f[1:]["a"].to_list() == [1, 2] and f[::2]["a"].to_list() == [3, 2] and f[-2:-1]["a"].to_list() == [1]
    for bad in (3, -4):
        with pytest.raises(IndexError):
            f[bad]
    with pytest.raises(ValueError):
        f.add_column("a", F.lit(1))
    with pytest.raises(ValueError):
        Frame.of_columns(spark, {"a": [1], "b": []})
    s = Series.of(spark, [5.0, 2.0, 5.0])
    assert (s + s).to_list() == [10.0, 4.0, 10.0] and s.index(5.0) == 0 and s.unique().to_list() == [2.0, 5.0] and s.reverse().to_list() == [5.0, 2.0, 5.0] and 2.0 in s and len(s) == 3
    with pytest.raises(ValueError):
        s.index(7.0)
    ix = f.index("a")
    assert 3 in ix and 9 not in ix and ix.row_count_for_key(9) == 0 and ix[9].is_empty()


def test_functions_at_their_edges(spark):
    row = spark.createDataFrame([("a\tbb\tc", "Ab Cd", "ab Cd", "x--y--z", 'q"\\\n')], "t string, u string, v string, w string, e string")
    r = row.select(N.expandtabs(F.col("t"), 4).alias("t"), N.is_title(F.col("u")).alias("u"), N.is_title(F.col("v")).alias("v"), N.rsplit(F.col("w"), "--", 1).alias("w"), N.escaped(F.col("e")).alias("e")).first()
    assert r.t == "a   bb  c" and r.u and not r.v and list(r.w) == ["x--y", "z"] and r.e == 'q\\"\\\\\\n'
    t = spark.sql("select timestamp_ntz'2024-03-04 05:06:07' as t").select(D.strftime(F.col("t"), "%d of %B, 'at' %H").alias("s"), D.duration_from_string(F.lit("-01:02:03.5")).alias("n")).first()
    assert t.s == "04 of March, 'at' 05" and t.n == -3723500000
    assert M.SPECIAL["gamma_q"](2, 50) == pytest.approx(51 * math.exp(-50)) and M.SPECIAL["ibetac"](1, 30, 0.9) == pytest.approx(1e-30)
    assert M.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    k = spark.range(700).repartition(9).select("id", R.draw("gamma", F.col("id"), 2.0, seed=3).alias("x"))
    again = {r.id: r.x for r in spark.range(100, 130).select("id", R.draw("gamma", F.col("id"), 2.0, seed=3).alias("x")).collect()}
    assert {r.id: r.x for r in k.collect() if 100 <= r.id < 130} == again and len(set(again.values())) == 30


def test_sources(spark, tmp_path):
    assert csvio.byte_slices(100, 30) == [(0, 30), (30, 60), (60, 100)] and csvio.byte_slices(100, 200) == [(0, 100)] and csvio.byte_slices(0, 5) == [(0, 0)] and csvio.byte_slices(80, 30) == [(0, 30), (30, 60), (60, 80)]
    path = tmp_path / "x.bin"
    path.write_bytes(bytes(range(100)))
    got = sorted((r.low, bytes(r.content)) for r in csvio.read_slices(spark, str(path), 30).collect())
    assert b"".join(b for _, b in got) == bytes(range(100)) and len(got) == 3
    lines = spark.createDataFrame([("a,b",), ("1,x",), ("",), ("2,y,z",), ("3,",), (None,)], "line string").coalesce(1)
    got = csvio.read_csv(spark, lines, columns=["a", "b"], types={"a": "double"}).collect()
    assert [(r.a, r.b) for r in got] == [(1.0, "x"), (3.0, "")]
    with pytest.raises(ValueError):
        csvio.load(spark, csvio.Source("tape", "x"))
    with pytest.raises(AssertionError):
        checks.assert_frames_equal(lines, lines.limit(2))


#: Some of every family; the driver compares all of them.
SAMPLE = ["D18_strftime", "N67_rsplit", "N34_escaped", "M131_expm", "M59_combination", "F23_split", "Y81_transpose", "Y14_add_pair", "F30_is_date_time", "J9_outer_joiner", "J17_as_of_all", "A33_five_points", "A37_describe", "W9_ema", "O13_series_sort_values", "P46_series_prepend", "L137_anova", "L41_tree_exhaustive", "L54_neighbour_classes", "S34_tuple_stream", "X3_get_chunk", "V2_aggregate_function"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, duck, name):
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    r = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in r.description]
    want = sorted(str([plain(v) for v in row]) for row in r.fetchall())
    assert sorted(out.columns) == sorted(columns)
    assert sorted(str([plain(v) for v in row]) for row in out.select(*(f"`{c}`" for c in columns)).collect()) == want and want


def test_every_query_is_named_for_its_operator():
    assert all(pd.Series([n.split("_")[0]]).str.match(r"^([A-Z]\d+|flagship)$")[0] for n in catalog.QUERIES)
