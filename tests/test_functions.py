"""Literal fixtures for scalars, CSV, linear algebra, models and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.functions import arrays, dates, linalg, mathfn, random as R, text
from stratalith.operators import ml
from stratalith.sources import csvio
from stratalith.streaming import events


def test_text(spark):
    df = spark.createDataFrame([("Hello World",)], "s string")
    s = F.col("s")
    cases = [
        (text.find(s, "o"), 4), (text.rfind(s, "o"), 7), (text.find(s, "z"), -1), (text.slice_(s, -5, None), "World"), (text.slice_(s, 0, 10, 3), "HlWl"), (text.char_at(s, 0), "H"), (text.capitalize(s), "Hello world"),
        (text.swapcase(s), "hELLO wORLD"), (text.count(s, "l"), 3), (text.matches(s, "Hello"), False), (text.matches(s, "H.*d"), True), (text.center(s, 15, "*"), "Hello World".center(15, "*")), (text.center(s, 14, "*"), "Hello World".center(14, "*")), (text.zfill(F.lit("-42"), 6), "-00042"),
    ]
    got = df.select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(got) == [x for _, x in cases]
    r = df.select(text.partition(s, " "), text.rpartition(s, "o"), text.split(s, "l", 1), text.splitlines(F.lit("a\r\nb\n")), text.data_as_vector(F.lit("AB")), text.extract(s, "(z)(y)", 2)).first()
    assert list(r) == [["Hello", " ", "World"], ["Hello W", "o", "rld"], ["He", "lo World"], ["a", "b"], [65, 66], None]
    with pytest.raises(Exception, match="substring not found"):
        df.select(text.index(s, "zz")).collect()


def test_dates(spark):
    one = spark.range(1)
    t = dates.strptime(F.lit("2015-03-04 05:06:07"), "%Y-%m-%d %H:%M:%S")
    r = one.select(dates.day_of_week(t), dates.strftime(t, "%d.%m.%y"), dates.iso(t), dates.total(dates.of(F.lit(90), "minutes"), "hours"), dates.field(dates.of(F.lit(90), "minutes"), "minutes"), dates.time_of_day(t)).first()
    assert list(r) == ["Wednesday", "04.03.15", "20150304T050607", 1, 30, (5 * 3600 + 6 * 60 + 7) * 10**6]
    with pytest.raises(ValueError):
        dates.pattern("%U")


def test_special_functions(spark):
    v = {k: f for k, f in mathfn.SPECIAL.items()}
    assert v["erfinv"](math.erf(0.7)) == pytest.approx(0.7) and v["erfcinv"](math.erfc(1.3)) == pytest.approx(1.3)
    assert v["gamma_p"](1, 2) == pytest.approx(1 - math.exp(-2)) and v["gamma_p_inv"](2.5, v["gamma_p"](2.5, 3)) == pytest.approx(3)
    assert v["ibeta"](2, 3, 0.4) == pytest.approx(0.5248) and v["ibeta_inv"](2, 3, 0.5248) == pytest.approx(0.4)
    assert v["digamma"](1) == pytest.approx(-0.5772156649015329) and v["beta"](2, 3) == pytest.approx(1 / 12)
    assert v["bessel_i"](0, 1.0) == pytest.approx(1.2660658777520084) and v["bessel_k"](0, 1.0) == pytest.approx(0.42102443824070834)
    assert v["hyp2f1"](1, 1, 2, 0.5) == pytest.approx(2 * math.log(2)) and v["ibeta_inva"](3, 0.4, v["ibeta"](2, 3, 0.4)) == pytest.approx(2)
    got = spark.createDataFrame([(0.5,), (None,), (-1.0,)], "x double").select(mathfn.special("lgamma", F.col("x"))).collect()
    assert got[0][0] == pytest.approx(math.lgamma(0.5)) and got[1][0] is None
    assert mathfn.quad(math.sin, 0, math.pi) == pytest.approx(2) and mathfn.trapz([0, 1, 2], [0, 1, 2]) == 2


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 1],)], "a array<int>")
    a = F.col("a")
    small = lambda x: x < 3
    r = df.select(arrays.get(a, -1), arrays.slice_(a, 1, -1, 2), arrays.index(a, 3), arrays.take_while(a, small), arrays.drop_while(a, small), arrays.l1(a), arrays.l_infinity(a), arrays.cycle(a, 7)).first()
    assert list(r) == [1, [2, 4], 2, [1, 2], [3, 4, 1], 11.0, 4.0, [1, 2, 3, 4, 1, 1, 2]]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,2,3\n4,5,6,7\n\n8,"9",NA\n')
    df = csvio.read_csv(spark, str(tmp_path / "x.csv"), default="double")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == (1.0, 2.0, 3.0) and got[1][:2] == (8.0, 9.0) and math.isnan(got[1][2]) and len(got) == 2
    (tmp_path / "bad.csv").write_text("a\n1\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csvio.read_csv(spark, str(tmp_path / "bad.csv"), default="double").collect()
    (tmp_path / "q.csv").write_text('k|t\nx|"a|b"\ny|\n')
    assert [tuple(r) for r in csvio.read_csv(spark, str(tmp_path / "q.csv"), sep="|").collect()] == [("x", "a|b"), ("y", "")]
    assert csvio.headers("") is None and csvio.headers(' "p" ,q') == ["p", "q"]
    parts = list(csvio.csv_chunks(spark.range(5), ["id"], rows=3))
    assert "".join(parts) == "id\n0\n1\n2\n3\n4\n" and len(parts) == 2
    csvio.write_csv(spark.range(5), str(tmp_path / "out"))
    assert csvio.read_csv(spark, str(tmp_path / "out"), columns=["id"]).count() == 5


def test_linear_algebra():
    m = linalg.Matrix([[4, 1, 0], [1, 3, 1], [0, 1, 2]])
    p, l, u = m.lu()
    assert np.allclose((p * l * u).a, m.a) and np.allclose((m * m.inverse()).a, np.eye(3)) and np.allclose((m.cholesky() * m.cholesky().T).a, m.a)
    assert np.allclose(m.pseudoinverse().a, m.inverse().a) and m.trace() == 9 and m.rank() == 3 and m.column_major()[:2] == [4, 1]
    assert np.allclose(linalg.Matrix([[0, 1], [-1, 0]]).expm().a, [[math.cos(1), math.sin(1)], [-math.sin(1), math.cos(1)]])
    assert np.allclose(m.solve([1, 2, 3]), np.linalg.solve(m.a, [1, 2, 3])) and linalg.Tensor(range(8), (2, 2, 2)).rank == 3
    x, f = linalg.minimize(lambda v: (v[0] - 3) ** 2 + (v[1] + 1) ** 2 + v[0] * v[1] * 0.1, [0, 0], [(0, 2), (-5, 5)])
    assert x[0] == pytest.approx(2) and x[1] == pytest.approx(-1.1, abs=1e-4)


def test_models(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + rnd.normal(size=400) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c), int(a > 0)) for (a, b), c in zip(x, y)], "a double, b double, y double, z int")
    m = ml.LinearRegression(df, ["a", "b"], "y")
    want, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(400)]), y, rcond=None)
    assert np.allclose(m.coefficients, want) and m.r_squared() > 0.99 and m.f_stat() > 1000 and abs(m.t_stats()[0]) > 100
    b = ml.logistic_regression(df.withColumn("w", (F.col("a") + F.col("b") > 0).cast("double")), ["a", "b"], "w", 0.1)
    assert b[0] > 3 and b[1] > 3 and abs(b[2]) < 1
    t = ml.RegressionTree(df, ["a", "b"], "z", 1)
    assert df.where((t.predict() > 0.5).cast("int") != F.col("z")).count() < 12 and t.importances()["a"] > 0.9
    for loss in ("l2", "absolute", "binomial"):
        g = ml.GradientBoosting(df, ["a", "b"], "z", loss, 3, 2)
        assert df.where((g.predict() > 0.5).cast("int") != F.col("z")).count() < 40, loss
    pts = spark.createDataFrame([(i, [float(i % 2 * 10), float(i)]) for i in range(4)], "id long, v array<double>")
    centers, _, inertia = ml.kmeans(pts, "v", 2, seed=1)
    assert sorted(map(tuple, centers.tolist())) == [(0.0, 1.0), (10.0, 2.0)] and inertia == pytest.approx(4.0)
    n = ml.nearest(pts, pts.where("id = 0"), 2, "v", "id").orderBy("place").collect()
    assert [(r.neighbour, r.distance) for r in n] == [(0, 0.0), (2, 2.0)]
    enc = ml.target_encode(spark.createDataFrame([("x", 1), ("x", 0), ("z", 0)], "c string, y int"), "c", F.col("y") == 1, "m")
    assert {(r.c, r.m) for r in enc.collect()} == {("x", 0.5), ("z", 0.0)}


def test_random_moments(spark):
    k = F.col("id")
    cols = {"uniform": (R.uniform(k), 0.5), "normal": (R.normal(k, 2.0, 3.0), 2.0), "exp": (R.exponential(k, 2.0), 0.5), "weibull": (R.weibull(k, 1.0, 2.0), 2.0), "binomial": (R.binomial(k, 10, 0.3), 3.0), "chi": (R.chi_squared(k, 3), 3.0), "poisson": (R.draw("poisson", k, 4.0), 4.0), "tri": (R.triangular(k, 0.0, 1.0, 2.0), 1.0)}
    r = spark.range(4000).agg(*(F.avg(c).alias(n) for n, (c, _) in cols.items())).first()
    for n, (_, mean) in cols.items():
        assert r[n] == pytest.approx(mean, rel=0.1), n


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), batch.schema, files=10)
    got = events.drain(events.windowed(stream, "ts", "value", "1 day", late="0 seconds"), "drained", str(tmp_path / "cp"))
    want = {r.start: (r.n, round(r.total, 6)) for r in events.windowed(batch, "ts", "value", "1 day").collect()}
    seen = {r.start: (r.n, round(r.total, 6)) for r in got.collect()}
    assert seen and all(want[k] == v for k, v in seen.items()) and len(want) - len(seen) <= 1
