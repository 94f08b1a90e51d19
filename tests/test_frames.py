"""Literal fixtures for frames, joins, groups, order and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from stratalith.functions import stats
from stratalith.operators import frame, grouping, joins, order, timeseries


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def sides(spark):
    l = spark.createDataFrame([("foo", 1), ("foo", 2), ("bar", 3)], "key string, lval int")
    return l, spark.createDataFrame([("foo", 4), ("baz", 5), ("foo", 6)], "key string, rval int")


def test_join_contract(sides):
    left = joins.join(*sides, on="key")
    assert left.columns == ["lval", "rval", "key"]
    four = [(1, 4, "foo"), (1, 6, "foo"), (2, 4, "foo"), (2, 6, "foo")]
    assert sorted(rows(left), key=str) == sorted([(3, None, "bar"), *four], key=str) and rows(left)[0][2] == "bar"
    assert sorted(rows(joins.join(*sides, on="key", how="right")), key=str) == sorted([(None, 5, "baz"), *four], key=str)
    assert sorted(rows(joins.join(*sides, on="key", how="inner"))) == four
    assert len(rows(joins.join(*sides, on="key", how="outer"))) == 6
    assert joins.join(*sides, on="key", left_suffix="_l").columns == ["lval_l", "rval", "key"]
    with pytest.raises(ValueError):
        joins.join(sides[0], sides[0], on="key")


def test_append_and_names(spark):
    a, b = spark.createDataFrame([(1, 2)], "A int, B int"), spark.createDataFrame([(3, 4)], "A int, C int")
    assert rows(frame.append(a, b)) == [(1, 2, None), (3, None, 4)]
    assert frame.rename(a, {"A": "x", "no": "y"}).columns == ["x", "B"]
    assert frame.drop_columns(a, "B", "no").columns == ["A"]
    with pytest.raises(ValueError):
        frame.add_columns(a, A=F.lit(1))
    with pytest.raises(KeyError):
        frame.column_index(a, "no")
    assert frame.equals(a, a) and not frame.equals(a, b)


def test_positions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "a int, b int")
    assert [r.a for r in frame.slice_rows(df, ["a"], -5, None, 2).collect()] == [15, 17, 19]
    assert [r.a for r in frame.tail(df, ["a"], 2).collect()] == [18, 19] and frame.iloc(df, ["a"], -1).a == 19
    with pytest.raises(IndexError):
        frame.iloc(df, ["a"], 20)
    assert frame.lookup(df, "b", 9).count() == 0 and grouping.get_group(df, {"b": 0}).count() == 7
    with pytest.raises(KeyError):
        grouping.get_group(df, {"b": 9})
    assert frame.drop_value(spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double"), math.nan).count() == 2


SEQ = [4, 78, 1, 0, 5, 3, 7, 10, 2, 3, 18, 12]


def test_statistics(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(SEQ)], "i int, v int")
    r = df.agg(F.avg("v"), F.var_samp("v"), stats.quantile("v", 0.5), stats.quantile("v", 0.42)).first()
    assert [round(x, 4) for x in r] == [11.9167, 460.0833, 4.5, 3.62]
    assert [x.rank for x in order.rank(df, "v").orderBy("i").collect()] == [6, 12, 2, 1, 7, 4.5, 8, 9, 3, 4.5, 11, 10]
    s = stats.summary(df, "v").first()
    assert (s["min"], s.q1, s.median, s.q3, s["max"]) == (0, 2.75, 4.5, 10.5, 78)
    assert [x.cumsum for x in order.cumsum(df, "v", "i").orderBy("i").collect()][-1] == sum(SEQ)
    assert stats.kendall([1, 2, 3, 4], [1, 3, 2, 4]) == pytest.approx(4 / 6)
    with pytest.raises(ValueError):
        stats.quantile("v", 1.5)
    assert rows(stats.mode(df, "v")) == [(3, 2)] and rows(order.quick_select(df, "v", 3)) == [(3,)]
    e = stats.estimate_five(df, "v", 1000).first()
    assert abs(e.median - 4.5) <= 1 and (e["min"], e["max"]) == (0, 78)


def test_series(spark):
    t = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("a", 5, 2.0), ("b", 1, 7.0)], "s string, t int, x double")
    ts = timeseries.from_rows(t, "s", "t", "x")
    got = {(r.series, r.t): r.ema for r in timeseries.ema(ts, 0.5).collect()}
    e2 = (1 - math.exp(-1)) * 1.0 + math.exp(-1) * 1.0
    e5 = (1 - math.exp(-1.5)) * 3.0 + math.exp(-1.5) * e2
    assert got == pytest.approx({("a", 0.0): 1.0, ("a", 2.0): e2, ("a", 5.0): e5, ("b", 1.0): 7.0})
    with pytest.raises(ValueError):
        timeseries.from_rows(t.unionByName(t), "s", "t", "x")
    both = timeseries.pairwise(ts, ts.withColumn("t", F.col("t") + 1).withColumn("x", F.col("x") * 10))
    assert sorted(rows(both))[0] == ("a", 1.0, 1.0, 10.0)
