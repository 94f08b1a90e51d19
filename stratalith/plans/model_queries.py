"""Queries over models, CSV, streams and random columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.functions import random as R
from stratalith.operators import ml
from stratalith.plans.catalog import query, table
from stratalith.sources import csvio
from stratalith.streaming import events as E


@query("L28_linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def _(s, d):
    m = ml.LinearRegression(table(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return s.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.coefficients[1]), 4), round(m.r_squared(), 8))], "slope double, intercept double, r2 double")


@query("L30_predict", "SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 3) AS predicted FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def _(s, d):
    li = table(s, d, "lineitem")
    m = ml.LinearRegression(li, ["l_quantity"], "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", F.round(m.predict(), 3).alias("predicted"))


@query("L35_logistic_regression")
def _(s, d):
    df = table(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") > 30000).cast("double").alias("y"))
    return s.createDataFrame([(k, float(v)) for k, v in zip(("q", "d", "intercept"), ml.logistic_regression(df, ["q", "d"], "y"))], "name string, value double")


@query("L42_regression_tree")
def _(s, d):
    p = table(s, d, "part")
    t = ml.RegressionTree(p, ["p_partkey", "p_size"], "p_retailprice", 3)
    return p.select("p_partkey", t.predict().alias("predicted"))


@query("L45_gradient_boosting")
def _(s, d):
    """Five boosts: the operator's default is a hundred, each of them some jobs."""
    p = table(s, d, "part")
    return p.select("p_partkey", ml.GradientBoosting(p, ["p_partkey", "p_size"], "p_retailprice", boosts=5).predict().alias("predicted"))


@query("L48_target_encoding", "SELECT p_partkey, round(avg(CASE WHEN p_retailprice > 1300 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY p_brand), 8) AS rate FROM part")
def _(s, d):
    return ml.target_encode(table(s, d, "part"), "p_brand", F.col("p_retailprice") > 1300, "rate").select("p_partkey", F.round("rate", 8).alias("rate"))


@query("L52_kmeans")
def _(s, d):
    return ml.kmeans(table(s, d, "embeddings"), "embedding", 4)[1].groupBy("cluster").agg(F.count("*").alias("n"))


@query("L53_nearest", """SELECT q.vec_id AS "query", p.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.a, p.a), 9), p.vec_id) AS place
FROM (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS a FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS a FROM embeddings) p QUALIFY place <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    return ml.nearest(e, e.where("vec_id % 20 = 0"), 5, "embedding", "vec_id").select("query", "neighbour", F.col("place").cast("long").alias("place"))


@query("S32_csv_lines", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def _(s, d):
    return csvio.csv_lines(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("S15_csv_round_trip", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def _(s, d):
    lines = csvio.csv_lines(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    text = s.createDataFrame([("n_nationkey,n_name,n_regionkey",)], "line string").unionByName(lines)
    return csvio.read_csv(s, text.select("line"), columns=["n_nationkey", "n_name", "n_regionkey"], types={"n_nationkey": "double", "n_regionkey": "double"}, has_headers=True)


@query("T1_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
def _(s, d):
    return E.windowed(table(s, d, "events"), "ts", "value", "1 hour", by="event_type").withColumn("total", F.round("total", 6))


@query("T3_sessions", """WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def _(s, d):
    return E.sessions(table(s, d, "events"), "ts", "user_id", "1 hour")


@query("R1_random")
def _(s, d):
    k = F.col("id")
    return s.range(2000).select("id", R.uniform(k).alias("uniform"), R.normal(k).alias("normal"), R.exponential(k).alias("exponential"), R.weibull(k, 2.0).alias("weibull"), R.triangular(k, 0, 1, 3).alias("triangular"), R.draw("beta", k, 2.0, 3.0).alias("beta"))
