"""Queries over frames, joins, groups, order, statistics and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.functions import stats
from stratalith.operators import frame, grouping, joins, order, timeseries
from stratalith.plans.catalog import query, table

PART = "SELECT p_partkey, p_size, p_retailprice FROM part"


def parts(s, d):
    return table(s, d, "part").select("p_partkey", "p_size", "p_retailprice")


@query("P12_rename", "SELECT p_partkey AS key, p_size AS size, p_retailprice FROM part")
def _(s, d):
    return frame.rename(parts(s, d), {"p_partkey": "key", 1: "size", "missing": "x"})


@query("P13_with_names", "SELECT p_partkey AS a, p_size AS b, p_retailprice AS c FROM part")
def _(s, d):
    return frame.with_names(parts(s, d), "a", "b", "c")


@query("P17_select_columns", "SELECT p_retailprice, p_partkey FROM part")
def _(s, d):
    return parts(s, d).select("p_retailprice", "p_partkey")


@query("P18_row_apply", "SELECT p_partkey, p_size * p_retailprice AS y FROM part")
def _(s, d):
    return parts(s, d).select("p_partkey", (F.col("p_size") * F.col("p_retailprice")).alias("y"))


@query("P19_row_apply_with_index", "SELECT p_partkey, p_size + row_number() OVER (ORDER BY p_partkey) - 1 AS y FROM part")
def _(s, d):
    return order.with_index(parts(s, d), "p_partkey").select("p_partkey", (F.col("p_size") + F.col("ix")).alias("y"))


@query("P20_column_apply", "SELECT sum(p_partkey)::BIGINT AS p_partkey, sum(p_size)::BIGINT AS p_size, round(sum(p_retailprice), 2) AS p_retailprice FROM part")
def _(s, d):
    df = parts(s, d)
    return df.agg(*(F.round(F.sum(c), 2).alias(c) if c == "p_retailprice" else F.sum(c).alias(c) for c in df.columns))


@query("P22_replace_column", "SELECT p_partkey, p_size * 2 AS p_size, p_retailprice FROM part")
def _(s, d):
    return frame.replace_column(parts(s, d), "p_size", lambda c: c * 2)


@query("P23_each", "SELECT p_partkey + 1 AS p_partkey, p_size + 1 AS p_size, p_retailprice + 1 AS p_retailprice FROM part")
def _(s, d):
    return frame.each(parts(s, d), lambda c: c + 1)


@query("P25_add_column", "SELECT p_partkey, p_size, p_retailprice, p_size % 7 AS z FROM part")
def _(s, d):
    return frame.add_columns(parts(s, d), z=F.col("p_size") % 7)


@query("P28_drop_columns", "SELECT p_retailprice FROM part")
def _(s, d):
    return frame.drop_columns(parts(s, d), "p_size", 0, "missing")


@query("P29_frame_plus_frame", "SELECT a.p_partkey, a.p_size + b.p_size AS p_size, a.p_retailprice, b.extra FROM part a JOIN (SELECT p_partkey, p_size, p_size * 10 AS extra FROM part) b USING (p_partkey)")
def _(s, d):
    a = parts(s, d)
    return frame.combine(a, a.select("p_partkey", "p_size", (F.col("p_size") * 10).alias("extra")), frame.plus, "p_partkey")


@query("P30_frame_times_scalar", "SELECT p_partkey * 3 AS p_partkey, p_size * 3 AS p_size, p_retailprice * 3 AS p_retailprice FROM part")
def _(s, d):
    return frame.each(parts(s, d), lambda c: c * 3)


@query("P34_row_sum", "SELECT p_partkey, p_partkey + p_size + p_retailprice AS y FROM part")
def _(s, d):
    df = parts(s, d)
    return df.select("p_partkey", frame.row_sum(df).alias("y"))


@query("P59_dot", "SELECT p_partkey, p_size * 2.0 + p_retailprice * 0.5 AS y FROM part")
def _(s, d):
    df = parts(s, d)
    return df.select("p_partkey", frame.dot(df, {"p_size": 2.0, "p_retailprice": 0.5}).alias("y"))


@query("P40_series_range", "SELECT i, i * i AS y FROM range(1000) t(i)")
def _(s, d):
    return s.range(1000).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("y"))


@query("F1_select", PART + " WHERE p_size > 25 AND p_retailprice < 1200")
def _(s, d):
    return parts(s, d).where("p_size > 25 and p_retailprice < 1200")


@query("F3_select_with_index", "SELECT p_partkey, p_size, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i % 3 = 1")
def _(s, d):
    return order.with_index(parts(s, d), "p_partkey").where("ix % 3 = 1").drop("ix")


@query("F5_drop_value", PART + " WHERE p_partkey <> 7 AND p_size <> 7 AND p_retailprice <> 7")
def _(s, d):
    return frame.drop_value(parts(s, d), 7)


@query("F6_slice", "SELECT p_partkey, p_size, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i >= 10 AND i < n - 5 AND (i - 10) % 4 = 0")
def _(s, d):
    return frame.slice_rows(parts(s, d), ["p_partkey"], 10, -5, 4)


@query("F7_head", PART + " ORDER BY p_retailprice, p_partkey LIMIT 5")
def _(s, d):
    return frame.head(parts(s, d), ["p_retailprice", "p_partkey"])


@query("F8_tail", PART + " ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5")
def _(s, d):
    return frame.tail(parts(s, d), ["p_retailprice", "p_partkey"])


@query("F15_index_lookup", PART + " WHERE p_size = 17")
def _(s, d):
    return frame.lookup(parts(s, d), "p_size", 17)


@query("F16_row_count_for_key", "SELECT count(*) AS n FROM part WHERE p_size = 17")
def _(s, d):
    return frame.lookup(parts(s, d), "p_size", 17).agg(F.count("*").alias("n"))


@query("F46_float_category", "SELECT c_custkey, isnan(ln(c_acctbal)) OR c_acctbal IS NULL AS bad FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 'nan'::DOUBLE END AS c_acctbal FROM customer)")
def _(s, d):
    x = F.when(F.col("c_acctbal") > 0, F.log("c_acctbal")).otherwise(F.lit(float("nan")))
    return table(s, d, "customer").select("c_custkey", F.isnan(x).alias("bad"))


@query("F48_min_max_operators", "SELECT p_partkey, least(p_size, p_partkey) AS lo, greatest(p_size, p_partkey) AS hi FROM part")
def _(s, d):
    return parts(s, d).select("p_partkey", F.least(F.col("p_size").cast("long"), "p_partkey").alias("lo"), F.greatest(F.col("p_size").cast("long"), "p_partkey").alias("hi"))


def sides(s, d):
    """Whole tables: customers and parts without a partner are unmatched by nature."""
    a = table(s, d, "customer").select("c_acctbal", "c_name", (F.col("c_custkey") * 3).alias("key"))
    b = table(s, d, "part").select("p_name", "p_size", F.col("p_partkey").alias("key"))
    return a, b


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    @query(f"J1_join_{_how}", f"SELECT c_acctbal AS c_acctbal_l, c_name AS c_name_l, p_name AS p_name_r, p_size AS p_size_r, key FROM (SELECT c_acctbal, c_name, c_custkey * 3 AS key FROM customer) {_sql} (SELECT p_name, p_size, p_partkey AS key FROM part) USING (key)")
    def _(s, d, how=_how):
        return joins.join(*sides(s, d), on="key", how=how, left_suffix="_l", right_suffix="_r")


@query("J1_join_orders_lineitem", "SELECT o_orderpriority, l_quantity, l_orderkey AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    o = table(s, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("key"))
    return joins.join(o, table(s, d, "lineitem").select("l_quantity", F.col("l_orderkey").alias("key")), on="key", how="inner")


@query("J11_take", "SELECT i.index, p_name FROM (SELECT o_custkey * 7 AS index FROM orders) i LEFT JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS ix FROM part) USING_ ON USING_.ix = i.index".replace("USING_", "t"))
def _(s, d):
    e = order.with_index(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey").drop("p_partkey")
    return joins.take(e, table(s, d, "orders").select((F.col("o_custkey") * 7).alias("index")))


@query("J14_bounds", "SELECT count(*) FILTER (p_retailprice < 1100) AS lower, count(*) FILTER (p_retailprice <= 1100) AS upper FROM part")
def _(s, d):
    return joins.bounds(parts(s, d), "p_retailprice", 1100)


@query("J17_as_of", "SELECT q.user_id, q.at, e.value FROM (SELECT DISTINCT user_id, TIMESTAMP '2024-01-10' + INTERVAL (k) DAY AS at FROM events, range(0, 30, 5) t(k)) q ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2) e ON q.user_id = e.user_id AND q.at >= e.ts")
def _(s, d):
    e = table(s, d, "events")
    ts = e.groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    at = F.explode(F.array(*(F.expr(f"timestamp_ntz'2024-01-10' + interval {k} days") for k in range(0, 30, 5))))
    return joins.as_of(ts, e.select("user_id").distinct().select("user_id", at.alias("at")), "ts", "value", ["user_id"])


@query("J17_as_of_all", "SELECT q.at, e.value FROM (SELECT DISTINCT o_orderdate AS at FROM orders) q ASOF LEFT JOIN (SELECT l_shipdate AS t, max(l_extendedprice) AS value FROM lineitem GROUP BY 1) e ON q.at >= e.t")
def _(s, d):
    ts = table(s, d, "lineitem").groupBy(F.col("l_shipdate").alias("t")).agg(F.max("l_extendedprice").alias("value"))
    return joins.as_of(ts, table(s, d, "orders").select(F.col("o_orderdate").alias("at")).distinct(), "t", "value")


@query("J18_nested_comprehension", "SELECT n_nationkey, i FROM nation, range(0, 5) t(i) WHERE i <= n_nationkey % 5")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_nationkey") % 5).cast("long"))).alias("i"))


LI = "FROM lineitem"


@query("A1_group_by", f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc {LI} GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("A3_group_keys", f"SELECT DISTINCT l_returnflag, l_linestatus {LI}")
def _(s, d):
    return grouping.group_keys(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("A4_get_group", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size = 3")
def _(s, d):
    return grouping.get_group(parts(s, d), {"p_size": 3})


@query("A8_reduce", f"SELECT l_suppkey % 10 AS \"group\", max(l_quantity * 2) AS value {LI} GROUP BY 1")
def _(s, d):
    return grouping.reduce_groups(table(s, d, "lineitem"), F.col("l_suppkey") % 10, lambda r: r["l_quantity"] * 2, F.max)


@query("A8_word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def _(s, d):
    return grouping.flat_map(table(s, d, "part"), lambda c: F.split(c, " "), "p_name", "word").groupBy("word").agg(F.count("*").alias("n"))


@query("A10_unique", "SELECT DISTINCT p_brand FROM part")
def _(s, d):
    return grouping.unique(table(s, d, "part"), "p_brand")


@query("A11_count_distinct", f"SELECT count(DISTINCT l_partkey) AS count_distinct {LI}")
def _(s, d):
    return grouping.count_distinct(table(s, d, "lineitem"), "l_partkey")


@query("A12_filter_consecutive", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def _(s, d):
    return grouping.filter_consecutive(table(s, d, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id", "user_id")


@query("A14_sum_min_max", f"SELECT sum(l_quantity) AS total, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, bool_and(l_quantity > 0) AS all_, bool_or(l_tax > 0.07) AS any_ {LI}")
def _(s, d):
    return table(s, d, "lineitem").agg(F.sum("l_quantity").alias("total"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.bool_and(F.col("l_quantity") > 0).alias("all_"), F.bool_or(F.col("l_tax") > 0.07).alias("any_"))


@query("A17_arg_max_min", "SELECT (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS hi, (SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) AS lo")
def _(s, d):
    p = parts(s, d).withColumn("m", -F.col("p_retailprice"))
    return p.agg(grouping.arg_max(p, "p_retailprice", "p_partkey").alias("a"), grouping.arg_max(p, "m", "p_partkey").alias("b")).select((-F.col("a.col2")).alias("hi"), (-F.col("b.col2")).alias("lo"))


@query("A21_mean_var_sd", f"SELECT round(avg(l_extendedprice), 4) AS mean, round(count(*) / sum(1 / l_extendedprice), 4) AS harmonic, round(var_samp(l_quantity), 6) AS var_, round(stddev_samp(l_quantity), 6) AS sd {LI}")
def _(s, d):
    return table(s, d, "lineitem").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(stats.harmonic_mean(F.col("l_extendedprice")), 4).alias("harmonic"), F.round(F.var_samp("l_quantity"), 6).alias("var_"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("A26_cov_cor", f"SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS cor {LI}")
def _(s, d):
    return table(s, d, "lineitem").agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("cor"))


@query("A28_spearman", "SELECT round(corr(a, b), 8) AS spearman FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)")
def _(s, d):
    return stats.spearman(parts(s, d), "p_size", "p_retailprice").select(F.round("spearman", 8).alias("spearman"))


@query("A31_quantiles", f"SELECT quantile_cont(l_extendedprice, 0.42) AS q42, median(l_extendedprice) AS med {LI}")
def _(s, d):
    q = stats.quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.42, 0.5])
    return q.agg(F.max(F.when(F.col("p") == 0.42, F.col("q"))).alias("q42"), F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("med"))


@query("A34_estimate_five_points")
def _(s, d):
    return stats.estimate_five(table(s, d, "lineitem"), "l_extendedprice")


@query("A36_summary", f"SELECT round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max {LI}")
def _(s, d):
    return stats.summary(table(s, d, "lineitem"), "l_quantity").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("A36_summary_of_strings", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return stats.summary(table(s, d, "part"), "p_brand")


@query("A38_histogram", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return stats.histogram(table(s, d, "part"), "p_size")


@query("A39_mode", "SELECT p_size AS mode, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, mode LIMIT 1")
def _(s, d):
    return stats.mode(table(s, d, "part"), "p_size")


@query("A40_additive_histogram", f"SELECT greatest(0, least(19, floor((l_extendedprice - 1000) / (49000 / 20.0))))::INTEGER AS b, count(*) AS n {LI} GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy(stats.additive_histogram(F.col("l_extendedprice"), 1000.0, 50000.0, 20).alias("b")).agg(F.count("*").alias("n"))


for _ties, _sql in (("average", "rank() OVER w + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0"), ("min", "rank() OVER w"), ("max", "rank() OVER w + count(*) OVER (PARTITION BY p_size) - 1")):

    @query(f"W1_rank_{_ties}", f"SELECT p_partkey, ({_sql})::DOUBLE AS rank FROM part WINDOW w AS (ORDER BY p_size)")
    def _(s, d, ties=_ties):
        return order.rank(parts(s, d), "p_size", ties).select("p_partkey", "rank")


@query("W1_rank_reverse", "SELECT p_partkey, (rank() OVER (ORDER BY p_size DESC))::DOUBLE AS rank FROM part")
def _(s, d):
    return order.rank(parts(s, d), "p_size", "min", reverse=True).select("p_partkey", "rank")


@query("W2_cumsum", "SELECT p_partkey, (sum(p_size) OVER (ORDER BY p_partkey))::BIGINT + 100 AS cumsum FROM part")
def _(s, d):
    return order.cumsum(parts(s, d), "p_size", "p_partkey", start=100).select("p_partkey", "cumsum")


@query("W4_zip_with_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS ix FROM part")
def _(s, d):
    return order.with_index(parts(s, d), "p_retailprice", "p_partkey").select("p_partkey", "ix")


@query("W13_reverse", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS ix FROM part")
def _(s, d):
    return order.with_index(parts(s, d), F.desc("p_partkey")).select("p_partkey", "ix")


def series(s, d):
    e = table(s, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timeseries.from_rows(e.groupBy("user_id", "sec").agg(F.max("value").alias("value")), "user_id", "sec", "value")


SER = "SELECT user_id AS series, epoch_us(ts) / 1e6 AS t, max(value) AS x FROM events GROUP BY 1, 2"


@query("W9_ema", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM ({SER})),
e AS (SELECT series, t, x, x AS ema, k FROM s WHERE k = 1 UNION ALL SELECT s.series, s.t, s.x, (1 - exp(-(s.t - e.t) * 0.00001)) * e.x + exp(-(s.t - e.t) * 0.00001) * e.ema, s.k FROM e JOIN s ON s.series = e.series AND s.k = e.k + 1)
SELECT series, t, round(ema, 6) AS ema FROM e""")
def _(s, d):
    return timeseries.ema(series(s, d), 0.00001).withColumn("ema", F.round("ema", 6))


@query("W10_lag", f"SELECT series, t + 60.0 AS t, x FROM ({SER})")
def _(s, d):
    return timeseries.lag(series(s, d), 60.0)


@query("J16_pairwise", f"""WITH s AS ({SER}), a AS (SELECT * FROM s WHERE x > 50), b AS (SELECT * FROM s WHERE x <= 50),
u AS (SELECT series, t, max(xa) AS xa, max(xb) AS xb FROM (SELECT series, t, x AS xa, NULL AS xb FROM a UNION ALL SELECT series, t, NULL, x FROM b) GROUP BY 1, 2)
SELECT * FROM (SELECT series, t, last_value(xa IGNORE NULLS) OVER w AS xa, last_value(xb IGNORE NULLS) OVER w AS xb FROM u WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE xa IS NOT NULL AND xb IS NOT NULL""")
def _(s, d):
    x = series(s, d)
    return timeseries.pairwise(x.where("x > 50"), x.where("x <= 50"))


@query("O1_sort", "SELECT p_partkey, p_size FROM part")
def _(s, d):
    return order.sort(parts(s, d).select("p_partkey", "p_size"), "p_size", "p_partkey")


@query("O6_is_sorted", "SELECT false AS is_sorted")
def _(s, d):
    return order.is_sorted(parts(s, d), "p_size", "p_partkey")


@query("O7_quick_select", "SELECT quantile_disc(p_retailprice, 0.5) AS p_retailprice FROM part")
def _(s, d):
    df = parts(s, d)
    return order.quick_select(df, "p_retailprice", (df.count() - 1) // 2)


@query("O8_n_smallest", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 20")
def _(s, d):
    return order.n_smallest(parts(s, d).select("p_partkey", "p_size"), 20, "p_size", "p_partkey")


@query("O9_n_largest", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 20")
def _(s, d):
    return order.n_largest(parts(s, d).select("p_partkey", "p_size"), 20, "p_size", "p_partkey")


@query("U1_append", "SELECT n_name AS name, n_regionkey, NULL::INTEGER AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def _(s, d):
    return frame.append(table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), table(s, d, "region").select(F.col("r_name").alias("name"), "r_regionkey"))


@query("U8_flatten", "SELECT vec_id, len(list_concat(embedding, embedding))::INTEGER AS n FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size(F.flatten(F.array("embedding", "embedding"))).alias("n"))
