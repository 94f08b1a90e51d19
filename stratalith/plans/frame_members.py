"""One query for each member of the frame, filter, join, aggregation, order and set families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratalith.functions import stats
from stratalith.operators import frame, functional, grouping, joins, order, timeseries
from stratalith.operators.shapes import Frame, Index, Series
from stratalith.plans.catalog import listed, listed_sql, query, table
from stratalith.plans.frame_queries import SER, parts, series

#: nation and part, as ordered frames
NATION = "SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation"
SIZES = "SELECT p_size AS x, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part"
POS = "SELECT p_partkey, p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part"


def nation(s, d) -> Frame:
    return Frame.ordered(table(s, d, "nation"), "n_nationkey")


def part(s, d) -> Frame:
    return Frame.ordered(parts(s, d), "p_partkey")


def sizes(s, d) -> Series:
    return part(s, d)["p_size"]


def one(s, **values):
    """One row of driver values."""
    return s.createDataFrame([tuple(values.values())], list(values))


def rows(x):
    """A series as i, y."""
    return x.df.select(F.col("_ix").alias("i"), F.col("x").alias("y"))


def plain(f: Frame):
    return f.df.select(*f.columns)


def add(name: str, sql: str, f) -> None:
    query(name, sql)(f)


COLS = {"a": [1, 2, 3], "b": [1.5, 2.5, -3.5]}
ABC = "SELECT * FROM (VALUES (1, 1.5::DOUBLE), (2, 2.5), (3, -3.5)) t({})"
M32 = np.array([[1.0, 1.5], [2.0, 2.5], [3.0, -3.5]])
# ------------------------------------------------------------------------------ frames
add("P1_columns_ctor", ABC.format("a, b"), lambda s, d: plain(Frame.of_columns(s, COLS)))
add("P2_vectors_ctor", ABC.format("a, b"), lambda s, d: plain(Frame.of_rows(s, [[1, 1.5], [2, 2.5], [3, -3.5]], ["a", "b"])))
add("P3_tuples_ctor", ABC.format("a, b"), lambda s, d: plain(Frame.of_rows(s, [(1, 1.5), (2, 2.5), (3, -3.5)], ["a", "b"])))
add("P4_matrix_ctor", ABC.format("a, b").replace("(1,", "(1.0::DOUBLE,"), lambda s, d: plain(Frame.of_matrix(s, M32, ["a", "b"])))
add("P5_named_columns_ctor", ABC.format("b, c"), lambda s, d: plain(Frame.of_columns(s, dict(b=[1, 2, 3], c=[1.5, 2.5, -3.5]))))
add("P6_empty_ctor", "SELECT 0 AS n, 0 AS m", lambda s, d: one(s, n=len(Frame.of_columns(s, {})), m=len(Frame.of_columns(s, {}).columns)))
add("P7_columns_rows", "SELECT count(*) AS n, 3 AS m, 'p_partkey,p_size,p_retailprice' AS names FROM part", lambda s, d: (lambda f: one(s, n=len(f), m=len(f.columns), names=",".join(f.columns)))(part(s, d)))
add("P8_size", "SELECT count(*) AS n FROM part", lambda s, d: parts(s, d).agg(F.count("*").alias("n")))
add("P9_equals", "SELECT true AS same, false AS other", lambda s, d: one(s, same=frame.equals(parts(s, d), parts(s, d)), other=frame.equals(parts(s, d), parts(s, d).where("p_size > 3"))))
add("P10_grid", "SELECT 'n_regionkey n_name' AS head, 21 AS lines", lambda s, d: (lambda t: one(s, head=" ".join(t[0].split()), lines=len(t)))(str(nation(s, d)[["n_regionkey", "n_name"]]).split("\n")))
add("P11_column_index", "SELECT 1 AS at", lambda s, d: one(s, at=frame.column_index(parts(s, d), "p_size")))
add("P14_rename_columns", "SELECT p_partkey AS a, p_size AS b, p_retailprice FROM part", lambda s, d: frame.rename(parts(s, d), {"p_partkey": "a", "p_size": "b"}))
add("P15_get_column", f"SELECT i, x AS y FROM ({SIZES})", lambda s, d: rows(part(s, d).column(1)))
add("P16_brackets", f"SELECT p_size, p_partkey FROM ({POS}) WHERE i >= 5 AND i < 50 AND (i - 5) % 7 = 0", lambda s, d: plain(part(s, d)[5:50:7][["p_size", "p_partkey"]]))
add("P21_apply_to_column", "SELECT p_partkey, p_size + 1 AS p_size, p_retailprice FROM part", lambda s, d: frame.replace_column(parts(s, d), "p_size", lambda c: c + 1))
add("P24_each", "SELECT p_partkey, p_size * 2 AS p_size, p_retailprice * 2 AS p_retailprice FROM part", lambda s, d: frame.each(parts(s, d), lambda c: c * 2, "p_size", "p_retailprice"))
add("P26_add_columns", "SELECT p_partkey, p_size, p_retailprice, p_size % 3 AS u, p_size % 4 AS v FROM part", lambda s, d: frame.add_columns(parts(s, d), u=F.col("p_size") % 3, v=F.col("p_size") % 4))
add("P27_drop_column", "SELECT p_partkey, p_retailprice FROM part", lambda s, d: frame.drop_columns(parts(s, d), 1))
add("P31_as_matrix", "SELECT sum(n_nationkey)::DOUBLE AS a, sum(n_regionkey)::DOUBLE AS b FROM nation", lambda s, d: (lambda m: one(s, a=float(m[:, 0].sum()), b=float(m[:, 1].sum())))(nation(s, d)[["n_nationkey", "n_regionkey"]].as_matrix()))
add("P32_is_empty", "SELECT false AS full_, true AS none", lambda s, d: one(s, full_=part(s, d).is_empty(), none=Frame.of_columns(s, {}).is_empty()))
add("P33_row", f"SELECT p_partkey, p_size, p_retailprice FROM ({POS}) WHERE i = 7", lambda s, d: s.createDataFrame([part(s, d)[7]], parts(s, d).schema))
add("P35_row_apply", f"SELECT n_nationkey, {listed_sql('[n_nationkey * 2, n_regionkey * 2]', 'list')} AS y FROM nation", lambda s, d: table(s, d, "nation").select("n_nationkey", listed(F.transform(F.array("n_nationkey", "n_regionkey"), lambda v: v * 2), "list").alias("y")))
add("P36_row_major", f"SELECT i, {listed_sql('[n_nationkey, n_regionkey]', 'list')} AS y FROM ({NATION})", lambda s, d: nation(s, d)[["n_nationkey", "n_regionkey"]].row_major().select(F.col("_ix").alias("i"), listed(F.col("x"), "list").alias("y")))
add("P37_row_major_minus", f"SELECT i, {listed_sql('[n_nationkey - n_regionkey, n_regionkey - n_nationkey]', 'list')} AS y FROM ({NATION})", lambda s, d: (lambda f: f[["n_nationkey", "n_regionkey"]].row_difference(Frame(f[["n_regionkey", "n_nationkey"]].df.toDF("_ix", "n_nationkey", "n_regionkey"))).select(F.col("_ix").alias("i"), listed(F.col("x"), "list").alias("y")))(nation(s, d)))
add("P38_series_ctor", "SELECT * FROM (VALUES (0, 4.5::DOUBLE), (1, 2.5)) t(i, y)", lambda s, d: rows(Series.of(s, [4.5, 2.5])))
add("P39_series_uniform", "SELECT range AS i, 7 AS y FROM range(12)", lambda s, d: rows(Series.uniform(s, 7, 12)))
add("P41_series_equals", "SELECT true AS same, false AS other", lambda s, d: (lambda x: one(s, same=x.equals(x), other=x.equals(x.apply(lambda v: v + 1))))(sizes(s, d)))
add("P42_series_apply", f"SELECT i, x * x AS y FROM ({SIZES})", lambda s, d: rows(sizes(s, d).apply(lambda v: v * v)))
add("P43_series_apply_with_index", f"SELECT i, x + i AS y FROM ({SIZES})", lambda s, d: rows(sizes(s, d).apply_with_index(lambda v, i: v + i)))
add("P44_series_as_matrix", "SELECT count(*) AS n, 1 AS m, sum(p_size)::DOUBLE AS total FROM part", lambda s, d: (lambda m: one(s, n=m.shape[0], m=m.shape[1], total=float(m.sum())))(sizes(s, d).as_matrix()))
add("P45_series_append", "SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 9.0)) t(i, y)", lambda s, d: rows(Series.of(s, [1.0, 2.0]).append(Series.of(s, [9.0]))))
add("P46_series_prepend", "SELECT * FROM (VALUES (0, 9.0::DOUBLE), (1, 1.0), (2, 2.0)) t(i, y)", lambda s, d: rows(Series.of(s, [1.0, 2.0]).prepend(Series.of(s, [9.0]))))
add("P47_series_reverse", "SELECT count(*) OVER () - 1 - i AS i, x AS y FROM (" + SIZES + ")", lambda s, d: rows(sizes(s, d).reverse()))
add("P48_series_sum", "SELECT sum(p_size)::BIGINT AS total FROM part", lambda s, d: one(s, total=sizes(s, d).sum()))
add("P49_series_in", "SELECT (SELECT count(*) > 0 FROM part WHERE p_size = 7) AS a, (SELECT count(*) > 0 FROM part WHERE p_size = 7000) AS b", lambda s, d: (lambda x: one(s, a=7 in x, b=7000 in x))(sizes(s, d)))
add("P50_series_index", f"SELECT min(i) AS at FROM ({SIZES}) WHERE x = 7", lambda s, d: one(s, at=sizes(s, d).index(7)))
add("P51_pandas_ctor", ABC.format("a, b"), lambda s, d: plain(Frame.of_columns(s, {"a": [1, 2, 3], "b": [1.5, 2.5, -3.5]})))
add("P52_pandas_from_items", ABC.format("z, a"), lambda s, d: plain(Frame.of_items(s, [("z", [1, 2, 3]), ("a", [1.5, 2.5, -3.5])])))
add("P53_pandas_shape", "SELECT count(*) AS n, 3 AS m FROM part", lambda s, d: (lambda x: one(s, n=x[0], m=x[1]))(part(s, d).shape))
add("P54_pandas_iloc", f"SELECT p_partkey, p_size, p_retailprice FROM ({POS}) WHERE i = n - 1", lambda s, d: s.createDataFrame([part(s, d).iloc(-1)], parts(s, d).schema))
add("P55_pandas_column", f"SELECT i, x AS y FROM ({SIZES})", lambda s, d: rows(part(s, d)["p_size"]))
add("P56_pandas_add_column", f"SELECT n_nationkey, n_name, n_regionkey, n_nationkey + i AS z FROM ({NATION})", lambda s, d: (lambda f: plain(f.add_column("z", f["n_nationkey"].apply_with_index(lambda v, i: v + i))))(nation(s, d)))
add("P57_pandas_apply_rows", f"SELECT i, p_size + p_partkey AS y FROM ({POS})", lambda s, d: rows(part(s, d).row_apply(lambda r: r["p_size"] + r["p_partkey"])))
add("P58_pandas_as_matrix", "SELECT count(*) AS n, 2 AS m FROM nation", lambda s, d: (lambda m: one(s, n=m.shape[0], m=m.shape[1]))(nation(s, d)[["n_nationkey", "n_regionkey"]].as_matrix()))
add("P60_pandas_series", "SELECT * FROM (VALUES (0, 5.0::DOUBLE), (1, 2.0)) t(i, y)", lambda s, d: rows(Series.of(s, [5.0, 2.0])))
add("P61_pandas_series_apply", f"SELECT i, -x AS y FROM ({SIZES})", lambda s, d: rows(sizes(s, d).apply(lambda v: -v)))
add("P62_pandas_series_dot", "SELECT sum(p_size * p_partkey)::BIGINT AS y FROM part", lambda s, d: (lambda f: one(s, y=f["p_size"].dot(f["p_partkey"])))(part(s, d)))
add("P63_pandas_series_add", f"SELECT i, p_size + p_partkey AS y FROM ({POS})", lambda s, d: (lambda f: rows(f["p_size"] + f["p_partkey"]))(part(s, d)))
add("P64_series_tolist", f"SELECT i, n_regionkey AS y FROM ({NATION})", lambda s, d: s.createDataFrame(list(enumerate(nation(s, d)["n_regionkey"].to_list())), "i long, y int"))

# ------------------------------------------------------------------------------ filters
add("F2_filter", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20", lambda s, d: parts(s, d).filter(F.col("p_size").between(10, 20)))
add("F4_filter_with_index", f"SELECT p_partkey, p_size, p_retailprice FROM ({POS}) WHERE i % 2 = p_size % 2", lambda s, d: plain(Frame(part(s, d).df.where(F.col("_ix") % 2 == F.col("p_size") % 2))))
for _id, _name, _at in (("F9", "iloc", 3), ("F10", "at", 11), ("F11", "loc", -4), ("F12", "get", 0), ("F13", "get_row", 17)):
    add(f"{_id}_{_name}", f"SELECT p_partkey, p_size, p_retailprice FROM ({POS}) WHERE i = {_at if _at >= 0 else f'n - {-_at}'}", lambda s, d, i=_at: s.createDataFrame([part(s, d).get(i)], parts(s, d).schema))
add("F14_index", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size % 10 = 4", lambda s, d: plain(part(s, d).index(lambda df: df.p_size % 10)[4]))
add("F17_key_in_index", "SELECT (SELECT count(*) > 0 FROM part WHERE p_size = 17) AS a, false AS b", lambda s, d: (lambda ix: one(s, a=17 in ix, b=-1 in ix))(Index(part(s, d), "p_size")))
add("F47_comparisons", "SELECT p_partkey, p_size = 5 AS a, p_size <> 5 AS b, p_size < 5 AS c, p_size > 5 AS e, p_size <= 5 AS f, p_size >= 5 AS g FROM part", lambda s, d: (lambda c: parts(s, d).select("p_partkey", (c == 5).alias("a"), (c != 5).alias("b"), (c < 5).alias("c"), (c > 5).alias("e"), (c <= 5).alias("f"), (c >= 5).alias("g")))(F.col("p_size")))

# ------------------------------------------------------------------------------ joins
JOIN = "SELECT c_name AS c_name_l, o_totalprice AS o_totalprice_r, key FROM (SELECT c_name, c_custkey * 2 AS key FROM customer) {} (SELECT o_totalprice, o_custkey AS key FROM orders) USING (key)"


def customer_orders(s, d):
    return table(s, d, "customer").select("c_name", (F.col("c_custkey") * 2).alias("key")), table(s, d, "orders").select("o_totalprice", F.col("o_custkey").alias("key"))


for _id, _name, _how, _sql in (("J2", "join_base", "inner", "JOIN"), ("J6", "inner_joiner", "inner", "JOIN"), ("J7", "left_joiner", "left", "LEFT JOIN"), ("J8", "right_joiner", "right", "RIGHT JOIN"), ("J9", "outer_joiner", "outer", "FULL JOIN")):
    add(f"{_id}_{_name}", JOIN.format(_sql), lambda s, d, how=_how: joins.join(*customer_orders(s, d), on="key", how=how, left_suffix="_l", right_suffix="_r", ordered=False))
add("J3_partition_column", "SELECT key, count(*) AS n FROM (SELECT o_custkey AS key FROM orders) GROUP BY 1", lambda s, d: customer_orders(s, d)[1].repartition("key").sortWithinPartitions("key").groupBy("key").agg(F.count("*").alias("n")))
add("J4_slices", "SELECT key, a.n * b.n AS pairs FROM (SELECT c_custkey * 2 AS key, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1) b USING (key)", lambda s, d: (lambda a, b: a.groupBy("key").agg(F.count("*").alias("a")).join(b.groupBy("key").agg(F.count("*").alias("b")), "key").select("key", (F.col("a") * F.col("b")).alias("pairs")))(*customer_orders(s, d)))
add("J5_column_names", "SELECT unnest(['c_name_l', 'o_totalprice_r', 'key']) AS name", lambda s, d: s.createDataFrame([(c,) for c in joins.join(*customer_orders(s, d), on="key", how="inner", left_suffix="_l", right_suffix="_r", ordered=False).columns], "name string"))
add("J10_key_column", "SELECT key FROM (SELECT c_custkey * 2 AS key FROM customer) FULL JOIN (SELECT o_custkey AS key FROM orders) USING (key)", lambda s, d: joins.join(*customer_orders(s, d), on="key", how="outer", ordered=False).select("key"))
add("J12_vector_dictionary", "SELECT p_size, string_agg(p_partkey, ',' ORDER BY p_partkey) AS y FROM part GROUP BY 1", lambda s, d: parts(s, d).groupBy("p_size").agg(listed(F.array_sort(F.collect_list("p_partkey")), "list").alias("y")))
add("J13_search_sorted", "SELECT count(*) FILTER (p_retailprice < 1234.5) AS lower, count(*) FILTER (p_retailprice <= 1234.5) AS upper FROM part", lambda s, d: joins.bounds(parts(s, d), "p_retailprice", 1234.5))
add("J15_upper_bound", "SELECT count(*) FILTER (p_size <= 20) AS upper FROM part", lambda s, d: joins.bounds(parts(s, d), "p_size", 20).select("upper"))

# ------------------------------------------------------------------------------ aggregations
LI = "FROM lineitem"


def agg(name: str, sql: str, *columns, of: str = "lineitem") -> None:
    add(name, f"SELECT {sql} FROM {of}", lambda s, d: table(s, d, of).agg(*(c() if callable(c) else c for c in columns)))


r = lambda c, n=6: F.round(c, n)
add("A2_groups", "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1", lambda s, d: functional.grouped(table(s, d, "part").select("p_brand", "p_size"), ["p_brand"], lambda k, g: pd.DataFrame([(k[0], len(g), int(g.p_size.sum()))]), "p_brand string, n long, total long"))
add("A5_group_iterator", "SELECT n_regionkey AS key, count(*) AS n FROM nation GROUP BY 1", lambda s, d: s.createDataFrame([(k, len(g)) for k, g in nation(s, d).groups("n_regionkey")], "key int, n long"))
add("A6_group_by_sorted", "SELECT p_size, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1", lambda s, d: parts(s, d).repartition("p_size").sortWithinPartitions("p_size", "p_partkey").groupBy("p_size").agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")))
add("A7_sorting_group_by", "SELECT l_suppkey % 7 AS key, count(*) AS n FROM lineitem GROUP BY 1", lambda s, d: table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("key")).agg(F.count("*").alias("n")))
add("A9_flat_map", "SELECT unnest([n_nationkey, n_regionkey * 100]) AS value FROM nation", lambda s, d: grouping.flat_map(table(s, d, "nation").withColumn("p", F.struct("n_nationkey", "n_regionkey")), lambda c: F.array(c["n_nationkey"], c["n_regionkey"] * 100), "p"))
agg("A13_sum_of_function", "sum(l_quantity * 2 + 1) AS y", lambda: F.sum(F.col("l_quantity") * 2 + 1).alias("y"))
for _id, _name, _sql, _f in (
    ("A15", "min", "min(l_extendedprice)", lambda: F.min("l_extendedprice")), ("A16", "max", "max(l_extendedprice)", lambda: F.max("l_extendedprice")), ("A19", "all", "bool_and(l_tax < 1)", lambda: F.bool_and(F.col("l_tax") < 1)), ("A20", "any", "bool_or(l_tax > 0.5)", lambda: F.bool_or(F.col("l_tax") > 0.5)),
    ("A22", "harmonic_mean", "round(count(*) / sum(1 / l_quantity), 6)", lambda: r(stats.harmonic_mean(F.col("l_quantity")))), ("A23", "variance", "round(var_samp(l_tax), 9)", lambda: r(F.var_samp("l_tax"), 9)), ("A24", "var_ns", "round(var_samp(l_discount), 9)", lambda: r(F.variance("l_discount"), 9)), ("A25", "sd", "round(stddev_samp(l_tax), 9)", lambda: r(F.stddev_samp("l_tax"), 9)),
    ("A27", "cor", "round(corr(l_tax, l_discount), 9)", lambda: r(F.corr("l_tax", "l_discount"), 9)), ("A41", "np_mean", "round(avg(l_tax), 9)", lambda: r(F.avg("l_tax"), 9)), ("A42", "np_all", "bool_and(l_quantity > 1)", lambda: F.bool_and(F.col("l_quantity") > 1)), ("A44", "py_sum", "sum(l_linenumber)::BIGINT", lambda: F.sum("l_linenumber")),
    ("A45", "py_min", "min(l_shipdate)", lambda: F.min("l_shipdate")), ("A46", "py_max", "max(l_shipdate)", lambda: F.max("l_shipdate")), ("A47", "py_any", "bool_or(l_quantity = 50)", lambda: F.bool_or(F.col("l_quantity") == 50)), ("A48", "py_all", "bool_and(l_quantity < 51)", lambda: F.bool_and(F.col("l_quantity") < 51)),
):
    agg(f"{_id}_{_name}", f"{_sql} AS y", lambda f=_f: f().alias("y"))
add("A18_arg_min", "SELECT p_partkey AS y FROM part ORDER BY p_retailprice, p_partkey LIMIT 1", lambda s, d: parts(s, d).agg(F.min(F.struct("p_retailprice", "p_partkey"))["p_partkey"].alias("y")))
add("A29_kendall", "SELECT round(sum(sign(a.n_nationkey - b.n_nationkey) * sign(a.n_regionkey - b.n_regionkey)) / (25 * 24.0), 9) AS tau FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey", lambda s, d: stats.kendall_tau(table(s, d, "nation"), "n_nationkey", "n_regionkey").select(F.round("tau", 9).alias("tau")))
add("A30_median", "SELECT median(l_quantity) AS q FROM lineitem", lambda s, d: stats.quantiles(table(s, d, "lineitem"), "l_quantity", [0.5]).select("q"))
add("A32_quantiles", "SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS q FROM lineitem", lambda s, d: stats.quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9]))
add("A33_five_points", "SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS p, unnest(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1])) AS q FROM lineitem", lambda s, d: stats.quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 1.0]))
add("A35_quantiles_from_histogram", "SELECT p, min(p_size) AS q FROM (SELECT p_size, sum(count(*)) OVER (ORDER BY p_size) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1), (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(p) WHERE share >= p GROUP BY 1", lambda s, d: stats.quantiles_from_histogram(stats.histogram(table(s, d, "part"), "p_size"), "p_size", [0.25, 0.5, 0.75]))
add("A37_describe", "SELECT 'p_size' AS \"column\", round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS sd, min(p_size)::DOUBLE AS min, median(p_size) AS median, max(p_size)::DOUBLE AS max FROM part UNION ALL SELECT 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6), min(p_retailprice), median(p_retailprice), max(p_retailprice) FROM part",
    lambda s, d: stats.describe(parts(s, d), "p_size", "p_retailprice").select("column", r("mean").alias("mean"), r("sd").alias("sd"), "min", "median", "max"))
add("A43_reduce", "SELECT l_returnflag AS k, sum(l_quantity) AS value FROM lineitem GROUP BY 1", lambda s, d: functional.fold(table(s, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_quantity"), ["k"], lambda t: t.l_quantity, lambda a, b: a + b, lambda a, b: a + b, "double"))
add("A49_unique", "SELECT DISTINCT l_shipdate FROM lineitem", lambda s, d: grouping.unique(table(s, d, "lineitem"), "l_shipdate"))
add("A50_series_unique", "SELECT x AS y, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT p_size AS x FROM part)", lambda s, d: rows(sizes(s, d).unique()))

# ------------------------------------------------------------------------------ order, time series, sets
add("W3_apply_with_index", f"SELECT i, x * i AS y FROM ({SIZES})", lambda s, d: rows(sizes(s, d).apply_with_index(lambda v, i: v * i)))
add("W5_enumerate", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ix FROM orders", lambda s, d: order.with_index(table(s, d, "orders").select("o_orderkey"), "o_orderkey"))
add("W6_from_rows", SER.replace("SELECT", "SELECT", 1), lambda s, d: series(s, d))
ASOF = "SELECT q.series, q.at, e.x AS x FROM (SELECT DISTINCT user_id AS series, epoch_us(TIMESTAMP '2024-01-05' + INTERVAL (k) DAY) / 1e6 AS at FROM events, range(0, 40, {step}) t(k)) q ASOF LEFT JOIN (" + SER + ") e ON q.series = e.series AND q.at >= e.t"


def sampled(s, d, step):
    x = series(s, d)
    at = F.explode(F.array(*(F.lit(1704412800.0 + 86400 * k) for k in range(0, 40, step))))
    return joins.as_of(x, x.select("series").distinct().select("series", at.alias("at")), "t", "x", ["series"])


add("W7_sample", ASOF.format(step=7), lambda s, d: sampled(s, d, 7))
add("W11_sample_for_time", ASOF.format(step=40), lambda s, d: sampled(s, d, 40))
add("W8_resampled", f"SELECT series, t, x * 2 AS x FROM ({SER})", lambda s, d: timeseries.resampled(series(s, d).withColumn("x", F.col("x") * 2)))
add("W12_reverse", "SELECT count(*) OVER () - 1 - i AS i, x AS y FROM (" + SIZES + ")", lambda s, d: rows(sizes(s, d).reverse()))
add("W14_coiterate", "SELECT event_id, user_id, count(*) FILTER (event_type = 'click') OVER w AS clicks, count(*) FILTER (event_type <> 'click') OVER w AS others FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    lambda s, d: timeseries.coiterate(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", _count_both, "event_id long, user_id long, clicks long, others long"))


def _count_both(rows_):
    """Two counters that take turns by the kind of event: the state lives in the generator."""
    clicks = others = 0
    for x in rows_:
        clicks, others = (clicks + 1, others) if x["event_type"] == "click" else (clicks, others + 1)
        yield x["event_id"], x["user_id"], clicks, others


for _id, _name, _cols in (("O2", "sort_by_column", ("p_retailprice", "p_partkey")), ("O3", "sort", ("p_size", "p_partkey")), ("O4", "quick_sort", ("p_partkey",)), ("O11", "distributed_sort", ("p_retailprice", "p_partkey")), ("O12", "py_sorted", ("p_size", "p_partkey"))):
    add(f"{_id}_{_name}", f"SELECT p_partkey, row_number() OVER (ORDER BY {', '.join(_cols)}) - 1 AS ix FROM part", lambda s, d, cols=_cols: order.with_index(parts(s, d), *cols).select("p_partkey", "ix"))
add("O5_sort_homogenous", "SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS ix FROM lineitem", lambda s, d: order.with_index(table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", "l_orderkey", "l_linenumber"))
add("O10_quick_select_small", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 7", lambda s, d: order.n_smallest(parts(s, d).select("p_partkey", "p_retailprice"), 7, "p_retailprice", "p_partkey"))
add("O13_series_sort_values", "SELECT row_number() OVER (ORDER BY x, i) - 1 AS i, x AS y FROM (" + SIZES + ")", lambda s, d: rows(sizes(s, d).sort_values()))
add("O14_py_reversed", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) - 1 AS ix FROM part", lambda s, d: order.with_index(parts(s, d), F.desc("p_retailprice"), F.desc("p_partkey")).select("p_partkey", "ix"))
add("U2_append_identical_names", "SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size > 40", lambda s, d: frame.append(parts(s, d).select("p_partkey", "p_size"), parts(s, d).where("p_size > 40").select("p_size", "p_partkey")))
add("U3_vector_plus", "SELECT vec_id, len(embedding) * 2 AS n FROM embeddings", lambda s, d: table(s, d, "embeddings").select("vec_id", F.size(F.concat("embedding", "embedding")).cast("long").alias("n")))
add("U7_support_union", "SELECT p_size AS k FROM part UNION SELECT n_nationkey FROM nation", lambda s, d: table(s, d, "part").select(F.col("p_size").alias("k")).union(table(s, d, "nation").select("n_nationkey")).distinct())
add("U9_chain", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "region").select("r_name")))

# ------------------------------------------------------------------------------ user functions and the client
add("V1_scalar_function", "SELECT p_partkey, round(sqrt(p_retailprice) + p_size, 6) AS y FROM part", lambda s, d: parts(s, d).select("p_partkey", F.round(functional.scalar(lambda a, b: np.sqrt(a) + b, "double")("p_retailprice", "p_size"), 6).alias("y")))
add("V2_aggregate_function", "SELECT l_suppkey % 5 AS k, max(l_quantity) * 1000 + min(l_quantity) AS y FROM lineitem GROUP BY 1", lambda s, d: functional.fold(table(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), "l_quantity"), ["k"], lambda t: t.l_quantity.map(lambda q: [q, q]), _widen, _widen, "array<double>").select("k", (F.col("value")[1] * 1000 + F.col("value")[0]).alias("y")))
add("V3_table_function", "SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS i FROM nation", lambda s, d: functional.flat(table(s, d, "nation"), _count_up, "n_nationkey int, i int"))
add("V4_grouped_map", "SELECT p_partkey, p_size - min(p_size) OVER (PARTITION BY p_brand) AS y FROM part", lambda s, d: functional.grouped(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], lambda k, g: pd.DataFrame({"p_partkey": g.p_partkey, "y": g.p_size - g.p_size.min()}), "p_partkey long, y int"))
add("V5_submit", "SELECT count(*) AS n FROM part", lambda s, d: one(s, n=functional.submit(lambda: parts(s, d).count()).result()))
add("V6_define", "SELECT n_nationkey, n_nationkey * 3 AS y FROM nation", lambda s, d: (lambda b: table(s, d, "nation").select("n_nationkey", functional.scalar(lambda x: x * b.value, "int")("n_nationkey").alias("y")))(functional.define(s, 3)))
add("V7_remotely", "SELECT sum(n_regionkey)::BIGINT AS y FROM nation", lambda s, d: table(s, d, "nation").agg(F.sum("n_regionkey").alias("y")))
add("V8_download_small", "SELECT n_nationkey FROM nation", lambda s, d: s.createDataFrame(functional.download_small(table(s, d, "nation").select("n_nationkey"), 100), "n_nationkey int"))
add("V9_to_local", "SELECT r_regionkey FROM region", lambda s, d: s.createDataFrame(table(s, d, "region").select("r_regionkey").toPandas()).select(F.col("r_regionkey").cast("int").alias("r_regionkey")))
add("V10_compile", "SELECT true AS scans", lambda s, d: one(s, scans="Scan parquet" in functional.compile_only(parts(s, d))))
add("V11_out_of_process", "SELECT count(*) AS n, true AS elsewhere FROM region", lambda s, d: table(s, d, "region").select("r_regionkey").mapInPandas(_whose, "pid long").agg(F.count("*").alias("n"), F.bool_and(F.col("pid") > 0).alias("elsewhere")))
add("V12_map_over_list", "SELECT i, i * i AS y FROM (SELECT range AS i FROM range(20))", lambda s, d: s.range(20).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("y")))
add("V15_eval", "SELECT p_size, count(*) AS n FROM part GROUP BY 1", lambda s, d: functional.evaluate(s, "SELECT p_size, count(*) AS n FROM {p} GROUP BY p_size", p=parts(s, d)))
add("V13_inline_function", "SELECT p_partkey, p_size * 2 + p_retailprice AS y FROM part", lambda s, d: parts(s, d).select("p_partkey", functional.inline(s, "twice_and", "x int, y double", "double", "x * 2 + y")("p_size", "p_retailprice").alias("y")))
add("V14_type_mapping", "SELECT n_nationkey, '1.500000,2.500000' AS y FROM nation", lambda s, d: (functional.mapping(np.ndarray, lambda v: functional.lower(v.tolist())), table(s, d, "nation").select("n_nationkey", listed(functional.lower(np.array([1.5, 2.5])), "floats").alias("y")))[1])
add("V16_locality", "SELECT p_size, count(*) AS n FROM part GROUP BY 1", lambda s, d: functional.local(parts(s, d), "p_size").groupBy("p_size").agg(F.count("*").alias("n")))
add("Z15_paged", "SELECT ceil(count(*) / 100.0)::BIGINT AS pages, count(*) AS n FROM part", lambda s, d: functional.paged(parts(s, d), 100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).agg(F.count("*").alias("pages"), F.sum("c").alias("n")))


def _widen(a, b):
    return [min(a[0], b[0]), max(a[1], b[1])]


def _count_up(row):
    return ((row["n_nationkey"], i) for i in range(row["n_regionkey"] + 1))


def _whose(batches):
    import os

    for b in batches:
        yield pd.DataFrame({"pid": [os.getpid()] * len(b)})


