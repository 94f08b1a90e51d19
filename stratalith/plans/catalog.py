"""The registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its DuckDB equivalent."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def listed(y: Column, kind: str) -> Column:
    """A list as text, so that any two engines' results compare: list, floats (six digits), nested or nested_floats."""
    if kind.startswith("nested"):
        return F.array_join(F.transform(y, lambda r: listed(r, "floats" if "floats" in kind else "list")), ";")
    return F.array_join(F.transform(y, lambda v: F.format_string("%.6f", v) if kind == "floats" else v.cast("string")), ",")


def listed_sql(y: str, kind: str) -> str:
    """The same in DuckDB."""
    one = lambda x, k: f"array_to_string(list_transform({x}, lambda v: {'printf(' + chr(39) + '%.6f' + chr(39) + ', v::DOUBLE)' if k == 'floats' else 'v::VARCHAR'}), ',')"
    if kind.startswith("nested"):
        return f"array_to_string(list_transform({y}, lambda r: {one('r', 'floats' if 'floats' in kind else 'list')}), ';')"
    return one(f"({y})", kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "flagship",
    """SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price,
    round(stddev_samp(l_extendedprice), 4) AS sd_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1""",
)
def flagship(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", "l_quantity", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    g = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority")
    return g.agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd_price")
    ).orderBy("o_orderpriority")
