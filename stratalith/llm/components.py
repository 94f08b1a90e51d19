"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalith.llm.keys import ensure_checkpoint_dir


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable) for every node that has an edge to another.

    Each round rewires edges to the least neighbour and is cut off by a
    checkpoint in the shared folder; the driver sees two numbers a round. A node
    that a third of all edges meet is pre-aggregated (min) and its edges are
    joined by a splittable sort-merge join. Null ends and loops are no edges.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct().checkpoint()
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        new = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        seen = _mark(new)
        if seen == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, mark = new, seen


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
