"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is
found by bisection, so that the weights meet a target entropy, or that no
source is repeated more often than a limit. The weights then become token
budgets, and a budget is realised as passes over a source's documents in a
permuted order: whole passes, then a part of one. The permutation goes by a
hash of the seed and the id, in blocks: a block is a range of hashes, so places
within a source are prefix sums over blocks plus places within a block, and no
source, however hot, is sorted or summed in one task.

DataFrame and SQL functions only. Texts are counted once; what is cut off and
reused is a narrow table of ids, sources and token counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalith.llm.keys import ensure_checkpoint_dir, table

TOKENS = r"[^\x20\x09-\x0D]+"
#: Documents in a block of the permutation, about.
BLOCK_DOCS = 4096
#: Exponents tried in one round; each round narrows the bracket by as much.
SECTIONS, ROUNDS = 32, 11
#: The largest exponent: nearly all weight is on the largest sources there.
STEEPEST = 16.0


def token_count(text: Column) -> Column:
    """Runs of non-white-space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def _entropies(sources: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the weights at each exponent; one small job."""
    e = F.explode(F.array(*map(F.lit, exponents)))
    t = sources.where("n > 0").select("share", e.alias("x")).select("x", F.pow("share", "x").alias("p"))
    rows = t.groupBy("x").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("s")).select("x", (F.log("z") - F.col("s") / F.col("z")).alias("h")).collect()
    by = {r.x: r.h for r in rows}
    return [by[x] for x in exponents]


def find_exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent that meets the target: in [0, STEEPEST] for an entropy, in [0, 1] for a limit of repeats.

    target_entropy: a share of the highest entropy there can be (log of the
    number of sources). Exponents below 1 make the plain shares more even, those
    above 1 less; a target below what STEEPEST gives (equal largest sources) gets
    STEEPEST.
    max_repeats: passes over the most repeated source at most, when the least
    repeated one is passed over once. Entropy falls and repetition falls as the
    exponent rises, so bisection (by sections of a bracket) is sound.
    """
    top = sources.where("n > 0").agg(F.count("*"), F.min("share"), F.max("share")).first()
    if top[0] < 2:
        return 1.0
    if max_repeats is not None:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            if (top[2] / top[1]) ** (1 - mid) > max_repeats:
                lo = mid
            else:
                hi = mid
        return hi
    goal, lo, hi = target_entropy * math.log(top[0]), 0.0, STEEPEST
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        if not all(a < b for a, b in zip(grid, grid[1:])):
            break
        h = _entropies(sources, grid[1:-1])
        k = sum(x >= goal for x in h)  # entropy falls along the grid
        lo, hi = grid[k], grid[k + 1]
    return lo


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 7) -> DataFrame:
    """Copies of every document in the mixture.

    One of target_entropy and max_repeats is to be given (see find_exponent).
    budget: tokens of the mixture; by default as many as there are, and with
    max_repeats so many that the least repeated source is passed over once and
    every document stays.

    Returns doc_id, source, n_tokens, weight (of the source), copies (passes
    over the document: the whole ones, and one more while the permuted source's
    running total stays within what is left of its budget), a row for each
    different pair of source and id; rows that repeat a pair move together and
    n_tokens is their sum.

    A null source is a source, a null id an id. Null and empty texts have no
    tokens, cost nothing and are taken in every begun pass. A source without
    tokens is passed over once. Other columns are ignored. An empty table gives
    an empty result.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    ensure_checkpoint_dir(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), token_count(F.col(f"`{text_col}`").cast("string")).alias("n"))
    d = d.groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens"))
    d = d.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))).checkpoint()
    counts = d.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sources = counts.withColumn("share", F.col("n") / F.lit(max(total, 1)).cast("double")).checkpoint()
    x = find_exponent(sources, target_entropy, max_repeats)
    z = sources.where("n > 0").agg(F.sum(F.pow("share", F.lit(x))), F.max(F.col("n") / F.pow("share", F.lit(x)))).first()
    all_tokens = budget if budget is not None else total if max_repeats is None else (z[1] or 0) * (z[0] or 1)
    weight = F.when(F.col("n") > 0, F.pow("share", F.lit(x)) / F.lit(z[0] or 1.0)).otherwise(0.0)
    plan = sources.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(float(all_tokens))).cast("long"))
    whole = F.when(F.col("n") > 0, F.expr("budget div n")).otherwise(1)
    plan = plan.select("source", "weight", "docs", whole.alias("whole"), F.when(F.col("n") > 0, F.col("budget") - whole * F.col("n")).otherwise(-1).alias("rest"))
    # hex digits of the hash that name a block: the more documents, the more
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / BLOCK_DOCS))).cast("int")
    d = _same(d, plan.withColumn("digits", digits)).withColumn("block", F.substring("place", F.lit(1), F.col("digits")))
    blocks = d.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), before.alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("within", within).join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    extra = (F.col("before") + F.col("within") <= F.col("rest")).cast("long")
    return d.select("doc_id", "source", "n_tokens", "weight", (F.col("whole") + extra).cast("long").alias("copies"))


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join by source, null with null."""
    r = right.withColumnRenamed("source", "_s")
    return left.join(r, left.source.eqNullSafe(r._s)).drop("_s")


def realise(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture itself: each row of docs as often as its copies say, with all its columns."""
    p = plan.where("copies > 0").select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"))
    both = docs.join(p, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_mix_id")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_mix_source")))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_pass")).drop("_mix_pass")


TARGET = 0.98


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), target_entropy=TARGET).withColumn("weight", F.round("weight", 6))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, sum(coalesce(len(regexp_extract_all(text, '{TOKENS}')), 0))::BIGINT AS n_tokens FROM documents GROUP BY 1, 2),
c AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY 1),
s AS (SELECT source, n, n / (SELECT sum(n) FROM c)::DOUBLE AS share FROM c),
g AS (SELECT {TARGET} * ln(count(*)) AS goal FROM s WHERE n > 0),
b(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, {STEEPEST}::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN h >= goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= goal THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT k, lo, hi, goal, (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2))) / sum(pow(share, (lo + hi) / 2)) FROM s WHERE n > 0) AS h FROM b, g WHERE k < 55)),
x AS (SELECT CASE WHEN (SELECT count(*) FROM s WHERE n > 0) < 2 THEN 1.0 ELSE lo END AS e FROM b WHERE k = 55),
w AS (SELECT source, n, CASE WHEN n > 0 THEN pow(share, e) / (SELECT sum(pow(share, e)) FROM s, x WHERE n > 0) ELSE 0 END AS weight FROM s, x),
p AS (SELECT source, n, weight, round(weight * (SELECT sum(n) FROM c))::BIGINT AS budget FROM w),
q AS (SELECT source, weight, CASE WHEN n > 0 THEN budget // n ELSE 1 END AS whole_, CASE WHEN n > 0 THEN budget % n ELSE -1 END AS rest FROM p),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, r.source, n_tokens, round(weight, 6) AS weight, (whole_ + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source
"""
