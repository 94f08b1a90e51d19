"""Preference formatting of conversations.

A chosen and a rejected conversation share a prefix of turns; it is rendered
once, as the prompt, and the rest of each as a completion with a mask of the
spans that a model is to be trained on (the assistant's words). Everything is
an array expression on one row a pair. A conversation, as the unit of the
result, has to fit in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalith.llm.keys import table

TURN = "array<struct<role: string, text: string>>"


def render(turns: Column) -> Column:
    """<|role|>, new line, the text, <|end|>, new line, for each turn; nulls count as empty."""
    one = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))
    return F.concat_ws("", F.transform(turns, one))


def mask(turns: Column, trained: str = "assistant") -> Column:
    """Character spans [start, end) of the trained turns' texts with their end marks, in what render() gives."""
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + 5
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + 7
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc, t):
        a = acc["at"] + head(t)
        span = F.array(F.struct(a.alias("start"), (a + body(t)).cast("int").alias("end")))
        return F.struct((a + body(t) + 1).cast("int").alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the start on are equal in role and text (null equals null)."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return (F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))).cast("int")


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected", trained: str = "assistant") -> DataFrame:
    """Prompt and paired masked completions.

    pairs: an id, and chosen and rejected as arrays of struct(role, text).
    Returns pair_id, n_prompt_turns, prompt, chosen_completion, chosen_mask,
    rejected_completion, rejected_mask (spans over the completion's characters).

    A null array counts as no turns; a null turn, role or text as empty text (a
    null turn equals only a null turn). Equal conversations give two empty
    completions; conversations that differ from the start an empty prompt.
    Repeated rows give repeated results. Other columns are ignored.
    """
    side = lambda c: F.coalesce(F.col(f"`{c}`").cast(TURN), F.array().cast(TURN))
    df = pairs.select(F.col(f"`{id_col}`").alias("pair_id"), side(chosen).alias("_a"), side(rejected).alias("_b")).withColumn("_n", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    return df.select(
        "pair_id", F.col("_n").alias("n_prompt_turns"), render(F.slice("_a", F.lit(1), F.col("_n"))).alias("prompt"),
        render(rest("_a")).alias("chosen_completion"), mask(rest("_a"), trained).alias("chosen_mask"),
        render(rest("_b")).alias("rejected_completion"), mask(rest("_b"), trained).alias("rejected_mask"),
    )


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: conversation 2k is chosen, and rejected is the same
    with its last assistant turn replaced by the last assistant turn of conversation 2k+1.

    Turns are ordered by turn, then role, then text. Where 2k has no assistant
    turn the other answer is added at its end; where 2k+1 has none the answer
    is left out. Turns without conv_id belong to no conversation. Returns
    pair_id, chosen, rejected, a row for each even conversation.
    """
    key = F.col("conv_id").cast("long")
    even = F.pmod(key, F.lit(2)) == 0
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    g = conversations.where(key.isNotNull()).groupBy(F.shiftright(key, 1).alias("pair_id")).agg(
        F.array_sort(F.collect_list(F.when(even, turn))).alias("_t"), F.max(F.when(~even & (F.col("role") == "assistant"), turn)).alias("_other"))
    g = g.where(F.size("_t") > 0).withColumn("_last", F.array_max(F.transform("_t", lambda t, i: F.when(t["role"] == "assistant", i))))
    bare = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    keep = F.slice("_t", F.lit(1), F.coalesce(F.col("_last"), F.size("_t")))
    other = F.when(F.col("_other").isNotNull(), F.array(F.col("_other"))).otherwise(F.slice("_t", 1, 0))
    return g.select("pair_id", bare(F.col("_t")).alias("chosen"), bare(F.concat(keep, other)).alias("rejected"))


def query(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(pairs_from_conversations(table(spark, sf_dir, "conversations")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c.replace("_completion", "") + "_sha256")
    spans = lambda c: F.to_json(F.transform(c, lambda s: F.array(s["start"], s["end"]))).alias(c)
    return out.select("pair_id", "n_prompt_turns", digest("prompt"), digest("chosen_completion"), spans("chosen_mask"), digest("rejected_completion"), spans("rejected_mask"))


SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT conv_id // 2 AS pair_id, i, role, text FROM t WHERE conv_id % 2 = 0),
o AS (SELECT conv_id // 2 AS pair_id, role, text FROM t WHERE conv_id % 2 = 1 AND role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
z AS (SELECT pair_id, count(*) AS n, max(i) FILTER (role = 'assistant') AS last_ FROM e GROUP BY 1),
r AS (SELECT e.pair_id, i, role, text FROM e JOIN z USING (pair_id) WHERE i < coalesce(last_, n + 1)
      UNION ALL SELECT o.pair_id, coalesce(last_, n + 1), o.role, o.text FROM o JOIN z USING (pair_id)),
c AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS k FROM (SELECT pair_id, i, e.i IS NOT NULL AND r.i IS NOT NULL AND e.role IS NOT DISTINCT FROM r.role AND e.text IS NOT DISTINCT FROM r.text AS same
      FROM e FULL JOIN r USING (pair_id, i)) GROUP BY 1),
f AS (SELECT 'c' AS side, * FROM e UNION ALL SELECT 'r', * FROM r),
g AS (SELECT side, pair_id, i, k, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' AS body FROM f JOIN c USING (pair_id)),
h AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY side, pair_id, i > k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM g),
s AS (SELECT pair_id, side, any_value(k) AS k, sha256(coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i <= k), '')) AS prompt,
      sha256(coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (i > k), '')) AS rest,
      '[' || coalesce(string_agg('[' || a::BIGINT || ',' || (a + length(body))::BIGINT || ']', ',' ORDER BY i) FILTER (i > k AND role = 'assistant'), '') || ']' AS mask FROM h GROUP BY 1, 2)
SELECT a.pair_id, a.k::INTEGER AS n_prompt_turns, a.prompt AS prompt_sha256, a.rest AS chosen_sha256, a.mask AS chosen_mask,
    coalesce(b.rest, sha256('')) AS rejected_sha256, coalesce(b.mask, '[]') AS rejected_mask
FROM (SELECT * FROM s WHERE side = 'c') a LEFT JOIN (SELECT * FROM s WHERE side = 'r') b USING (pair_id)
"""
