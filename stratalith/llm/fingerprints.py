"""SimHash document fingerprints and their search by permuted block tables.

A document's terms are its pairs of neighbouring words (with the word alone
where there is one only). Each term's hash votes on every bit of the
fingerprint, weighed by how often the term occurs; a bit is set if it has over
half of the votes. Votes are counted in packed sums (two 32-bit counters in a
long), so a text is one pass of generate and hash aggregate inside generated
code, and only the few sums of each text are shuffled.

Two fingerprints within r bits differ in at most r of b blocks of bits, so they
agree in b - r blocks at least: a table for each choice of b - r blocks, keyed
by their bits, brings every such pair together. Equal fingerprints are one.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalith.llm.keys import NULL_ID, ensure_checkpoint_dir, id_key, partitions, table

LANES = 2  # of 64 bits
WORD = r"[\x20\x09-\x0D]+"
MASK = 0x0000000100000001


def terms(text: Column) -> Column:
    """Hashes of all neighbouring pairs of words, repeats included; empty for no words."""
    words = F.filter(F.split(F.lower(text), WORD), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n == 1, hashes).otherwise(pairs)


def fingerprint(texts: DataFrame, keys: list[str], text_col: str, lanes: int = LANES) -> DataFrame:
    """keys and fp (array of longs) for each row; keys have to name a row. No terms: all bits zero."""
    h = texts.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("_t"))
    h = h.select(*keys, *(F.when(F.col("_t").isNotNull(), F.xxhash64("_t", F.lit(lane))).alias(f"_h{lane}") for lane in range(lanes)))
    sums = [F.sum(F.shiftrightunsigned(f"_h{lane}", k).bitwiseAND(F.lit(MASK))).alias(f"_v{lane}_{k}") for lane in range(lanes) for k in range(32)]
    g = h.groupBy(*keys).agg(F.count("_h0").alias("_n"), *sums)

    def lane_bits(lane: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            v = F.coalesce(F.col(f"_v{lane}_{k}"), F.lit(0))
            low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
            out = out.bitwiseOR(F.when(low * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0)))
            out = out.bitwiseOR(F.when(high * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0)))
        return out

    return g.select(*keys, F.array(*(lane_bits(x) for x in range(lanes))).alias("fp"))


def to_hex(fp: Column) -> Column:
    return F.concat_ws("", F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def likeness(a: Column, b: Column, lanes: int = LANES) -> Column:
    """Share of equal bits: the angle between two texts' terms, 0.5 for unrelated ones."""
    return 1.0 - hamming(a, b) / float(64 * lanes)


def near_links(fps: DataFrame, radius: int = 3, blocks: int = 5, lanes: int = LANES) -> DataFrame:
    """How many other fingerprints lie within `radius` bits of each.

    fps: column fp (array of longs), rows may repeat. Returns fp, n_near (of
    different fingerprints within the radius) for each different fingerprint.
    Every pair is found: it is compared in the first table in which it meets, and
    is counted, not kept.
    """
    if radius >= blocks:
        raise ValueError("more blocks than the radius are needed")
    bits, one = 64 * lanes, fps.select("fp").distinct()
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]

    def piece(fp: Column, lo: int, hi: int) -> list[Column]:
        out = []
        for lane in range(lanes):
            a, b = max(lo, 64 * lane) - 64 * lane, min(hi, 64 * lane + 64) - 64 * lane
            if a < b:
                mask = ((1 << (b - a)) - 1) << a
                out.append(fp[lane].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    choices = list(combinations(range(blocks), blocks - radius))
    keys = [F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), *(p for b in c for p in piece(F.col("fp"), edges[b], edges[b + 1]))).alias("key")) for i, c in enumerate(choices)]
    rows = one.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.table", "k.key")
    other = rows.select(F.col("fp").alias("fp2"), "table", "key")
    equal = lambda b: F.forall(F.array(*(x == y for x, y in zip(piece(F.col("fp"), edges[b], edges[b + 1]), piece(F.col("fp2"), edges[b], edges[b + 1])))), lambda e: e)
    same = F.filter(F.array(*(F.when(equal(b), F.lit(b)) for b in range(blocks))), lambda x: x.isNotNull())
    # the choices are in lexicographic order: the first table of a pair is that of its first equal blocks
    first = F.slice(same, 1, blocks - radius) == F.array_sort(F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in choices)), F.col("table") + 1))
    pairs = rows.join(other, ["table", "key"]).where((F.col("fp") != F.col("fp2")) & (hamming(F.col("fp"), F.col("fp2")) <= radius) & first)
    n = pairs.groupBy("fp").agg(F.count("*").alias("n_near")).withColumnRenamed("fp", "_fp")
    return one.join(n, one.fp == n._fp, "left").select("fp", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def neighbours(docs: DataFrame) -> DataFrame:
    """_k, _next, _prev (the next and previous key in descending order, round the end) and _before (the previous length).

    docs: _k and _len. The order is made by ranges: keys are range partitioned,
    cut off by a checkpoint with their partition's number, ordered within it, and
    joined at the partitions' edges through a table of one row a partition.
    """
    ids = docs.groupBy("_k").agg(F.max("_len").alias("_len"))
    ids = ids.repartitionByRange(partitions(docs), F.col("_k").desc()).withColumn("_p", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_p").orderBy(F.col("_k").desc())
    ids = ids.select("_k", "_p", F.lead("_k").over(w).alias("_n"), F.lag("_k").over(w).alias("_b"), F.lag("_len").over(w).alias("_bl"), "_len")
    # one row a partition: its first key, its last and that one's length
    ends = ids.groupBy("_p").agg(F.max("_k").alias("first"), F.min("_k").alias("last"), F.max(F.when(F.col("_n").isNull(), F.col("_len"))).alias("len"))
    wp, wa = Window.orderBy("_p"), Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda c, shift, edge: F.coalesce(shift(c).over(wp), edge(c).over(wa))
    ends = ends.select(F.col("_p").alias("_q"), around("first", F.lead, F.first).alias("_nf"), around("last", F.lag, F.last).alias("_pl"), around("len", F.lag, F.last).alias("_ll"))
    ids = ids.join(ends, ids._p == ends._q)
    return ids.select("_k", F.coalesce("_n", "_nf").alias("_next"), F.coalesce("_b", "_pl").alias("_prev"), F.when(F.col("_b").isNull(), F.col("_ll")).otherwise(F.col("_bl")).alias("_before"))


def edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k, _text, _len, _next and _edited: the text whose last third is replaced by the beginning of the next document.

    Whole texts are shuffled once, by key; of the next document only the part
    that is asked for travels.
    """
    d = docs.select(id_key(id_col).alias("_k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    near = neighbours(d.select("_k", F.length("_text").cast("long").alias("_len")))
    d = d.join(near, "_k")
    heads = d.groupBy(F.col("_prev").alias("_k")).agg(F.min(F.expr("substring(_text, 1, cast(_before div 3 as int))")).alias("_head"))
    d = d.join(heads, "_k").withColumn("_len", F.length("_text").cast("long"))
    return d.select("_k", "_text", "_len", "_next", F.concat(F.expr("substring(_text, 1, cast(_len - _len div 3 as int))"), F.expr("substring(_head, 1, cast(_len div 3 as int))")).alias("_edited"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex),
    near_edited and near_next (share of equal bits with the edited text's and with
    the next document's fingerprint), n_near (how many other fingerprints of the
    documents lie within `radius` bits), a row for each input row.

    Null text counts as empty; empty and wordless texts have fingerprint zero. A
    null id counts as the largest (2**63 - 1, which therefore comes back as null).
    Rows of one id are one document in the order: its beginning is the least of
    theirs, it hands on as much as its longest asks for. A single document is its
    own next. Other columns are ignored; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    e = edit(docs, id_col, text_col)
    # each row becomes two, the text and the edited text, of neighbouring numbers
    both = e.select("_k", "_len", "_next", F.sha2(F.col("_edited").cast("binary"), 256).alias("_sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("t")))).alias("_v"))
    both = both.withColumn("_row", F.monotonically_increasing_id()).select("_k", "_len", "_next", "_sha", "_row", F.col("_v.kind").alias("_kind"), F.col("_v.t").alias("_t"))
    fps = fingerprint(both, ["_k", "_len", "_next", "_sha", "_row", "_kind"], "_t")
    pair = fps.groupBy("_k", "_len", "_next", "_sha", F.shiftrightunsigned("_row", 1).alias("_row"))
    of = lambda kind: [F.max(F.when(F.col("_kind") == kind, F.col("fp")[x])).alias(f"_f{kind}_{x}") for x in range(LANES)]
    one = pair.agg(*of(0), *of(1))
    one = one.select("_k", "_len", "_next", "_sha", *(F.array(*(F.col(f"_f{kind}_{x}") for x in range(LANES))).alias(name) for kind, name in ((0, "fp"), (1, "efp")))).checkpoint()
    next_ = one.groupBy(F.col("_k").alias("_next")).agg(F.min("fp").alias("nfp"))
    near = near_links(one, radius).withColumnRenamed("fp", "_fp")
    out = one.join(next_, "_next").join(near, F.col("fp") == F.col("_fp"))
    return out.select(
        F.when(F.col("_k") != NULL_ID, F.col("_k")).alias("doc_id"), F.col("_len").alias("n_chars"), F.col("_sha").alias("edited_sha256"), to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), F.col("n_near").cast("long").alias("n_near"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
