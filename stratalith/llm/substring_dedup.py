"""Removal of repeated word windows by level-wise doubling.

A quarter-length window that is repeated is extended to the half length on
either side; a half-length window that is repeated is extended to all windows
of the full length around it; full-length windows then keep their first place
only. At each level only windows repeated at the level below are looked at.

The lowest level need not shuffle every quarter-length window: a repeated full
window has the same minimisers (quarter windows of least hash) wherever it is,
so these anchors alone are counted, about an eighth of all positions. Nothing
is lost by that: anchors and half windows only nominate candidates, and every
occurrence of a repeated full window nominates the same ones.

Shape of the plan: the texts are shuffled once, by id, and that exchange is
reused by every level. Counting shuffles pre-aggregated hashes. What goes back
to a document is the set of its hashes that survive (exact copies of a document
of smaller id are told apart first, by a digest, and take no part); a hash that a third of
all documents share stays a skewed semi-join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalith.llm.keys import NULL_ID, ensure_checkpoint_dir, id_key, partitions
from stratalith.llm.words import NON_SPACE, U64, Words, buffers, chunks, mix, sequence_hashes, sliding

TOP = U64(2**64 - 1)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    raw, offsets = buffers(batch.column("_text"))
    for lo, hi in chunks(offsets):
        w = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NON_SPACE)
        yield lo, hi, w, w.hashes()


def _members(batch: pa.RecordBatch, column: str, lo: int, hi: int, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether x is in its row's list of hashes."""
    lists = batch.column(column).slice(lo, hi - lo)
    owner = np.repeat(np.arange(hi - lo, dtype=np.int64), np.asarray(lists.value_lengths().fill_null(0)))
    values = np.asarray(lists.flatten()).astype(np.int64, copy=False).view(U64)
    return np.isin(x ^ mix(row.astype(U64), 77), values ^ mix(owner.astype(U64), 77))


def _counted(keys: np.ndarray, row: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """One row for each text and hash: h, g (the text's key), c occurrences."""
    _, at, n = np.unique(x ^ mix(row.astype(U64), 77), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([_i64(x[at]), pa.array(keys[row[at]]), pa.array(n.astype(np.int64))], names=["h", "g", "c"])


def _anchors(window: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("_g"))
            for lo, hi, w, h in _scans(batch):
                full = w.whole(window)
                if not full.any():
                    continue
                x = np.maximum(sequence_hashes(h, low), U64(1))
                span = window - low + 1
                least = np.where(full, sliding(x, span, np.minimum, TOP), U64(0))
                back = sliding(least[::-1], span, np.maximum, U64(0))[::-1]  # the largest least of the windows that hold i
                at = np.flatnonzero((back == x) & w.whole(low))
                yield _counted(keys[lo:hi], w.row[at], x[at])

    return run


def _halves(low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("_g"))
            for lo, hi, w, h in _scans(batch):
                x = np.maximum(sequence_hashes(h, low), U64(1))
                at = np.flatnonzero(_members(batch, "_low", lo, hi, x, w.row) & w.whole(low))
                start = np.unique(np.concatenate([at, at - low]))
                start = start[start >= 0]
                start = start[w.whole(2 * low)[start]]
                if len(start):
                    yield _counted(keys[lo:hi], w.row[start], sequence_hashes(h, 2 * low)[start])

    return run


def _candidates(batch: pa.RecordBatch, lo: int, hi: int, w: Words, h: np.ndarray, window: int, low: int) -> np.ndarray:
    """Starts of the full windows around surviving half windows."""
    at = _members(batch, "_half", lo, hi, sequence_hashes(h, 2 * low), w.row) & w.whole(2 * low)
    near = sliding(at.astype(np.uint8), window - 2 * low + 1, np.maximum, 0).astype(bool)
    return np.flatnonzero(near & w.whole(window))


def _fulls(window: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.asarray(batch.column("_k")), np.asarray(batch.column("_g"))
            for lo, hi, w, h in _scans(batch):
                s = _candidates(batch, lo, hi, w, h, window, low)
                if len(s):
                    x, y, row = sequence_hashes(h, window)[s], sequence_hashes(h, window, 1)[s], w.row[s]
                    _, at = np.unique(x ^ mix(row.astype(U64), 77), return_index=True)
                    yield pa.RecordBatch.from_arrays([_i64(x[at]), _i64(y[at]), pa.array(ids[lo:hi][row[at]]), pa.array(keys[lo:hi][row[at]])], names=["h", "h2", "k", "g"])

    return run


def _cut(window: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, h in _scans(batch):
                copy = np.asarray(batch.column("_copy").slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool)
                covered = np.zeros(len(w) + 1, np.int64)
                s = _candidates(batch, lo, hi, w, h, window, low)
                if len(s):
                    x = sequence_hashes(h, window)[s]
                    mine = _members(batch, "_first", lo, hi, x, w.row[s])
                    _, at = np.unique(x ^ mix(w.row[s].astype(U64), 77), return_index=True)
                    first = np.zeros(len(s), bool)
                    first[at] = True  # np.unique gives each value's first place
                    gone = s[~(mine & first)]
                    np.add.at(covered, gone, 1)
                    np.add.at(covered, gone + window, -1)
                removed = (np.cumsum(covered[:-1]) > 0) | (copy & (w.count >= window))[w.row]
                n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), np.minimum(w.first, len(w))) * (w.count > 0)
                kept, spans = [], []
                data = w.raw.tobytes()
                for i in range(hi - lo):
                    words = data[w.offsets[i] : w.offsets[i + 1]].split()
                    cut = []
                    if n_removed[i]:
                        out = removed[w.first[i] : w.first[i] + w.count[i]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                        cut = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                        words = [x for x, gone_ in zip(words, out.tolist()) if not gone_]
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                    spans.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
                )

    return run


def _survivors(level: DataFrame, name: str) -> DataFrame:
    """_g and the text's hashes that occur more than once in the corpus."""
    again = level.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")
    return level.select("h", "g").join(again, "h", "left_semi").groupBy("g").agg(F.collect_list("h").alias(name)).withColumnRenamed("g", "_g")


def _nominated(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame, int]:
    """All texts (with _copy: a copy of one of smaller id), the half windows that survive, and the lowest length."""
    low, n = window // 4, partitions(docs)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), id_key(id_col).alias("_k"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    digest = F.md5(F.col("_text").cast("binary"))
    # rows without an id are keyed by their text: they are many keys, and neither they nor their hashes meet in one place
    plain = plain.withColumn("_g", F.coalesce("_id", F.xxhash64(digest)))
    # a text that a smaller id has too goes as a whole: it starts no window for the first time
    marks = plain.select("_k", "_g", digest.alias("_m"))
    least = marks.groupBy("_m").agg(F.min("_k").alias("_least"))
    later = marks.join(least, "_m").where("_k > _least").groupBy("_g").agg(F.collect_set("_m").alias("_copies"))
    all_ = plain.repartition(n, "_g").join(later, "_g", "left").withColumn("_copy", F.coalesce(F.array_contains("_copies", digest), F.lit(False))).drop("_copies")
    base = all_.where(~F.col("_copy"))

    lows = _survivors(base.mapInArrow(_anchors(window, low), "h long, g long, c long"), "_low")
    halves = _survivors(base.join(lows, "_g").mapInArrow(_halves(low), "h long, g long, c long"), "_half")
    return all_, halves, low


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word in a window of `window` words that also starts earlier.

    Words are runs of non-white-space (ASCII white space). Earlier means in a
    document of smaller id, or in the same document further left. All windows
    are judged on the input.

    Returns doc_id, n_words, n_removed, kept_text (the kept words joined by one
    space) and removed_spans (word ranges [start, end)), a row for each input row.

    Null text counts as empty. A null id counts as the largest id and comes back
    null. Rows of equal id are not earlier than one another; each is judged
    against smaller ids and itself. Other columns are ignored. An empty table
    gives an empty result. Texts of under `window` words stay whole.
    """
    if window < 4:
        raise ValueError("window must be 4 words at least")
    low = window // 4
    all_, halves, _ = _nominated(docs, id_col, text_col, window)
    base = all_.where(~F.col("_copy"))
    fulls = lambda rows: rows.join(halves, "_g").mapInArrow(_fulls(window, low), "h long, h2 long, k long, g long")
    owners = fulls(base).groupBy("h", "h2").agg(F.min("k").alias("k"))
    # an id owns the windows that no smaller one has; so does every row without an id where no id has them
    lost = fulls(base.where(F.col("_id").isNull())).join(owners.where(F.col("k") == NULL_ID), ["h", "h2"])
    owned = owners.where(F.col("k") != NULL_ID).select("h", F.col("k").alias("_g")).unionByName(lost.select("h", F.col("g").alias("_g")))
    firsts = owned.groupBy("_g").agg(F.collect_list("h").alias("_first"))
    return all_.join(halves, "_g", "left").join(firsts, "_g", "left").mapInArrow(
        _cut(window, low), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start: long, end: long>>"
    )


def _extend(length: int):
    """Windows of twice the length whose halves both survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("_g"))
            for lo, hi, w, h in _scans(batch):
                at = _members(batch, "_at", lo, hi, sequence_hashes(h, length), w.row) & w.whole(length)
                both = at.copy()
                both[: max(0, len(at) - length)] &= at[length:]
                both[max(0, len(at) - length) :] = False
                s = np.flatnonzero(both & w.whole(2 * length))
                if len(s):
                    yield _counted(keys[lo:hi], w.row[s], sequence_hashes(h, 2 * length)[s])

    return run


def _at_window(window: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("_g"))
            for lo, hi, w, h in _scans(batch):
                s = _candidates(batch, lo, hi, w, h, window, low)
                if len(s):
                    yield _counted(keys[lo:hi], w.row[s], sequence_hashes(h, window)[s])

    return run


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """How long the repeats of each text are: doubling goes on until no window survives.

    Returns doc_id and repeated (long): the largest of window, 2 window, 4 window
    ... words such that the text holds a sequence of so many words that occurs
    again, in it or in another text that is no copy of one of smaller id; 0 where
    there is none. A row for each input row. Copies of a text with a smaller id
    take no part and have -1. Null text counts as empty, a null id as in
    remove_repeats(); an empty table gives an empty result. A round a doubling,
    each cut off by a checkpoint; the driver sees whether it is empty.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    all_, halves, low = _nominated(docs, id_col, text_col, window)
    base, length, found = all_.where(~F.col("_copy")), window, None
    now = _survivors(base.join(halves, "_g").mapInArrow(_at_window(window, low), "h long, g long, c long"), "_at").checkpoint()
    while not now.isEmpty():
        marks = now.select("_g", F.lit(length).cast("long").alias("n"))
        found = marks if found is None else found.unionByName(marks)
        now = _survivors(base.join(now, "_g").mapInArrow(_extend(length), "h long, g long, c long"), "_at").checkpoint()
        length *= 2
    if found is None:
        return all_.select(F.col("_id").alias("doc_id"), F.when(F.col("_copy"), -1).otherwise(0).cast("long").alias("repeated"))
    top = found.groupBy("_g").agg(F.max("n").alias("n"))
    return all_.join(top, "_g", "left").select(F.col("_id").alias("doc_id"), F.when(F.col("_copy"), -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("repeated"))


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM g WHERE k > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN r USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
