"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens have two states, clean and toxic. Documents alone are labelled, so the
labelled tokens that the field is trained on come from them: in a toxic
document a token is toxic if one of its features (the word or a beginning of
it) marks toxic documents significantly; all others, and all of a clean
document, are clean. The field's emissions are sums of hashed feature weights,
its transitions a 2x2 matrix; both are trained by gradient ascent of the
conditional likelihood. Forward-backward marginals give each token's
probability; a document's score is a logistic function, fitted on the training
documents, of the log of its summed evidence (-sum p log(1-p)).

Training reads a bounded sample of labelled rows (`max_docs` documents of at
most `max_chars` characters) on the driver. Scoring is one pass over whole
texts without a shuffle; forward-backward runs over blocks of tokens of many
documents at once, exactly, so neither long nor many texts matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalith.llm.keys import table
from stratalith.llm.words import CHUNK_BYTES, WORDISH, Words, lower_chunks, mix, sequence_hashes

BITS = 18
PREFIXES = (0, 3, 4, 5, 6)  # 0: the whole word
CHUNK = 1 << 20


@dataclass
class Field:
    weights: np.ndarray  # emission log-odds of the toxic state by feature
    bias: float
    trans: np.ndarray  # 2x2 potentials
    start: float  # odds of the toxic state at a document's first token
    scale: float = 1.0  # the document's logistic function
    offset: float = 0.0


def features(w: Words) -> np.ndarray:
    """Hashed features of each token, a row for each of PREFIXES."""
    prefix = w.prefix_hasher()
    return np.stack([(prefix(w.end if k == 0 else np.minimum(w.end, w.start + k), salt=k) & np.uint64((1 << BITS) - 1)).astype(np.int32) for k in PREFIXES])


def marginals(emit: np.ndarray, first: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic state, and forward and backward odds, of each token.

    emit: log-odds; first: whether a document starts there. Exact: each block's
    2x2 product is made first, then the blocks' ends are chained, then all
    blocks run at once from their true ends.
    """
    n = len(emit)
    if n == 0:
        z = np.zeros(0)
        return z, z, z
    steps = max(8, int(np.sqrt(n)))
    blocks = -(-n // steps)
    e = np.ones(blocks * steps)
    e[:n] = np.exp(np.clip(emit, -20, 20))
    s = np.ones(blocks * steps, bool)
    s[:n] = first
    e, s = np.ascontiguousarray(e.reshape(blocks, steps).T), np.ascontiguousarray(s.reshape(blocks, steps).T)
    (a00, a01), (a10, a11) = f.trans
    # products: row i of the 2x2 matrix is what state i before the block leads to
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(steps):
        et, st = e[t], s[t]
        q0, q1 = p00 + p01, p10 + p11
        p00, p01 = np.where(st, q0, p00 * a00 + p01 * a10), np.where(st, q0 * f.start, p00 * a01 + p01 * a11) * et
        p10, p11 = np.where(st, q1, p10 * a00 + p11 * a10), np.where(st, q1 * f.start, p10 * a01 + p11 * a11) * et
        top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
        p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
    fwd_in, bwd_in = np.ones(blocks), np.ones(blocks)
    for b in range(1, blocks):
        r = fwd_in[b - 1]
        fwd_in[b] = (p01[b - 1] + p11[b - 1] * r) / max(p00[b - 1] + p10[b - 1] * r, 1e-300)
    for b in range(blocks - 2, -1, -1):
        q = bwd_in[b + 1]
        bwd_in[b] = (p10[b + 1] + p11[b + 1] * q) / max(p00[b + 1] + p01[b + 1] * q, 1e-300)
    fwd, bwd, r, q = np.empty_like(e), np.empty_like(e), fwd_in, bwd_in
    for t in range(steps):
        r = fwd[t] = np.where(s[t], f.start, (a01 + a11 * r) / (a00 + a10 * r)) * e[t]
    for t in range(steps - 1, -1, -1):
        bwd[t] = q
        x = e[t] * q
        q = np.where(s[t], 1.0, (a10 + a11 * x) / (a00 + a01 * x))
    fwd, bwd = fwd.T.reshape(-1)[:n], bwd.T.reshape(-1)[:n]
    odds = fwd * bwd
    return odds / (1 + odds), fwd, bwd


class Sample:
    """Features and places of the tokens of a list of texts, made a chunk at a time."""

    def __init__(self, texts: list[str], seeds: int = 8, shingle: int = 3):
        self.rows, feats, rows = len(texts), [np.zeros((len(PREFIXES), 0), np.int32)], [np.zeros(0, np.int32)]
        self.least = np.full((seeds, self.rows), np.uint64(2**64 - 1))  # least hashes of each text's shingles
        self.count = np.zeros(self.rows, np.int64)
        for lo, hi, raw, offsets in lower_chunks(pa.array(texts, pa.string()), CHUNK_BYTES):
            w = Words(raw, offsets, WORDISH)
            feats.append(features(w) if len(w) else feats[0])
            rows.append((w.row + lo).astype(np.int32))
            self.count[lo:hi] = w.count
            h, ok = sequence_hashes(w.hashes(), shingle) if len(w) else np.zeros(0, np.uint64), w.whole(shingle)
            for k in range(seeds):
                np.minimum.at(self.least[k], w.row[ok] + lo, mix(h[ok], 1000 + k))
        self.feats, self.row = np.concatenate(feats, axis=1), np.concatenate(rows)
        self.first = np.cumsum(self.count) - self.count

    def first_of_copies(self) -> np.ndarray:
        """Whether a text shares no least hash with an earlier one: copies are no independent evidence."""
        first, seen = np.ones(self.rows, bool), [set() for _ in self.least]
        for r, keys in enumerate(self.least.T.tolist()):
            if keys[0] < 2**64 - 1:
                first[r] = not any(x in s for x, s in zip(keys, seen))
                for x, s in zip(keys, seen):
                    s.add(x)
        return first


def _starts(w: Words | Sample) -> np.ndarray:
    first = np.zeros(int(w.count.sum()), bool)
    first[w.first[w.count > 0]] = True
    return first


def _emissions(f: Field, feats: np.ndarray) -> np.ndarray:
    out = np.full(feats.shape[1], float(f.bias))
    for row in feats:
        out += f.weights[row]
    return out


def token_labels(feats: np.ndarray, row: np.ndarray, toxic: np.ndarray, counted: np.ndarray, least: float = 35.0) -> np.ndarray:
    """Weak token labels from document labels: by the likelihood ratio (G) of a feature's counts over the `counted` documents."""
    n_pos, n_neg, size = int((toxic & counted).sum()), int((~toxic & counted).sum()), 1 << BITS
    a, b = np.zeros(size), np.zeros(size)
    for f in feats:  # the kinds of feature are counted apart and share few places
        pair = np.unique(row.astype(np.int64) * size + f)
        pair = pair[counted[pair // size]]
        doc, feat = pair // size, pair % size
        a += np.bincount(feat[toxic[doc]], minlength=size)
        b += np.bincount(feat[~toxic[doc]], minlength=size)
    # two kinds in one place may count a document twice
    a, b = np.minimum(a, n_pos), np.minimum(b, n_neg)
    share = (a + b) / max(n_pos + n_neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.nan_to_num(a * np.log(a / (share * n_pos))) + np.nan_to_num(b * np.log(b / (share * n_neg))))
    marks = (g > least) & (a / max(n_pos, 1) > 8 * (b + 0.25) / max(n_neg, 1))
    out = np.zeros(len(row), bool)
    for f in feats:
        out |= marks[f]
    return out & toxic[row]


def train(texts: list[str], toxic: np.ndarray, rounds: int = 40, fit_docs: int = 800) -> Field:
    """Fit field and document score. With no toxic or no clean document the score is the base rate."""
    field = Field(np.zeros(1 << BITS), -6.0, np.array([[1.0, 0.02], [0.7, 0.3]]), 0.02)
    if not len(texts) or toxic.all() or not toxic.any():
        rate = (float(toxic.sum()) + 0.5) / (len(texts) + 1) if len(texts) else 0.0
        field.scale, field.offset = 0.0, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        return field
    w = Sample(texts)
    feats, first = w.feats, _starts(w)
    y = token_labels(feats, w.row, toxic, w.first_of_copies())
    # the field is fitted on the first documents of either label (they come in hashed order)
    order = np.argsort(np.concatenate([np.arange(toxic.sum()), np.arange((~toxic).sum())])[np.argsort(np.argsort(~toxic, kind="stable"), kind="stable")], kind="stable")
    use = np.zeros(len(texts), bool)
    use[order[:fit_docs]] = True
    t = use[w.row]
    fx, yy, st = feats[:, t], y[t].astype(float), first[t]
    prev = np.concatenate([[0], yy[:-1]])
    inner = ~st
    counts = np.array([[((prev == i) & (yy == j) & inner).sum() for j in (0, 1)] for i in (0, 1)], float) + [[1, 0.1], [0.5, 0.5]]
    field.trans = counts / counts.sum(axis=1, keepdims=True)
    field.start = float((yy[st].sum() + 0.1) / (st.sum() + 1))
    # the shared rate of toxic tokens lies in the transitions; emissions start at zero
    field.bias, size = 0.0, 1 << BITS
    m, v, log_a = np.zeros(size + 5), np.zeros(size + 5), np.log(field.trans)
    for k in range(1, rounds + 1):
        field.trans = np.exp(log_a)
        p, fwd, bwd = marginals(_emissions(field, fx), st, field)
        miss = yy - p
        grad = np.zeros(size + 5)
        for row in fx:
            grad[:size] += np.bincount(row, miss, size)
        grad[:size] -= 0.02 * field.weights
        grad[size] = miss.sum()
        # pairwise marginals of inner tokens, for the transitions
        emit = np.exp(np.clip(_emissions(field, fx), -20, 20))
        before = np.concatenate([[1.0], fwd[:-1]])
        x = emit * bwd
        cell = [[np.ones_like(x) * field.trans[0, 0], field.trans[0, 1] * x], [before * field.trans[1, 0], before * field.trans[1, 1] * x]]
        z = cell[0][0] + cell[0][1] + cell[1][0] + cell[1][1]
        for i in (0, 1):
            for j in (0, 1):
                grad[size + 1 + 2 * i + j] = (((prev == i) & (yy == j) & inner).sum() - (cell[i][j] / z)[inner].sum()) * 0.2
        m = 0.8 * m + 0.2 * grad
        v = 0.95 * v + 0.05 * grad * grad
        step = 0.25 * (m / (1 - 0.8**k)) / (np.sqrt(v / (1 - 0.95**k)) + 1e-3)
        field.weights += step[:size]
        field.bias += step[size]
        log_a = np.clip(log_a + 0.2 * step[size + 1 :].reshape(2, 2), -12, 3)
    field.trans = np.exp(log_a)
    p, _, _ = marginals(_emissions(field, feats), first, field)
    x = evidence(p, w)
    held = ~use if (~use).sum() >= 400 and toxic[~use].any() and not toxic[~use].all() else np.ones(len(texts), bool)
    field.scale, field.offset = _logistic(x[held], toxic[held].astype(float))
    return field


def evidence(p: np.ndarray, w: Words | Sample) -> np.ndarray:
    """Log of the summed evidence -p log(1-p), of each text: near-certain tokens count, many faint ones don't add up."""
    loss = np.concatenate([[0.0], np.cumsum(-p * np.log1p(-np.minimum(p, 1 - 1e-9)))])
    return np.log(np.maximum(loss[w.first + w.count] - loss[w.first], 0) + 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge; classes weigh as they come."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((y - p) * x).sum() - 0.05 * a, (y - p).sum() - 0.05 * b])
        k = np.array([[(h * x * x).sum() + 0.05, (h * x).sum()], [(h * x).sum(), h.sum() + 0.05]])
        d = np.linalg.solve(k, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
        if abs(d).max() < 1e-6:
            break
    return max(a, 0.0), b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 2400, max_chars: int = 20_000, fit_docs: int = 800) -> Field:
    """Train on labelled rows that are not held out.

    At most max_docs / 2 documents of either label, of at most max_chars
    characters, taken by the hash of their id: these mark the words and give the
    document's logistic function. The field itself is fitted on the first
    fit_docs of them. The bounds do not depend on the size of the corpus. Null
    ids, texts and labels are no training rows.
    """
    l = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_k")).agg(F.max("toxic").alias("_y"))
    l = l.where(~held_out(F.col("_k")))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("_k"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # the ids are chosen before any text moves
    ids = d.where((F.length("_text") <= max_chars) & ~held_out(F.col("_k"))).select("_k").join(l, "_k").distinct()
    chosen = [ids.where(f"_y {op} 1").orderBy(F.xxhash64("_k"), "_k").limit(max_docs // 2) for op in (">=", "<")]
    few = chosen[0].unionByName(chosen[1]).collect()
    y = {r[0]: r[1] >= 1 for r in few}
    if not y:
        return train([], np.zeros(0, bool))
    rows = d.where(F.col("_k").isin(list(y)) & (F.length("_text") <= max_chars)).select("_k", F.col("_text").alias("t")).collect()
    rank = {k: i for i, k in enumerate(y)}
    rows = sorted({r._k: r.t for r in sorted(rows, key=lambda r: r.t)}.items(), key=lambda kv: rank[kv[0]])
    return train([t for _, t in rows], np.array([y[k] for k, _ in rows], bool), fit_docs=fit_docs)


def _scores(raw: np.ndarray, offsets: np.ndarray, f: Field) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their probabilities, and the texts' scores."""
    w = Words(raw, offsets, WORDISH)
    p, _, _ = marginals(_emissions(f, features(w)) if len(w) else np.zeros(0), _starts(w), f)
    z = f.scale * evidence(p, w) + f.offset
    return w, p, 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", span_p: float = 0.5, spans: bool = True) -> DataFrame:
    """Score every text.

    Returns doc_id, score (0 to 1), spans: offending byte ranges [start, end)
    of the lower-cased UTF-8 text with their probability (tokens of at least
    span_p), a row for each input row.

    Null, empty and wordless texts get the score of no evidence. Rows are scored
    one by one, so nulls, ties and repeats of ids play no part; other columns are
    ignored; an empty table gives an empty result. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.trans, field.start, field.scale, field.offset))  # 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            for lo, hi, raw, offsets in lower_chunks(batch.column("_text"), CHUNK):
                w, p, scores = _scores(raw, offsets, f)
                out = [None] * (hi - lo)
                if spans:
                    for t in np.flatnonzero(p >= span_p):
                        r = w.row[t]
                        out[r] = out[r] or []
                        out[r].append({"start": int(w.start[t] - w.offsets[r]), "end": int(w.end[t] - w.offsets[r]), "p": float(p[t])})
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), pa.array(scores), pa.array([x or [] for x in out], kind)], names=["doc_id", "score", "spans"])

    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return df.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def drop_toxic(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all columns, that score below the threshold; one pass without a shuffle.

    Null, empty and wordless texts have the score of no evidence and stay, unless
    the base rate alone is above the threshold. Repeated rows and null ids are
    judged like any other; columns of any name and type pass through; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.bias, field.trans, field.start, field.scale, field.offset))  # 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*shared.value)
        for batch in batches:
            keep = np.concatenate([np.zeros(0, bool), *(_scores(raw, offsets, f)[2] < threshold for _, _, raw, offsets in lower_chunks(batch.column(text_col), CHUNK))])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
