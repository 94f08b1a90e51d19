"""Benchmark passages in documents, edits included.

An item of n words may differ from a passage by tau = max_edit * n word edits.
The CGK random walk embeds a window of q words in 3 q places: at step j it puts
out the word it stands on and moves on by a random bit of (j, word), and past
the window's end it puts out a blank. A few edits change few places, so
bit-sampling LSH, which takes some of the places as a key, again and again with
other walks, brings windows at a small edit distance together.

Walks over a whole item that is edited in a fifth of its words come apart for
good, so the item is embedded by parts: cut into tau // (e + 1) + 1 windows, at
least one holds no more than e of the edits, wherever the passage lies. From e
follow the odds that a repetition meets it (estimated on random windows), and
from those the repetitions that a target recall needs. For e = 0, the setting
used, the two windows are equal, so all places agree and one repetition finds
every passage within the edits. Windows of documents start at every word.

Candidates are sieved by the words they hold and verified exactly: the least
word edit distance between the item and any passage of the neighbourhood
(Sellers' algorithm) must be at most tau. Items too short for an edit have one
window, the whole item (its first WINDOW words).

One pass over the documents, no shuffle. The items' index is sent to the tasks
in blocks of bounded size: with more items there are more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalith.llm.keys import table
from stratalith.llm.words import CHUNK_BYTES, U64, WORDISH, Words, lower_chunks, mix

#: Words of items in one pass.
BLOCK_WORDS = 2_000_000
#: Candidates sieved at a time, words counted.
TILE = 1 << 20
#: Words an item may hold are marked by so many bits of the hash.
MARKS, SIEVE = U64((1 << 10) - 1), U64((1 << 18) - 1)


#: Words of a window at most, places of its embedding for each, and repetitions at most for a target recall.
WINDOW, STRETCH, MOST_REPEATS = 8, 3, 200


def walk(symbols: np.ndarray, at: np.ndarray, end: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the sampled places (ascending) of the embedding of each window [at, end)."""
    symbols = np.append(symbols, U64(0))
    end, at, key, want, mixed = end.astype(np.int32), at.astype(np.int32), np.zeros(len(at), U64), set(places.tolist()), symbols
    for j in range(int(places[-1]) + 1):
        if j % 64 == 0:
            mixed = mix(symbols, seed * 1_000_003 + j + 1)
        here = mixed[at]
        inside = at < end
        if j in want:
            key = (key + here * inside) * U64(0x9E3779B97F4A7C15)
            key ^= key >> U64(29)
        at = at + ((here >> U64(j % 64)) & inside).astype(np.int32)
    return key


def sampled(q: int, edits: int, rep: int) -> np.ndarray:
    """The places that make the key of a repetition: many where all have to agree, few where edits may change some."""
    n = STRETCH * q
    return np.sort(np.random.Generator(np.random.PCG64([q, edits, rep])).permutation(n)[: max(1, 2 * q if edits == 0 else n // (3 * edits + 3))])


def odds(q: int, edits: int, trials: int = 2000) -> float:
    """How often one repetition meets a window of q words with so many random edits, on random windows of unlike words."""
    if edits == 0:
        return 1.0
    rng, met = np.random.Generator(np.random.PCG64(q)), 0
    for t in range(trials):
        x = rng.integers(1, 1 << 62, q).tolist()
        y = list(x)
        for _ in range(edits):
            k, kind = int(rng.integers(0, max(1, len(y)))), int(rng.integers(0, 3))
            y[k : k + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        both = np.array(x + (y + rng.integers(1, 1 << 62, q).tolist())[:q], U64)
        a, b = walk(both, np.array([0, q]), np.array([q, 2 * q]), sampled(q, edits, t), t)
        met += bool(a == b)
    return met / trials


def repeats(q: int, edits: int, target: float) -> int:
    """Repetitions after which a window with so many edits has been met with the target's probability."""
    p = odds(q, edits)
    if p >= 1:
        return 1
    return MOST_REPEATS if p <= 0 else min(MOST_REPEATS, int(np.ceil(np.log(1 - target) / np.log(1 - p))))


class Index:
    """The items with their edits and, for each length of window, the windows' keys and owners in each repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edit: float, window_edits: int = 0, target: float = 0.99):
        self.items, self.size = items, np.array([len(w) for _, w in items])
        self.budget = np.array([int(max_edit * len(w)) for _, w in items])
        self.seen = np.zeros((len(items), int(MARKS) + 1), bool)
        windows: dict[tuple[int, int], list] = {}
        for i, (_, w) in enumerate(items):
            self.seen[i, (w & MARKS).astype(np.int64)] = True
            n, tau = len(w), int(self.budget[i])
            parts, edits = tau // (window_edits + 1) + 1, min(tau, window_edits)
            q = min(n // parts, WINDOW * (edits + 1))
            windows.setdefault((q, edits), []).append((np.arange(parts) * n // parts, i))
        self.windows = []
        for (q, edits), some in sorted(windows.items()):
            item, off = (np.concatenate(x) for x in zip(*((np.full(len(o), i), o) for o, i in some)))
            begin, flat = np.cumsum([0] + [len(w) for _, w in items]), np.concatenate([w for _, w in items])
            for rep in range(repeats(q, edits, target)):
                key = walk(flat, begin[item] + off, begin[item] + off + q, sampled(q, edits, rep), rep)
                order, sieve = np.argsort(key, kind="stable"), np.zeros(int(SIEVE) + 1, bool)
                sieve[key & SIEVE] = True
                self.windows.append((q, sampled(q, edits, rep), rep, key[order], item[order], off[order], sieve))

    def candidates(self, w: Words, h: np.ndarray) -> np.ndarray:
        """Rows of (text, item, word where it would start) in ascending order, no row twice."""
        marks, out = (h & MARKS).astype(np.int64), [np.zeros((0, 3), np.int64)]
        start, after = np.arange(len(h)), (w.first + w.count)[w.row]
        for q, places, rep, keys, items, offsets, sieve in self.windows:
            key = walk(h, start, np.minimum(start + q, after), places, rep)
            hit = np.flatnonzero(sieve[key & SIEVE])
            lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total = np.cumsum(n)
            width = int((self.size + 2 * self.budget).max())
            step = max(1, TILE // width)
            for begin in range(0, int(total[-1]) if len(total) else 0, step):
                k = np.arange(begin, min(begin + step, int(total[-1])))
                at = np.searchsorted(total, k, "right")
                own = lo[at] + k - (total[at] - n[at])
                begin_, row, item = hit[at] - offsets[own], w.row[hit[at]], items[own]
                # edits leave n - tau of the item's words in place
                from_ = np.maximum(begin_ - self.budget[item], w.first[row])
                to = np.minimum(begin_ + self.size[item] + self.budget[item], w.first[row] + w.count[row])
                place = from_[:, None] + np.arange(width)
                held = self.seen[item[:, None], marks[np.minimum(place, len(h) - 1)]] & (place < to[:, None])
                good = held.sum(axis=1) >= self.size[item] - self.budget[item]
                out.append(np.unique(np.stack([row[good], item[good], begin_[good]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any passage of the text, and where the best passage ends."""
    n = len(text)
    row, step = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    for i, x in enumerate(item.tolist()):
        new = np.empty(n + 1, np.int32)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != U64(x)), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    end = int(np.argmin(row))
    return int(row[end]), end


def item_words(text: str) -> np.ndarray:
    """Hashes of the words of a text, in lower case."""
    _, _, raw, offsets = next(lower_chunks(pa.array([text], pa.string()), CHUNK_BYTES))
    return Words(raw, offsets, WORDISH).hashes()


def make_classes(items: list[tuple[int, str]], max_edit: float = 0.2, min_words: int = 5, window_edits: int = 0, target: float = 0.99) -> list[Index]:
    """items: id, text. Those of under min_words words are left out: they name no passage (set 1 to match them as whole word sequences)."""
    if not 0 <= max_edit < 1:
        raise ValueError("max_edit: from 0 to below 1")
    coded = [(i, w) for i, t in items if len(w := item_words(t)) >= max(1, min_words)]
    return [Index(coded, max_edit, window_edits, target)] if coded else []


def search(w: Words, classes: list[Index]) -> list[tuple[int, int, int, int]]:
    """(text row, item id, edits, first word) of every item found, the best place in each text."""
    h, found = w.hashes(), {}
    first, after = w.first.tolist(), (w.first + w.count).tolist()
    for c in classes:
        rows = c.candidates(w, h)
        if not len(rows):
            continue
        n, tau = c.size[rows[:, 1]], c.budget[rows[:, 1]]
        # places whose neighbourhoods touch are searched as one
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2]) > n[1:] + 2 * tau[1:])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(rows)) - 1
        for (row, i, start), end_at in zip(rows[at].tolist(), rows[last, 2].tolist()):
            (item_id, item), tau = c.items[i], int(c.budget[i])
            n = len(item)
            lo, hi = max(first[row], start - tau), min(after[row], end_at + n + tau)
            part = h[lo:hi]
            if np.isin(item, part).sum() < n - tau:
                continue
            d, end = passage_distance(item, part)
            best = found.get((row, item_id))
            if d <= tau and (best is None or d < best[0]):
                found[row, item_id] = (d, lo + max(0, end - n))
    return [(r, i, d, at - int(w.first[r])) for (r, i), (d, at) in found.items()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edit: float = 0.2, min_words: int = 5) -> DataFrame:
    """Every (document, item) where the document holds the item within max_edit of its words.

    Words are runs of letters, digits and non-ASCII characters, in lower case.
    Returns doc_id, item_id, n_edits, first_word (of the best place found).

    Null texts hold nothing; null item texts are no items; items of under
    min_words words are left out. A null document id comes back null, a null
    item id too. Repeated rows are each reported; equal items of different ids
    are each reported. Other columns are ignored. Empty tables give no rows.
    """
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = None
    for classes in item_blocks(items, item_id, item_text, max_edit, min_words):
        part = df.mapInArrow(_pass(df, classes), "doc_id long, item_id long, n_edits int, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def item_blocks(items: DataFrame, item_id: str = "item_id", item_text: str = "text", max_edit: float = 0.2, min_words: int = 5) -> Iterator[list[Index]]:
    """The benchmark's index, a block of about BLOCK_WORDS words at a time; one empty index if there are no items."""
    it = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null")
    block, size, some = [], 0, False
    for r in it.toLocalIterator():
        block.append((r.i, r.t))
        size += r.t.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield make_classes(block, max_edit, min_words)
            block, size, some = [], 0, True
    if block or not some:
        yield make_classes(block, max_edit, min_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", max_edit: float = 0.2, min_words: int = 5) -> DataFrame:
    """The rows of docs, with all columns, that hold no item; one pass without a shuffle for each block of items.

    Null and empty texts hold nothing and stay, as do all rows where there are
    no items (null item texts are none). Repeated rows and null ids are judged
    like any other. Columns of any name and type pass through. An empty table
    gives an empty result.
    """

    def keeper(classes: list[Index]):
        shared = docs.sparkSession.sparkContext.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, raw, offsets in lower_chunks(batch.column(text_col), CHUNK_BYTES):
                    w = Words(raw, offsets, WORDISH)
                    if len(w):
                        keep[[lo + r for r, *_ in search(w, shared.value)]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs
    for classes in item_blocks(items, max_edit=max_edit, min_words=min_words):
        out = out.mapInArrow(keeper(classes), docs.schema)
    return out


def _pass(df: DataFrame, classes: list[Index]):
    shared = df.sparkSession.sparkContext.broadcast(classes)  # at most BLOCK_WORDS words, their pieces and sieves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets in lower_chunks(batch.column("_text"), CHUNK_BYTES):
                w = Words(raw, offsets, WORDISH)
                if len(w) and (got := search(w, shared.value)):
                    row, item, d, at = zip(*got)
                    yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array([lo + r for r in row])), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(at, pa.int64())], names=["doc_id", "item_id", "n_edits", "first_word"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """A row for each contaminated document: its items (short ones too, as whole word sequences), and the fewest edits."""
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("n_edits").cast("long").alias("least_edits"))
