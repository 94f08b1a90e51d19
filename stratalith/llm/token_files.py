"""Token ids in bit-packed binary files.

Ids of all documents, in ascending id order, each document closed by an end
id, are stored in the fewest bits that hold the vocabulary, in blocks that
start on a byte, so any range of tokens is read by unpacking a few blocks
with numpy. One file for each partition of a range partitioning by id:

  8 bytes magic, u32 bits, u32 tokens a block
  the packed blocks, one after the other
  footer: i64 document ids, u64 first tokens (within the file), u64 block places
  u64 documents, u64 tokens, u64 blocks, u64 place of the footer, 8 bytes magic

Files are written under another name and renamed, so a repeated task leaves
the same file; a manifest with the number of tokens before each file is
written last. Nothing but one row a file comes to the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalith.llm.keys import NULL_ID, id_key, local_path, partitions, scratch, table
from stratalith.llm.words import U64, buffers, byte_range_hashes, chunks

MAGIC = b"STLTOK01"
BLOCK = 1 << 12
#: Pieces of text kept with their ids in a worker; beyond that pieces are encoded anew.
CACHE = 500_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of `bits` bits, least bit first, padded to a byte."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return data[: 2 * n].view("<u2").astype(np.uint32)
    if bits == 32:
        return data[: 4 * n].view("<u4").astype(np.uint32)
    flat = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class Writer:
    def __init__(self, path: str, bits: int, block: int = BLOCK):
        self.path, self.temp, self.bits, self.block = path, f"{path}.{uuid.uuid4().hex}", bits, block
        self.f = open(self.temp, "wb")
        self.f.write(MAGIC + np.array([bits, block], "<u4").tobytes())
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.places: list[int] = []
        self.rest, self.tokens = np.zeros(0, np.uint32), 0

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids in one array; lengths hold the ids of each."""
        self.docs.append(doc_ids.astype("<i8"))
        self.starts.append((self.tokens + np.concatenate([[0], np.cumsum(lengths)[:-1]])).astype("<u8"))
        self.tokens += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // self.block
        for k in range(full):
            self._put(self.rest[k * self.block : (k + 1) * self.block])
        self.rest = self.rest[full * self.block :]

    def _put(self, ids: np.ndarray) -> None:
        self.places.append(self.f.tell())
        self.f.write(pack(ids, self.bits))

    def close(self) -> int:
        if len(self.rest):
            self._put(self.rest)
        at, docs = self.f.tell(), np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        self.f.write(docs.tobytes() + (np.concatenate(self.starts) if self.starts else np.zeros(0, "<u8")).tobytes() + np.array(self.places, "<u8").tobytes())
        self.f.write(np.array([len(docs), self.tokens, len(self.places), at], "<u8").tobytes() + MAGIC)
        self.f.flush()
        os.fsync(self.f.fileno())
        self.f.close()
        os.replace(self.temp, self.path)
        return len(docs)


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        if self.data[:8].tobytes() != MAGIC or self.data[-8:].tobytes() != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block = (int(x) for x in self.data[8:16].view("<u4"))
        n, self.tokens, blocks, at = (int(x) for x in self.data[-40:-8].tobytes() and np.frombuffer(self.data[-40:-8].tobytes(), "<u8"))
        foot = self.data[at:-40].tobytes()
        self.docs = np.frombuffer(foot, "<i8", n)
        self.starts = np.append(np.frombuffer(foot, "<u8", n, 8 * n).astype(np.int64), self.tokens)
        self.places = np.append(np.frombuffer(foot, "<u8", blocks, 16 * n).astype(np.int64), at)

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Tokens [lo, hi) of the file."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block
        last = min((b + 1) * self.block, self.tokens)
        if self.block * self.bits % 8 == 0:  # whole blocks leave no padding: one piece
            out = unpack(np.ascontiguousarray(self.data[self.places[a] : self.places[b + 1]]), last - a * self.block, self.bits)
        else:
            each = [unpack(np.ascontiguousarray(self.data[self.places[k] : self.places[k + 1]]), min(self.block, self.tokens - k * self.block), self.bits) for k in range(a, b + 1)]
            out = np.concatenate(each)
        return out[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def piece_starts(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Places where a text may be cut without changing what the byte-level pre-tokenizer makes of it.

    No token of its pattern spans: a non-blank and a blank after it; a lone line
    break and its neighbours; a letter or digit and punctuation after it. Where
    a neighbour isn't surely of its kind (most of non-ASCII, control characters)
    nothing is cut, nor inside the strings of special tokens.
    """
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    latin = np.zeros(n, bool)  # the byte before ends a letter of U+00C0 to U+00FF
    latin[2:] = (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)
    next_ = _SOLID[after] | (after == 0xC3)
    prev = _SOLID[before] | latin
    cut = (raw == 0x20) & (prev | ((before >= 0x80) & next_))
    line = (raw == 0x0A) & prev & next_
    cut |= line
    cut[1:] |= line[:-1]
    cut |= (_ALNUM[before] | latin) & _SOLID[raw] & ~_ALNUM[raw]
    if special:
        data = raw.tobytes()
        for word in special:
            at = data.find(word)
            while at >= 0:
                cut[at + 1 : at + len(word)] = False
                at = data.find(word, at + 1)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """A tokenizer that encodes each distinct piece of text once.

    Texts are cut where that changes nothing (piece_starts); the library encodes
    every distinct piece, and what a text gives is the library's ids of its
    pieces in order. That holds for the plain byte-level pre-tokenizer without a
    normaliser; with any other, whole texts are encoded. Pieces are told apart by 128 bits of hash. At most CACHE
    pieces are kept; others are encoded for each chunk.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots: dict[int, int] = {}
        self.check, self.size = np.zeros(0, U64), np.zeros(0, np.int64)
        self.place, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @property
    def bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of consecutive texts, and how many each has."""
        rows = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if not self.cuts:
            return self._library([raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        start = piece_starts(raw, offsets, self.special)
        end = np.append(start[1:], len(raw))
        one, two = (byte_range_hashes(raw, start, end, lane) for lane in (0, 1))
        names, first, which = np.unique(one, return_index=True, return_inverse=True)
        check, get = two[first], self.slots.get
        slot = np.fromiter((get(x, -1) for x in names.tolist()), np.int64, len(names))
        known = np.flatnonzero(slot >= 0)
        if (two != check[which]).any() or (self.check[slot[known]] != check[known]).any():  # two pieces of one hash
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return self._library(texts)
        fresh = np.flatnonzero(slot < 0)
        size, place, pool = self.size, self.place, self.pool
        if len(fresh):
            data = raw.tobytes()
            ids, n = self._library([data[a:b].decode() for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist())])
            slot[fresh] = len(size) + np.arange(len(fresh))
            place = np.concatenate([place, len(pool) + np.cumsum(n) - n])
            size, pool = np.concatenate([size, n]), np.concatenate([pool, ids])
            if len(size) <= CACHE:
                self.size, self.place, self.pool = size, place, pool
                self.check = np.concatenate([self.check, check[fresh]])
                self.slots.update(zip(names[fresh].tolist(), slot[fresh].tolist()))
        n, at = size[slot][which], place[slot][which]
        total = int(n.sum())
        out = pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)]
        row = np.searchsorted(offsets, start, "right") - 1
        return out, np.bincount(row, n, rows).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, files: int | None = None) -> dict:
    """Write token files of `docs` under `path` (a folder all executors share) and return the manifest.

    Documents go in ascending id order; ties by text; null ids last. A null text
    counts as empty and has the end id alone. Repeated rows are each written.
    Other columns are ignored. An empty table gives no files.
    """
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    files = files or partitions(docs)
    df = docs.select(id_key(id_col).alias("_k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    # the second key splits an id that very many rows share
    df = df.repartitionByRange(files, F.col("_k"), F.xxhash64("_text")).sortWithinPartitions("_k", F.xxhash64("_text"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, enc, at = None, encoder(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            keys = np.asarray(batch.column("_k"))
            raw, offsets = buffers(batch.column("_text"))
            for lo, hi in chunks(offsets, 1 << 21):
                ids, n = enc.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = out or Writer(f"{folder}/part-{at:06d}.bin", enc.bits)
                out.add(keys[lo:hi], n + 1, np.insert(ids, np.cumsum(n), end))
        if out:
            n = out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"part-{at:06d}.bin"], "docs": [n], "tokens": [out.tokens]})

    rows = sorted(df.mapInArrow(run, "file string, docs long, tokens long").collect())
    manifest, before = [], 0
    for r in rows:
        manifest.append({"file": r.file, "docs": r.docs, "tokens": r.tokens, "start": before})
        before += r.tokens
    out = {"files": manifest, "tokens": before, "end": end}
    with open(f"{folder}/manifest.json.tmp", "w") as f:
        json.dump(out, f)
    os.replace(f"{folder}/manifest.json.tmp", f"{folder}/manifest.json")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens before the document in all files), n_tokens, ids (binary, little-endian u32), from the files."""
    folder = local_path(path)
    with open(f"{folder}/manifest.json") as f:
        files = json.load(f)["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                r, lo = Reader(f"{folder}/{name}"), 0
                while lo < len(r.docs):  # about a million tokens at a time
                    hi = max(lo + 1, int(np.searchsorted(r.starts, r.starts[lo] + (1 << 20), "right")) - 1)
                    data = r.range(int(r.starts[lo]), int(r.starts[hi])).astype("<u4")
                    cut = ((r.starts[lo : hi + 1] - r.starts[lo]) * 4).astype(np.int64)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut), pa.py_buffer(data)]).cast(pa.binary())
                    doc = pa.array(r.docs[lo:hi], mask=r.docs[lo:hi] == NULL_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(base + r.starts[lo:hi]), pa.array(np.diff(cut) // 4), ids], names=["doc_id", "start", "n_tokens", "ids"])
                    lo = hi

    rows = [(f["file"], f["start"]) for f in files]
    df = spark.createDataFrame(rows, "file string, start long")
    return df.repartition(max(1, len(rows)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """The ids' unsigned CRC-32 in place of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' token files to a fresh folder and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(encode_documents(spark, table(spark, sf_dir, "documents")))
