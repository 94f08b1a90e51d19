"""Vectorised word scanning and hashing over Arrow string buffers.

All helpers work on the UTF-8 bytes of a whole chunk of documents at once, so
the cost per document is a fraction of a numpy call. Hash collisions: a word
has a 64-bit hash, a word sequence two independent 64-bit hashes (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
OTHER_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
CHUNK_BYTES = 1 << 20

#: Words are runs of anything but the six ASCII white-space bytes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters and digits and of non-ASCII bytes.
WORDISH = np.zeros(256, bool)
WORDISH[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for b in (self.base, self.inverse):
                a = np.full(n, b, U64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=U64))
            if n > 4 * CHUNK_BYTES:  # one giant text: not kept
                return out[0], out[1]
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _SEQ_POWERS = _Powers(0x9E3779B97F4A7C15), (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes with the bytes and offsets of their lower-cased texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for lo, hi in chunks(buffers(column)[1], limit):
        yield lo, hi, *buffers(pc.utf8_lower(column.slice(lo, hi - lo)))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the bytes [start, end) of each range, one of two independent ones."""
    up, down = (_BYTE_POWERS, _SEQ_POWERS[1])[lane].get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((BYTE_VALUES if lane == 0 else OTHER_VALUES)[raw] * up[:-1], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * down[start], lane)


class Words:
    """The words of consecutive texts: byte starts and ends, the text each is in, 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NON_SPACE):
        n = len(raw)
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        inside = letters[raw]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[cuts] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets[:-1])  # of each row
        self.count = np.diff(np.append(self.first, len(self.start)))

    def __len__(self) -> int:
        return len(self.start)

    def prefix_hasher(self):
        """A function from byte ends to the hash of the bytes from each word's start."""
        up, down = _BYTE_POWERS.get(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, U64)
        np.cumsum(BYTE_VALUES[self.raw] * up[:-1], dtype=U64, out=total[1:])
        base, scale = total[self.start], down[self.start]
        return lambda end, salt=0: mix((total[end] - base) * scale, salt)

    def hashes(self) -> np.ndarray:
        return self.prefix_hasher()(self.end)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each word on are in one text; as long as the list of words."""
        ok = np.zeros(len(self), bool)
        if len(self) >= k:
            ok[: len(self) - k + 1] = self.row[k - 1 :] == self.row[: len(self) - k + 1]
        return ok


def sequence_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k words from each position on (zero where fewer follow)."""
    n, out = len(h), np.zeros(len(h), U64)
    if n >= k:
        up, down = _SEQ_POWERS[lane].get(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(h, 0x51ED270B + lane) * up[:-1], dtype=U64, out=total[1:])
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1], k)
    return out


def sliding(x: np.ndarray, k: int, fn, fill) -> np.ndarray:
    """fn (np.minimum or np.maximum) over x[i:i+k]; past the end counts as `fill`."""
    out, width = x.copy(), 1
    while width < k:
        step = min(width, k - width)
        moved = np.full_like(out, fill)
        moved[: len(out) - step] = out[step:]
        out = fn(out, moved)
        width += step
    return out
