"""Assertions over frames and values, and plots as plain data (kind, series, labels) for any renderer."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame

from stratalith.operators.shapes import fetch

POINTS = 10_000


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


def assert_frames_equal(a: DataFrame, b: DataFrame, names: bool = True) -> None:
    """Equal rows, whatever their order; NaN equals NaN. Without `names` columns count by position."""
    if names and a.columns != b.columns:
        raise AssertionError(f"columns {a.columns} and {b.columns}")
    if len(a.columns) != len(b.columns):
        raise AssertionError(f"{len(a.columns)} and {len(b.columns)} columns")
    b = b.toDF(*a.columns)
    for more, side in ((a.exceptAll(b), "first"), (b.exceptAll(a), "second")):
        row = more.first()
        if row is not None:
            raise AssertionError(f"only in the {side}: {row}")


def assert_series_equal(a: Sequence, b: Sequence) -> None:
    if len(a) != len(b) or not all(map(_same, a, b)):
        raise AssertionError(f"{a} and {b}")


def assert_rows_equal(a, b) -> None:
    """Values and names."""
    if a.__fields__ != b.__fields__:
        raise AssertionError(f"names {a.__fields__} and {b.__fields__}")
    assert_series_equal(tuple(a), tuple(b))


def assert_equal(a, b) -> None:
    if not _same(a, b):
        raise AssertionError(f"{a!r} is not {b!r}")


def assert_not_equal(a, b) -> None:
    if _same(a, b):
        raise AssertionError(f"both are {a!r}")


def assert_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    """Numbers, or sequences of them element by element."""
    pairs = zip(a, b, strict=True) if isinstance(a, Sequence) else [(a, b)]
    for x, y in pairs:
        if not (_same(float(x), float(y)) or abs(x - y) <= atol + rtol * abs(y)):
            raise AssertionError(f"{x} is not close to {y}")


# ---------------------------------------------------------------- plots


def _points(df: DataFrame, *columns: str) -> list[list]:
    return [list(c) for c in zip(*(tuple(r) for r in sorted(fetch(df.select(*columns), POINTS))))] or [[] for _ in columns]


def _plot(kind: str, **data) -> dict:
    return {"kind": kind, **data}


def line_plot(df: DataFrame, x: str, *ys: str) -> dict:
    xs, *rest = _points(df, x, *ys)
    return _plot("line", x=xs, series=dict(zip(ys, rest)))


def scatter_plot(df: DataFrame, x: str, y: str) -> dict:
    xs, values = _points(df, x, y)
    return _plot("scatter", x=xs, y=values)


def bar_plot(df: DataFrame, label: str, value: str) -> dict:
    labels, values = _points(df, label, value)
    return _plot("bar", labels=labels, values=values)


def histogram_plot(df: DataFrame, value: str, bins: int = 20) -> dict:
    """Counts by equal parts of the range; only they are fetched."""
    from pyspark.sql import functions as F

    lo, hi = df.agg(F.min(value), F.max(value)).first()
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))
    counts = dict(df.where(F.col(value).isNotNull()).groupBy(at).count().collect())
    return _plot("histogram", edges=[lo + k * width for k in range(bins + 1)], counts=[counts.get(k, 0) for k in range(bins)])


def surface_plot(df: DataFrame, x: str, y: str, z: str) -> dict:
    xs, ys, zs = _points(df, x, y, z)
    return _plot("surface", x=xs, y=ys, z=zs)


def sparkline(values: Sequence[float], most: int = 200) -> str:
    """A line of blocks; of more than `most` points every n-th is shown."""
    values = values[:: max(1, -(-len(values) // most))]
    lo, hi = min(values), max(values)
    return "".join("▁▂▃▄▅▆▇█"[int((v - lo) / (hi - lo) * 7.999) if hi > lo else 0] for v in values)


def bmp(pixels: Sequence[Sequence[tuple[int, int, int]]]) -> bytes:
    """Rows of (red, green, blue), from the top, as an uncompressed 24-bit bitmap."""
    h, w = len(pixels), len(pixels[0])
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + pad for row in reversed(pixels))
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def layout(kind: str, *panes) -> dict:
    """dashboard, stack, split or pane around plots or other layouts."""
    if kind not in ("dashboard", "stack", "split", "pane"):
        raise ValueError("layout: dashboard, stack, split or pane")
    return {"layout": kind, "panes": list(panes)}


def grid(rows: Sequence[Sequence], lines: bool = True) -> str:
    """A text table."""
    cells = [[str(v) for v in r] for r in rows]
    wide = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    body = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, wide)) + "|" for r in cells]
    return "\n".join([rule, *(x for b in body for x in (b, rule))] if lines else body)
