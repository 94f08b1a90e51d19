"""Array, map and tuple functions, distances and norms over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def get(a: Column, i: int) -> Column:
    """Element by position, negative from the end; an error outside."""
    return F.element_at(a, i + 1 if i >= 0 else i)


def slice_(a: Column, start: int = 0, end: int | None = None, step: int = 1) -> Column:
    n = F.size(a)
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo, hi = at(start), n if end is None else F.least(at(end), n)
    part = F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))
    return part if step == 1 else F.filter(part, lambda x, i: i % step == 0)


def index(a: Column, v) -> Column:
    """First position of the value, an error without one."""
    at = F.array_position(a, v)
    return F.when(at == 0, F.raise_error(F.lit("value not found"))).otherwise(at - 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(a, n))


def take_while(a: Column, p) -> Column:
    bad = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), False)
    return F.when(bad == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int")))


def drop_while(a: Column, p) -> Column:
    bad = F.array_position(F.transform(a, lambda x: F.coalesce(p(x), F.lit(False))), False)
    return F.when(bad == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, bad.cast("int"), F.size(a)))


def span(a: Column, p) -> Column:
    return F.struct(take_while(a, p).alias("taken"), drop_while(a, p).alias("rest"))


def zip_shortest(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def cycle(a: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(a, (i % F.size(a) + 1).cast("int")))


def _diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.abs(x.cast("double"))))


def l2_squared(a: Column) -> Column:
    return total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def l2(a: Column) -> Column:
    return F.sqrt(l2_squared(a))


def l_infinity(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def lp(a: Column, p: float) -> Column:
    return F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x.cast("double")), F.lit(float(p))))), F.lit(1.0 / p))


def distance(a: Column, b: Column, kind: str = "l2", p: float = 2.0) -> Column:
    if kind == "cosine":
        return 1 - dot(a, b) / (l2(a) * l2(b))
    return {"l1": l1, "l2": l2, "l2_squared": l2_squared, "l_infinity": l_infinity, "lp": lambda d: lp(d, p)}[kind](_diff(a, b))


def trapz(y: Column, x: Column | None = None) -> Column:
    """Integral by the trapezoid rule; places one apart without x."""
    n = F.size(y) - 1
    mean = F.zip_with(F.slice(y, F.lit(1), n), F.slice(y, F.lit(2), n), lambda a, b: (a + b) / 2)
    if x is None:
        return total(mean)
    step = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: b - a)
    return dot(mean, step)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


# ---------------------------------------------------------------- vectors


def build(count: Column | int, f=None, keep=None, low: int = 0) -> Column:
    """f(i) for i from low on below low + count, of those that `keep` holds for."""
    n = count if isinstance(count, Column) else F.lit(count)
    a = F.filter(F.sequence(F.lit(low).cast("long"), n.cast("long") + low), lambda i: i < n + low)
    a = a if keep is None else F.filter(a, keep)
    return a if f is None else F.transform(a, f)


def uniform(count: Column | int, value) -> Column:
    return F.array_repeat(value if isinstance(value, Column) else F.lit(value), count)


def zip_with(f, *arrays: Column) -> Column:
    """f over parallel vectors, as long as the shortest."""
    n = F.least(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    zipped = F.arrays_zip(*(F.slice(a, F.lit(1), n).alias(f"_{i}") for i, a in enumerate(arrays)))
    return F.transform(zipped, lambda t: f(*(t[f"_{i}"] for i in range(len(arrays)))))


def split_when(a: Column, p) -> Column:
    """Chunks that end before each element for which p holds; nothing is dropped."""
    def step(chunks: Column, x: Column) -> Column:
        last = F.element_at(chunks, -1)
        return F.when(p(x) | (F.size(chunks) == 0), F.concat(chunks, F.array(F.array(x)))).otherwise(F.concat(F.slice(chunks, F.lit(1), F.size(chunks) - 1), F.array(F.concat(last, F.array(x)))))

    # elements are of long type: the accumulator's type has to be known beforehand
    return F.aggregate(F.transform(a, lambda x: x.cast("long")), F.array().cast("array<array<bigint>>"), step)


def append(a: Column, v) -> Column:
    return F.array_append(a, v)


def iterate(f, start: Column, n: int) -> Column:
    """f(f(...f(start))), n times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda x, _: f(x)) if n else start


def for_all(a: Column, p) -> Column:
    return F.forall(a, p)


def exists(a: Column, p) -> Column:
    return F.exists(a, p)


def filter_not(a: Column, p) -> Column:
    return F.filter(a, lambda x: ~p(x))


def star_map(f, tuples: Column, n: int) -> Column:
    """f over the fields _0, _1, ... of each tuple."""
    return F.transform(tuples, lambda t: f(*(t[f"_{i}"] for i in range(n))))


def zip_apply(functions: list, a: Column) -> Column:
    """Each function over the element of its place; what is left over on either side is dropped."""
    return F.filter(F.array(*(F.when(F.size(a) > i, f(F.get(a, i))) for i, f in enumerate(functions))), lambda x: x.isNotNull())


def to_string(a: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in lexicographic order, a shorter prefix first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


# ---------------------------------------------------------------- dictionaries


def put(m: Column, key: Column, value: Column) -> Column:
    """With the pair, in place of an older one of its key."""
    return F.map_concat(remove(m, key), F.create_map(key, value))


def remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def pair_at(m: Column, i: int) -> Column:
    """The i-th pair in key order."""
    return F.get(F.array_sort(F.map_entries(m)), i)


def keys(m: Column) -> Column:
    """In order."""
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """In the order of the keys."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


# ---------------------------------------------------------------- tuples: arrays of one type, with fields by position


def as_tuple(a: Column, n: int) -> Column:
    return F.struct(*(F.get(a, i).alias(f"_{i}") for i in range(n)))


def join_tuples(a: Column, b: Column, n: int, m: int) -> Column:
    return F.struct(*(a[f"_{i}"].alias(f"_{i}") for i in range(n)), *(b[f"_{i}"].alias(f"_{n + i}") for i in range(m)))


def tuple_slice(t: Column, low: int, high: int) -> Column:
    return F.struct(*(t[f"_{i}"].alias(f"_{i - low}") for i in range(low, high)))


# ---------------------------------------------------------------- arrays of numbers with a shape: row-major values


def transpose(a: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda k: F.element_at(a, ((k % rows) * columns + F.floor(k / rows) + 1).cast("int")))


def reshape(a: Column, rows: int, columns: int) -> Column:
    """A list of rows; the size has to be right."""
    rows_ = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(a, r * columns + 1, F.lit(columns)))
    return F.when(F.size(a) == rows * columns, rows_).otherwise(F.raise_error(F.lit("the size does not fit the shape")))


def eye(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.when(k % (n + 1) == 0, 1.0).otherwise(0.0))


# ---------------------------------------------------------------- complex numbers: struct(re, im)


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_div(a: Column, b: Column) -> Column:
    n = sq_norm(b)
    p = c_mul(a, conj(b))
    return complex_(p["re"] / n, p["im"] / n)


def sq_norm(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def conj(a: Column) -> Column:
    return complex_(a["re"], -a["im"])


def phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def polar(a: Column) -> Column:
    """struct(r, phi)."""
    return F.struct(F.sqrt(sq_norm(a)).alias("r"), phase(a).alias("phi"))


def rect(r: Column, phi: Column) -> Column:
    return complex_(r * F.cos(phi), r * F.sin(phi))


def c_is_nan(a: Column) -> Column:
    return F.isnan(a["re"]) | F.isnan(a["im"])


def c_is_infinite(a: Column) -> Column:
    return (F.abs(a["re"]) == float("inf")) | (F.abs(a["im"]) == float("inf"))
