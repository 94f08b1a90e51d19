"""String functions as Column expressions. Positions count characters; size() counts bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def regex_replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def matches(c: Column, pattern: str) -> Column:
    """Whether the whole string matches."""
    return c.rlike(f"^(?:{pattern})$")


def extract(c: Column, pattern: str, groups: int) -> Column:
    """Array of the groups of the first match; null without one."""
    return F.when(c.rlike(pattern), F.array(*(F.regexp_extract(c, pattern, g) for g in range(1, groups + 1))))


def split(c: Column, sep: str | None = None, limit: int = -1) -> Column:
    """By a literal separator; without one by runs of white space, empty parts left out."""
    if sep is None:
        return F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.split(c, "\\Q" + sep + "\\E", limit + 1 if limit >= 0 else -1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def count(c: Column, sub: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def find(c: Column, sub: str, start: int = 0) -> Column:
    """First place from `start` on, -1 if there is none."""
    return F.locate(sub, c, start + 1) - 1


def rfind(c: Column, sub: str) -> Column:
    at = F.locate(sub[::-1], F.reverse(c)) - 1
    return F.when(at < 0, -1).otherwise(F.length(c) - at - len(sub))


def index(c: Column, sub: str) -> Column:
    """find() that is an error where there is none."""
    at = find(c, sub)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def swapcase(c: Column) -> Column:
    """Of ASCII letters."""
    return F.translate(c, _UP + _LOW, _LOW + _UP)


def char_at(c: Column, i: int) -> Column:
    return F.substring(c, F.lit(i + 1) if i >= 0 else F.length(c) + i + 1, F.lit(1))


def slice_(c: Column, start: int | None = None, end: int | None = None, step: int = 1) -> Column:
    n = F.length(c)
    at = lambda i, default: default if i is None else F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo, hi = at(start, F.lit(0)), F.least(at(end, n), n)
    part = F.substring(c, lo + 1, F.greatest(hi - lo, F.lit(0)))
    if step == 1:
        return part
    letters = F.split(part, "")
    return F.concat_ws("", F.filter(letters, lambda x, i: i % step == 0))


def repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def size(c: Column) -> Column:
    return F.octet_length(c)


def data_as_vector(c: Column) -> Column:
    """The bytes as integers."""
    h = F.hex(F.encode(c, "utf-8"))
    return F.transform(F.filter(F.split(F.regexp_replace(h, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def sha1(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def format_(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def center(c: Column, width: int, fill: str = " ") -> Column:
    gap = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    left = F.floor(gap / 2 + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), (gap - left).cast("int")))


def ljust(c: Column, width: int, fill: str = " ") -> Column:
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(fill))


def rjust(c: Column, width: int, fill: str = " ") -> Column:
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(fill))


def zfill(c: Column, width: int) -> Column:
    sign = F.when(c.rlike("^[+-]"), F.substring(c, 1, 1)).otherwise("")
    rest = F.substring(c, F.length(sign) + 1, F.length(c))
    return F.concat(sign, rjust_by(rest, F.lit(width) - F.length(sign), "0"))


def rjust_by(c: Column, width: Column, fill: str) -> Column:
    return F.concat(F.repeat(F.lit(fill), F.greatest(width - F.length(c), F.lit(0))), c)


def partition(c: Column, sep: str) -> Column:
    at = find(c, sep)
    none = F.array(c, F.lit(""), F.lit(""))
    return F.when(at < 0, none).otherwise(F.array(F.substring(c, F.lit(1), at), F.lit(sep), F.substring(c, at + 1 + len(sep), F.length(c))))


def rpartition(c: Column, sep: str) -> Column:
    at = rfind(c, sep)
    none = F.array(F.lit(""), F.lit(""), c)
    return F.when(at < 0, none).otherwise(F.array(F.substring(c, F.lit(1), at), F.lit(sep), F.substring(c, at + 1 + len(sep), F.length(c))))


def splitlines(c: Column) -> Column:
    p = F.split(c, r"\r\n|\n|\r")
    return F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_alnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]+$")


def is_space(c: Column) -> Column:
    return c.rlike(r"^\s+$")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_lower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def title(c: Column) -> Column:
    return F.initcap(c)


def split_regex(c: Column, pattern: str) -> Column:
    return F.split(c, pattern)


def split_tuple(c: Column, sep: str, n: int) -> Column:
    """The first n parts as fields _0, _1, ...; missing ones are null."""
    p = split(c, sep)
    return F.struct(*(F.get(p, i).alias(f"_{i}") for i in range(n)))


def rsplit(c: Column, sep: str, limit: int) -> Column:
    """At most `limit` splits, from the right."""
    p = split(c, sep)
    cut = F.greatest(F.size(p) - limit, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(p, F.lit(1), cut), sep)), F.slice(p, cut + 1, F.greatest(F.size(p) - cut, F.lit(0))))


def rindex(c: Column, sub: str) -> Column:
    """rfind() that is an error where there is none."""
    at = rfind(c, sub)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def join(sep: str, parts: Column) -> Column:
    return F.array_join(parts, sep)


def contains(c: Column, sub: str) -> Column:
    return c.contains(sub)


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def escaped(c: Column) -> Column:
    """Backslashes, quotes, new lines, tabs and carriage returns as escapes."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def hex_digest(words: Column) -> Column:
    """Eight lower-case hex digits for each 32-bit word of an array."""
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def bytes_as_string(values: Column) -> Column:
    """The text whose UTF-8 bytes an array of integers holds."""
    return F.decode(F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")), "utf-8")


def encode(c: Column, charset: str = "utf-8") -> Column:
    return F.encode(c, charset)


def decode(c: Column, charset: str = "utf-8") -> Column:
    return F.decode(c, charset)


def expandtabs(c: Column, size: int = 8) -> Column:
    """Tabs become blanks up to the next multiple of size, counted in each line."""
    def line(text: Column) -> Column:
        cells = F.split(text, "\t")
        wide = F.transform(F.slice(cells, F.lit(1), F.size(cells) - 1), lambda x: F.concat(x, F.repeat(F.lit(" "), (F.lit(size) - F.length(x) % size).cast("int"))))
        return F.concat(F.array_join(wide, ""), F.element_at(cells, -1))

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def is_title(c: Column) -> Column:
    """Whether every run of letters starts with an upper-case letter and goes on in lower case, and there is one."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"\p{L}\p{Lu}|(?<!\p{L})\p{Ll}")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def translate(c: Column, old: str, new: str) -> Column:
    return F.translate(c, old, new)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
