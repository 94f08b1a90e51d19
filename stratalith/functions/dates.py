"""Dates, times and durations. Instants have no zone (timestamp_ntz); durations are whole microseconds (long)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = {"microseconds": 1, "milliseconds": 1000, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6, "weeks": 7 * 86400 * 10**6, "years": 365 * 86400 * 10**6}
#: strptime codes that have a pattern letter; others are refused.
CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "y": "yy"}


def pattern(fmt: str) -> str:
    out, i = "", 0
    letters = ""  # literal letters stand in one pair of quotes: two pairs in a row would be a quote
    while i < len(fmt):
        if fmt[i].isalpha() and fmt[i] != "%":
            letters += fmt[i]
            i += 1
            continue
        out, letters = out + (f"'{letters}'" if letters else ""), ""
        if fmt[i] == "%":
            if fmt[i + 1] not in CODES:
                raise ValueError(f"%{fmt[i + 1]} is not supported")
            out += CODES[fmt[i + 1]]
            i += 2
        else:
            out += "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return out + (f"'{letters}'" if letters else "")


def make(y, m=1, d=1, h=0, mi=0, s=0) -> Column:
    return F.make_timestamp_ntz(*(x if isinstance(x, Column) else F.lit(x) for x in (y, m, d, h, mi, s)))


def strptime(c: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(c, F.lit(pattern(fmt)))


def strftime(c: Column, fmt: str) -> Column:
    return F.date_format(c, pattern(fmt))


def micros(c: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(c.cast("timestamp"))


def from_seconds(c: Column) -> Column:
    return F.timestamp_micros((c * 10**6).cast("long")).cast("timestamp_ntz")


def plus(c: Column, duration: Column) -> Column:
    return F.timestamp_micros(micros(c) + duration).cast("timestamp_ntz")


def between(a: Column, b: Column) -> Column:
    """Duration a - b."""
    return micros(a) - micros(b)


def total(duration: Column, unit: str) -> Column:
    """Whole units in a duration, cut off towards zero."""
    return (F.signum(duration) * F.floor(F.abs(duration) / F.lit(MICRO[unit]))).cast("long")


def of(n: Column, unit: str) -> Column:
    return n.cast("long") * F.lit(MICRO[unit]).cast("long")


def field(duration: Column, unit: str) -> Column:
    """hours, minutes, seconds or fractional (microseconds) as on a clock."""
    big = {"hours": None, "minutes": "hours", "seconds": "minutes", "microseconds": "seconds"}[unit]
    d = F.abs(duration)
    return F.floor((d if big is None else d % F.lit(MICRO[big])) / F.lit(MICRO[unit])).cast("long")


def day_of_week(c: Column) -> Column:
    """The English name."""
    return F.date_format(c, "EEEE")


def time_of_day(c: Column) -> Column:
    return F.pmod(micros(c), F.lit(MICRO["days"]))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss")


def iso_extended(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(c: Column) -> Column:
    """yyyyMMddTHHmmss."""
    return F.to_timestamp_ntz(c, F.lit("yyyyMMdd'T'HHmmss"))


def from_string(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss, with a fraction or without a time of day."""
    return c.cast("timestamp_ntz")


def from_date_string(c: Column) -> Column:
    """yyyy-MM-dd with - / or a blank between the parts."""
    return F.to_timestamp_ntz(F.translate(c, "/ ", "--"), F.lit("yyyy-MM-dd"))


def from_undelimited(c: Column) -> Column:
    """yyyyMMdd."""
    return F.to_timestamp_ntz(c, F.lit("yyyyMMdd"))


def epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def ratio(a: Column, b: Column) -> Column:
    """One duration in terms of another."""
    return a.cast("double") / b.cast("double")


def is_negative(duration: Column) -> Column:
    return duration < 0


def fractional(duration: Column) -> Column:
    """Microseconds past the whole second."""
    return F.abs(duration) % F.lit(MICRO["seconds"])


def duration_from_string(c: Column) -> Column:
    """[-]HH:mm:ss[.ffffff]."""
    part = lambda i: F.regexp_extract(c, r"^(-?)(\d+):(\d+):(\d+)(?:\.(\d{1,6}))?$", i)
    size = part(2).cast("long") * MICRO["hours"] + part(3).cast("long") * MICRO["minutes"] + part(4).cast("long") * MICRO["seconds"] + F.rpad(part(5), 6, "0").cast("long")
    return F.when(part(1) == "-", -size).otherwise(size)


def duration_from_float(seconds: Column) -> Column:
    return F.round(seconds * MICRO["seconds"]).cast("long")


#: Digits after the second that a duration keeps.
FRACTIONAL_DIGITS = 6


def float_seconds(c: Column) -> Column:
    return micros(c) / F.lit(float(MICRO["seconds"]))
