"""One query for each member of the string, date and mathematics families.

A family is a small table of functions, each with its DuckDB text, and a list of
members: the id, the function and the columns it is asked over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from stratalith.functions import arrays as Y, dates as D, mathfn as M, text as N
from stratalith.plans.catalog import listed, listed_sql, query, table

#: base: table, key, column over it in DuckDB and in Spark.
BASES = {
    "part": ("part", "p_partkey", "p_name", lambda: F.col("p_name")),
    "padded": ("part", "p_partkey", "'  ' || p_name || ' ' || chr(9)", lambda: F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t"))),
    "customer": ("customer", "c_custkey", "c_mktsegment || ' ' || c_name", lambda: F.concat_ws(" ", "c_mktsegment", "c_name")),
    "phrase": ("orders", "o_orderkey", "o_orderpriority || ' ' || o_orderstatus", lambda: F.concat_ws(" ", "o_orderpriority", "o_orderstatus")),
    "brand": ("part", "p_partkey", "p_brand", lambda: F.col("p_brand")),
    "unit": ("part", "p_partkey", "p_size / 60.0::DOUBLE", lambda: F.col("p_size") / F.lit(60.0)),
    "py": ("customer", "c_custkey", "(c_acctbal + 1001) / 11002", lambda: (F.col("c_acctbal") + 1001) / 11002),
    "scipy": ("supplier", "s_suppkey", "(s_acctbal + 1001) / 11002", lambda: (F.col("s_acctbal") + 1001) / 11002),
    "np": ("orders", "o_orderkey", "o_totalprice / 777777", lambda: F.col("o_totalprice") / 777777),
    "signed": ("customer", "c_custkey", "c_acctbal / 100", lambda: F.col("c_acctbal") / 100),
    "size": ("part", "p_partkey", "p_size::BIGINT", lambda: F.col("p_size").cast("long")),
    "when": ("orders", "o_orderkey", "o_orderdate", lambda: F.col("o_orderdate")),
    "ts": ("events", "event_id", "ts", lambda: F.col("ts")),
    "span": ("events", "event_id", "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')", lambda: D.between(F.col("ts"), F.expr("timestamp_ntz'2024-01-15'"))),
    "whole": ("lineitem", "l_orderkey, l_linenumber", "l_partkey", lambda: F.col("l_partkey")),
}


#: Members that give lists; they are compared as text.
LISTS = {
    "list": "O15 N3 N33 N61 N66 N67 N69 N70 Y17 Y18 Y22 Y62 Y64 N35 Y2 D24 F18 F19 F22 U4 U5 U6 Y1 Y3 Y7 Y8 Y9 Y10 Y12 Y34 Y36 Y37 Y41 Y42 Y43 Y44 Y45 Y46 Y47 Y48 Y50 Y14 Y19 Y63 Y24 Y27 Y30 Y31 Y53 Y55 Y60 Y75 Y77 Y97 Y93".split(),
    "floats": "M21 M22 Y81 Y82 Y87 Y88 Y89 Y90 Y91 Y92 Y94 Y95 Y96".split(), "nested": ["F23"], "nested_floats": ["Y83", "Y84"],
}
KIND = {i: kind for kind, ids in LISTS.items() for i in ids}


def member(name: str, base: str, sql: str, f, digits: int | None = None) -> None:
    """Register f over the base's column, beside the base's key; doubles rounded to `digits` (and no negative zero)."""
    source, keys, x_sql, x = BASES[base]
    y_sql, kind = sql.replace("{x}", "x"), KIND.get(name.split("_")[0])
    y_sql = listed_sql(y_sql, kind) if kind else y_sql
    y_sql = y_sql if digits is None else f"round(({y_sql})::DOUBLE, {digits}) + 0.0"

    @query(name, f"SELECT {keys}, {y_sql} AS y FROM (SELECT *, {x_sql} AS x FROM {source})")
    def _(s, d):
        y = listed(f(F.col("x")), kind) if kind else f(F.col("x"))
        keyed = table(s, d, source).select(*keys.split(", "), x().alias("x"))
        return keyed.select(*keys.split(", "), (y if digits is None else F.round(y.cast("double"), digits) + 0.0).alias("y"))


lit = F.lit

# ------------------------------------------------------------------------------ strings
SPLIT = "string_split({x}, ' ')"
FIND = "strpos({x}, '{s}')::INTEGER - 1"
RFIND = "CASE WHEN strpos({x}, '{s}') = 0 THEN -1 ELSE length({x})::INTEGER - strpos(reverse({x}), '{s}')::INTEGER END"
find_of, rfind_of = (lambda s: FIND.replace("{s}", s)), (lambda s: RFIND.replace("{s}", s))
TITLE = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
SWAP = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')"

#: name: DuckDB, Spark
STRINGS = {
    "matches": ("regexp_full_match({x}, '[A-Za-z]+ [A-Za-z0-9#. -]*')", lambda c: N.matches(c, "[A-Za-z]+ [A-Za-z0-9#. -]*")),
    "extract": ("CASE WHEN regexp_matches({x}, '([a-z]+) ([a-z]+)') THEN [regexp_extract({x}, '([a-z]+) ([a-z]+)', 1), regexp_extract({x}, '([a-z]+) ([a-z]+)', 2)] END", lambda c: N.extract(c, "([a-z]+) ([a-z]+)", 2)),
    "split_regex": ("array_to_string(regexp_split_to_array({x}, '[aeiou]+'), '|')", lambda c: F.concat_ws("|", N.split_regex(c, "[aeiou]+"))),
    "split_tuple": ("string_split({x}, ' ')[1] || '/' || coalesce(string_split({x}, ' ')[2], '')", lambda c: F.concat(N.split_tuple(c, " ", 2)["_0"], lit("/"), F.coalesce(N.split_tuple(c, " ", 2)["_1"], lit("")))),
    "split": (SPLIT, lambda c: F.split(c, " ")),
    "rsplit": ("CASE WHEN strpos({x}, ' ') = 0 THEN [{x}] ELSE [{x}[:length({x}) - strpos(reverse({x}), ' ')], {x}[length({x}) - strpos(reverse({x}), ' ') + 2:]] END", lambda c: N.rsplit(c, " ", 1)),
    "splitlines": ("string_split(replace({x}, ' ', chr(10)), chr(10))", lambda c: N.splitlines(F.translate(c, " ", "\n"))),
    "strip": ("regexp_replace({x}, '^\\s+|\\s+$', '', 'g')", N.strip),
    "rstrip": ("regexp_replace({x}, '\\s+$', '')", N.rstrip),
    "lstrip": ("regexp_replace({x}, '^\\s+', '')", N.lstrip),
    "count": ("((length({x}) - length(replace({x}, 'er', ''))) / 2)::INTEGER", lambda c: N.count(c, "er")),
    "replace": ("replace({x}, 'e', '[e]')", lambda c: F.replace(c, lit("e"), lit("[e]"))),
    "starts": ("starts_with({x}, 'b')", lambda c: c.startswith("b")),
    "ends": ("ends_with({x}, 'e')", lambda c: c.endswith("e")),
    "find": (find_of("e"), lambda c: N.find(c, "e")),
    "rfind": (rfind_of("e"), lambda c: N.rfind(c, "e")),
    "index": (find_of(" "), lambda c: N.index(c, " ")),
    "rindex": (rfind_of(" "), lambda c: N.rindex(c, " ")),
    "upper": ("upper({x})", F.upper),
    "lower": ("lower({x})", F.lower),
    "capitalize": ("upper({x}[1:1]) || lower({x}[2:])", N.capitalize),
    "swapcase": (SWAP, N.swapcase),
    "title": (TITLE, N.title),
    "join_args": ("{x} || '-' || upper({x}) || '-' || 7", lambda c: F.concat_ws("-", c, F.upper(c), lit("7"))),
    "join": ("array_to_string(list_reverse(string_split({x}, ' ')), ', ')", lambda c: N.join(", ", F.reverse(N.split(c, " ")))),
    "format": ("printf('<%s|%8.3f|%d>', {x}, 2.5::DOUBLE, length({x}))", lambda c: N.format_("<%s|%8.3f|%d>", c, lit(2.5), F.length(c))),
    "char_at": ("{x}[3:3] || {x}[-1:]", lambda c: F.concat(N.char_at(c, 2), N.char_at(c, -1))),
    "slice": ("{x}[3:7]", lambda c: N.slice_(c, 2, 7)),
    "slice_step": ("array_to_string(list_filter(string_split({x}, ''), lambda z, i: i % 2 = 1), '')", lambda c: N.slice_(c, None, None, 2)),
    "contains": ("contains({x}, 'an')", lambda c: N.contains(c, "an")),
    "repeat": ("repeat({x}, 3)", lambda c: N.repeat(c, 3)),
    "plus": ("{x} || '+' || {x}", lambda c: F.concat(c, lit("+"), c)),
    "compare": ("concat({x} < 'm', {x} > 'm', {x} <= 'm', {x} >= 'm', {x} = 'm', {x} <> 'm')", lambda c: F.concat(*(v.cast("string") for v in (c < "m", c > "m", c <= "m", c >= "m", c == "m", c != "m")))),
    "lt": ("{x} < 'm'", lambda c: c < "m"), "gt": ("{x} > 'm'", lambda c: c > "m"), "eq": ("{x} = upper({x})", lambda c: c == F.upper(c)), "ne": ("{x} <> upper({x})", lambda c: c != F.upper(c)),
    "cmp": ("CASE WHEN {x} < 'm' THEN -1 WHEN {x} > 'm' THEN 1 ELSE 0 END", lambda c: N.compare(c, lit("m"))),
    "iterate": ("list_filter(string_split({x}, ''), lambda z: z <> '')", N.characters),
    "escaped": ("replace(replace({x}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't')", N.escaped),
    "bytes": ("list_transform(list_filter(string_split({x}, ''), lambda z: z <> ''), lambda z: ascii(z))", N.data_as_vector),
    "hex_digest": ("lower(lpad(printf('%x', length({x})), 8, '0')) || '000000ff'", lambda c: N.hex_digest(F.array(F.length(c).cast("long"), lit(255).cast("long")))),
    "bytes_as_string": ("{x}", lambda c: N.bytes_as_string(N.data_as_vector(c))),
    "size": ("strlen({x})::INTEGER", N.size),
    "length": ("length({x})::INTEGER", F.length),
    "sha1": ("sha1({x})", N.sha1),
    "reverse": ("reverse({x})", F.reverse),
    "center": ("repeat('*', (greatest(40 - length({x}), 0) // 2)::BIGINT) || {x} || repeat('*', (greatest(40 - length({x}), 0) - greatest(40 - length({x}), 0) // 2)::BIGINT)", lambda c: N.center(c, 40, "*")),
    "ljust": ("rpad({x}, greatest(30, length({x}))::INTEGER, '.')", lambda c: N.ljust(c, 30, ".")),
    "rjust": ("lpad({x}, greatest(30, length({x}))::INTEGER, '.')", lambda c: N.rjust(c, 30, ".")),
    "zfill": ("lpad({x}, greatest(30, length({x}))::INTEGER, '0')", lambda c: N.zfill(c, 30)),
    "decode": ("{x}", lambda c: N.decode(N.encode(c, "utf-16"), "utf-16")),
    "encode": ("lower(hex(encode({x})))", lambda c: F.lower(F.hex(N.encode(c)))),
    "expandtabs": ("regexp_replace({x}, '\\t', repeat(' ', (8 - (length({x}) - 1) % 8)::BIGINT))", N.expandtabs),
    "alnum": ("regexp_full_match({x}, '[A-Za-z0-9]+')", N.is_alnum),
    "digit": ("regexp_full_match({x}[1:1], '[0-9]+')", lambda c: N.is_digit(F.substring(c, 1, 1))),
    "is_lower": ("{x} = lower({x}) AND {x} <> upper({x})", N.is_lower),
    "is_upper": ("{x} = upper({x}) AND {x} <> lower({x})", N.is_upper),
    "is_space": ("regexp_full_match({x}[1:2], '\\s+')", lambda c: N.is_space(F.substring(c, 1, 2))),
    "is_title": ("NOT regexp_matches({x}, '[A-Za-z][A-Z]|^[a-z]|[^A-Za-z][a-z]') AND regexp_matches({x}, '[A-Za-z]')", N.is_title),
    "is_alpha": ("regexp_full_match({x}, '[A-Za-z]+')", N.is_alpha),
    "partition": ("CASE WHEN strpos({x}, ' ') = 0 THEN [{x}, '', ''] ELSE [{x}[:strpos({x}, ' ') - 1], ' ', {x}[strpos({x}, ' ') + 1:]] END", lambda c: N.partition(c, " ")),
    "rpartition": ("CASE WHEN strpos({x}, ' ') = 0 THEN ['', '', {x}] ELSE [{x}[:length({x}) - strpos(reverse({x}), ' ')], ' ', {x}[length({x}) - strpos(reverse({x}), ' ') + 2:]] END", lambda c: N.rpartition(c, " ")),
    "translate": ("translate({x}, 'abc', 'xy')", lambda c: N.translate(c, "abc", "xy")),
    "chr": ("chr((65 + length({x}) % 26)::INTEGER)", lambda c: F.char(65 + F.length(c) % 26)),
    "ord": ("ascii({x})", F.ascii),
    "same": ("{x}", lambda c: c.cast("string")),
}
#: id: function, base
STRING_MEMBERS = {
    "N2": ("matches", "customer"), "N3": ("extract", "part"), "N4": ("split_regex", "part"), "N6": ("split_tuple", "part"), "N7": ("strip", "padded"), "N8": ("rstrip", "padded"), "N9": ("lstrip", "padded"), "N11": ("count", "part"),
    "N12": ("starts", "part"), "N13": ("ends", "part"), "N14": ("find", "part"), "N15": ("rfind", "part"), "N16": ("index", "customer"), "N17": ("rindex", "customer"), "N19": ("upper", "part"), "N20": ("lower", "customer"),
    "N21": ("capitalize", "part"), "N22": ("swapcase", "customer"), "N23": ("join_args", "part"), "N24": ("join", "part"), "N25": ("format", "part"), "N26": ("char_at", "part"), "N27": ("slice", "part"), "N28": ("slice_step", "part"),
    "N29": ("contains", "part"), "N30": ("repeat", "part"), "N31": ("plus", "part"), "N32": ("compare", "part"), "N33": ("iterate", "brand"), "N34": ("escaped", "padded"), "N35": ("bytes", "brand"), "N36": ("hex_digest", "part"),
    "N37": ("size", "part"), "N38": ("bytes_as_string", "brand"), "N39": ("same", "size"), "N40": ("sha1", "part"), "N41": ("capitalize", "customer"), "N43": ("count", "customer"), "N44": ("decode", "customer"), "N45": ("encode", "customer"),
    "N46": ("ends", "customer"), "N47": ("expandtabs", "padded"), "N48": ("find", "customer"), "N49": ("format", "customer"), "N50": ("index", "phrase"), "N51": ("alnum", "brand"), "N52": ("digit", "phrase"), "N53": ("is_lower", "part"),
    "N54": ("is_space", "padded"), "N55": ("is_title", "customer"), "N56": ("is_upper", "phrase"), "N57": ("join", "phrase"), "N58": ("ljust", "customer"), "N59": ("lower", "phrase"), "N60": ("lstrip", "padded"), "N61": ("partition", "customer"),
    "N62": ("replace", "customer"), "N63": ("rfind", "customer"), "N64": ("rindex", "phrase"), "N65": ("rjust", "customer"), "N66": ("rpartition", "part"), "N67": ("rsplit", "part"), "N68": ("rstrip", "padded"), "N69": ("split", "customer"),
    "N70": ("splitlines", "part"), "N71": ("starts", "phrase"), "N72": ("strip", "padded"), "N73": ("swapcase", "part"), "N74": ("title", "part"), "N75": ("translate", "part"), "N76": ("upper", "customer"), "N77": ("zfill", "part"),
    "N78": ("char_at", "customer"), "N79": ("length", "part"), "N80": ("same", "customer"), "N81": ("cmp", "part"), "N82": ("plus", "customer"), "N83": ("repeat", "customer"), "N84": ("lt", "part"), "N85": ("gt", "part"),
    "N86": ("eq", "phrase"), "N87": ("ne", "phrase"), "N88": ("chr", "part"), "N89": ("ord", "part"),
}
for _id, (_name, _base) in STRING_MEMBERS.items():
    _sql, _f = STRINGS[_name]
    if _id == "N39":
        _sql, _f = "{x}::VARCHAR", (lambda c: c.cast("string"))
    member(f"{_id}_{_name}", _base, _sql, _f)

# ------------------------------------------------------------------------------ dates
US = {"years": 31536000000000, "weeks": 604800000000, "days": 86400000000, "hours": 3600000000, "minutes": 60000000, "seconds": 1000000, "milliseconds": 1000, "microseconds": 1}
CLOCK = {"hours": "abs({x}) // 3600000000", "minutes": "abs({x}) % 3600000000 // 60000000", "seconds": "abs({x}) % 60000000 // 1000000"}
for _id, _name, _base, _sql, _f in (
    ("D2", "from_string", "when", "strftime({x}, '%Y-%m-%d %H:%M:%S')::TIMESTAMP", lambda t: D.from_string(D.strftime(t, "%Y-%m-%d %H:%M:%S"))),
    ("D3", "from_iso_string", "when", "date_trunc('second', {x})", lambda t: D.from_iso(D.iso(t))),
    ("D4", "from_date_string", "when", "date_trunc('day', {x})::TIMESTAMP", lambda t: D.from_date_string(D.strftime(t, "%Y/%m/%d"))),
    ("D5", "from_undelimited", "when", "date_trunc('day', {x})::TIMESTAMP", lambda t: D.from_undelimited(D.strftime(t, "%Y%m%d"))),
    ("D6", "from_seconds", "size", "make_timestamp({x} * 86400 * 1000000)", lambda n: D.from_seconds(n * 86400)),
    ("D8", "epoch", "when", "{x} > TIMESTAMP '1970-01-01'", lambda t: t > D.epoch()),
    ("D10", "month", "when", "month({x})::INTEGER", F.month), ("D11", "day", "when", "day({x})::INTEGER", F.day), ("D12", "day_of_week", "when", "dayname({x})", D.day_of_week),
    ("D13", "time_of_day", "ts", "epoch_us({x}) % 86400000000", D.time_of_day),
    ("D14", "iso_string", "ts", "strftime({x}, '%Y%m%dT%H%M%S')", D.iso), ("D15", "iso_extended", "ts", "strftime({x}, '%Y-%m-%dT%H:%M:%S')", D.iso_extended),
    ("D16", "seconds_since_epoch", "ts", "epoch_us({x}) // 1000000", lambda t: D.total(D.micros(t), "seconds")),
    ("D18", "strftime", "ts", "strftime({x}, '%H:%M on %d.%m.%y')", lambda t: D.strftime(t, "%H:%M on %d.%m.%y")),
    ("D19", "since_epoch", "ts", "epoch_us({x})", D.micros),
    ("D20", "earlier_later", "when", "least({x}, TIMESTAMP '1995-06-01')::VARCHAR || greatest({x}, TIMESTAMP '1995-06-01')::VARCHAR || ({x} <> TIMESTAMP '1995-06-01')", lambda t: F.concat(F.least(t, F.expr("timestamp_ntz'1995-06-01'")).cast("string"), F.greatest(t, F.expr("timestamp_ntz'1995-06-01'")).cast("string"), (t != F.expr("timestamp_ntz'1995-06-01'")).cast("string"))),
    ("D23", "times", "span", "{x} * 3", lambda x: x * 3), ("D24", "arithmetic", "span", "[-{x}, {x} + 1000000, {x} - 1000000, CASE WHEN {x} < 86400000000 THEN 1 ELSE 0 END]", lambda x: F.array(-x, x + D.of(lit(1), "seconds"), x - D.of(lit(1), "seconds"), (x < D.of(lit(1), "days")).cast("long"))),
    ("D25", "is_negative", "span", "{x} < 0", D.is_negative),
    *((i, f"total_{u}", "span", f"{{x}} // {US[u]}" if False else f"sign({{x}})::BIGINT * (abs({{x}}) // {US[u]})", lambda x, u=u: D.total(x, u)) for i, u in zip(("D26", "D27", "D28", "D29", "D30", "D31", "D32", "D33"), US)),
    ("D34", "fractional", "span", "abs({x}) % 1000000", D.fractional),
    *((i, u, "span", CLOCK[u], lambda x, u=u: D.field(x, u)) for i, u in zip(("D35", "D36", "D37"), CLOCK)),
    ("D38", "from_string_duration", "size", "({x} * 3600 + 61) * 1000000 + 250000", lambda n: D.duration_from_string(F.concat(n.cast("string"), lit(":01:01.25")))),
    ("D39", "fractional_digits", "size", "6 + 0 * {x}", lambda n: lit(D.FRACTIONAL_DIGITS) + 0 * n),
    *((i, f"from_{u}", "size", f"{{x}} * {US[u]}", lambda n, u=u: D.of(n, u)) for i, u in zip(("D40", "D41", "D42", "D43", "D44", "D45", "D46", "D47"), US)),
    ("D48", "from_float", "size", "{x} * 1500000", lambda n: D.duration_from_float(n * lit(1.5))),
):
    member(f"{_id}_{_name}", _base, _sql, _f)
member("D17_float_seconds", "ts", "epoch_us({x}) / 1e6", D.float_seconds, 6)
member("D22_ratio", "span", "{x}::DOUBLE / 3600000000.0::DOUBLE", lambda x: D.ratio(x, D.of(lit(1), "hours")))
member("D49_now", "when", "true", lambda t: t < F.localtimestamp())

# ------------------------------------------------------------------------------ mathematics
SERIES = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
IBETA = "pow(0.4, {x}) * (1 + {x} * 0.6)"  # of ({x}, 2) at 0.4
sp = M.special
#: name: DuckDB, Spark; over an x between 0 and 1
FUNCTIONS = {
    "sqrt": ("sqrt({x})", F.sqrt), "hypot": ("sqrt({x} * {x} + 9)", lambda x: F.hypot(x, lit(3.0))), "logit": ("ln({x} / (1 - {x}))", M.logit), "expit": ("1 / (1 + exp(-{x}))", M.expit),
    "log": ("ln({x})", F.log), "log10": ("log10({x})", F.log10), "log_base": ("ln({x}) / ln(3)", lambda x: M.log_base(3, x)), "log1p": ("ln(1 + {x})", F.log1p), "exp": ("exp({x})", F.exp), "expm1": ("exp({x}) - 1", F.expm1),
    "sin": ("sin({x})", F.sin), "cos": ("cos({x})", F.cos), "tan": ("tan({x})", F.tan), "sec": ("1 / cos({x})", F.sec), "csc": ("1 / sin({x})", F.csc), "asin": ("asin({x})", F.asin), "acos": ("acos({x})", F.acos), "atan": ("atan({x})", F.atan),
    "atan2": ("atan2({x}, 2)", lambda x: F.atan2(x, lit(2.0))), "sinh": ("sinh({x})", F.sinh), "cosh": ("cosh({x})", F.cosh), "tanh": ("tanh({x})", F.tanh), "asinh": ("asinh({x})", F.asinh), "acosh": ("acosh({x} + 1)", lambda x: F.acosh(x + 1)), "atanh": ("atanh({x})", F.atanh),
    "cotan": ("1 / tan({x})", F.cot), "acot": ("atan(1 / {x})", M.acot), "asec": ("acos(1 / (1 + {x}))", lambda x: M.asec(1 + x)), "acsc": ("asin(1 / (1 + {x}))", lambda x: M.acsc(1 + x)), "coth": ("1 / tanh({x})", M.coth), "sech": ("1 / cosh({x})", M.sech), "csch": ("1 / sinh({x})", M.csch),
    "acoth": ("atanh(1 / (1 + {x}))", lambda x: M.acoth(1 + x)), "asech": ("acosh(1 / {x})", M.asech), "acsch": ("asinh(1 / {x})", M.acsch),
    "round": ("floor({x} * 100 + 0.5)", lambda x: M.round_half_up(x * 100)), "floor": ("floor({x} * 100)", lambda x: F.floor(x * 100)), "ceil": ("ceil({x} * 100)", lambda x: F.ceil(x * 100)), "abs": ("abs({x} - 0.5)", lambda x: F.abs(x - 0.5)), "sign": ("sign({x} - 0.5)", lambda x: F.signum(x - 0.5)),
    "factorial": ("factorial(floor({x} * 10)::INTEGER)", lambda x: F.factorial(F.floor(x * 10).cast("int"))), "combination": ("factorial(12) / (factorial(floor({x} * 10)::INTEGER) * factorial(12 - floor({x} * 10)::INTEGER))", lambda x: M.combination(lit(12.0), F.floor(x * 10).cast("int"))),
    "erf": (SERIES, lambda x: sp("erf", x)), "erfc": (f"1 - {SERIES}", lambda x: sp("erfc", x)), "erfinv": ("{x} * 0.9", lambda x: sp("erf", sp("erfinv", x * 0.9))), "erfcinv": ("{x} * 0.9 + 0.05", lambda x: sp("erfc", sp("erfcinv", x * 0.9 + 0.05))),
    "gamma": ("gamma({x} + 0.1)", lambda x: sp("tgamma", x + 0.1)), "lgamma": ("lgamma({x} + 0.1)", lambda x: sp("lgamma", x + 0.1)),
    "digamma": ("coalesce(list_sum(list_transform(range(1, floor({x} * 10)::INTEGER + 1), lambda k: 1.0 / k)), 0) - 0.5772156649015329", lambda x: sp("digamma", F.floor(x * 10) + 1)),
    "gamma_ratio": ("gamma({x} + 1) / gamma({x} + 3)", lambda x: sp("tgamma_ratio", x + 1, x + 3)),
    "gamma_p": ("1 - (1 + {x}) * exp(-{x})", lambda x: sp("gamma_p", lit(2.0), x)), "gamma_q": ("(1 + {x}) * exp(-{x})", lambda x: sp("gamma_q", lit(2.0), x)), "gamma_p_derivative": ("{x} * exp(-{x})", lambda x: sp("gamma_p_derivative", lit(2.0), x)),
    "gamma_p_inv": ("{x}", lambda x: sp("gamma_p", lit(2.0), sp("gamma_p_inv", lit(2.0), x))), "gamma_q_inv": ("{x}", lambda x: sp("gamma_q", lit(2.0), sp("gamma_q_inv", lit(2.0), x))),
    "gamma_p_inva": ("0.1 + {x} * 0.8", lambda x: sp("gamma_p", sp("gamma_p_inva", lit(2.0), 0.1 + x * 0.8), lit(2.0))), "gamma_q_inva": ("0.1 + {x} * 0.8", lambda x: sp("gamma_q", sp("gamma_q_inva", lit(2.0), 0.1 + x * 0.8), lit(2.0))),
    "gamma_lower": ("1 - (1 + {x}) * exp(-{x})", lambda x: sp("tgamma_lower", lit(2.0), x)),
    "beta": ("1 / (({x} + 0.1) * ({x} + 1.1))", lambda x: sp("beta", x + 0.1, lit(2.0))), "beta_ln": ("-ln(({x} + 0.1) * ({x} + 1.1))", lambda x: sp("beta_ln", x + 0.1, lit(2.0))),
    "betac": (f"(1 - {IBETA}) / ({{x}} * ({{x}} + 1))", lambda x: sp("betac", x, lit(2.0), lit(0.4))), "ibeta": (IBETA, lambda x: sp("ibeta", x, lit(2.0), lit(0.4))), "ibetac": (f"1 - {IBETA}", lambda x: sp("ibetac", x, lit(2.0), lit(0.4))),
    "ibeta_inv": ("{x}", lambda x: sp("ibeta", lit(3.0), lit(2.0), sp("ibeta_inv", lit(3.0), lit(2.0), x))), "ibetac_inv": ("{x}", lambda x: sp("ibetac", lit(3.0), lit(2.0), sp("ibetac_inv", lit(3.0), lit(2.0), x))),
    "ibeta_inva": ("0.1 + {x} * 0.8", lambda x: sp("ibeta", sp("ibeta_inva", lit(2.0), lit(0.4), 0.1 + x * 0.8), lit(2.0), lit(0.4))), "ibetac_inva": ("0.1 + {x} * 0.8", lambda x: sp("ibetac", sp("ibetac_inva", lit(2.0), lit(0.4), 0.1 + x * 0.8), lit(2.0), lit(0.4))),
    "ibeta_invb": ("0.1 + {x} * 0.8", lambda x: sp("ibeta", lit(2.0), sp("ibeta_invb", lit(2.0), lit(0.4), 0.1 + x * 0.8), lit(0.4))), "ibetac_invb": ("0.1 + {x} * 0.8", lambda x: sp("ibetac", lit(2.0), sp("ibetac_invb", lit(2.0), lit(0.4), 0.1 + x * 0.8), lit(0.4))),
    "ibeta_derivative": ("pow(0.4, {x} - 1) * 0.6 * {x} * ({x} + 1)", lambda x: sp("ibeta_derivative", x, lit(2.0), lit(0.4))),
    "bessel_i": ("list_sum(list_transform(range(0, 25), lambda k: pow({x} / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))))", lambda x: sp("bessel_i", lit(1.0), x)),
    "bessel_k": ("sqrt(pi() / (2 * ({x} + 0.5))) * exp(-({x} + 0.5))", lambda x: sp("bessel_k", lit(0.5), x + 0.5)),
    "hyp2f1": ("-ln(1 - {x} / 2) / ({x} / 2)", lambda x: sp("hyp2f1", lit(1.0), lit(1.0), lit(2.0), x / 2)),
    "fmod": ("fmod({x} * 100, 7)", lambda x: (x * 100) % 7.0),
    "quad": ("pow({x}, 3) / 3", lambda x: M.integral(lambda t: t * t, x)),
    "is_nan": ("false", F.isnan), "is_inf": ("false", lambda x: F.abs(x) == float("inf")), "is_finite": ("true", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))),
    "cast": ("({x} * 100)::INTEGER::VARCHAR::DOUBLE", lambda x: F.round(x * 100).cast("int").cast("string").cast("double")),
    "constants": ("pi() + exp(1) + (1 + sqrt(5)) / 2 + 0 * {x}", lambda x: lit(math.pi) + lit(math.e) + lit((1 + math.sqrt(5)) / 2) + 0 * x),
    "power": ("pow({x}, 1.5)", lambda x: F.pow(x, lit(1.5))), "divide": ("{x} / 3", lambda x: x / 3), "negate": ("-{x}", lambda x: -x),
}
MATH_MEMBERS = {
    "unit": "M6 power,M12 negate,M14 cast,M16 hypot,M17 logit,M18 abs,M19 sign,M23 constants,M24 log,M25 log10,M26 log_base,M27 log1p,M28 exp,M29 expm1,M31 cos,M32 tan,M33 sec,M34 csc,M35 asin,M36 acos,M37 atan,M38 atan2,M39 sinh,M40 cosh,M41 tanh,M42 asinh,M43 acosh,M44 atanh,M45 cotan,M46 acot,M47 asec,M48 acsc,M49 coth,M50 sech,M51 csch,M52 acoth,M53 asech,M54 acsch,M56 floor,M57 ceil,M59 combination,M62 erf,M63 erfinv,M64 erfc,M65 erfcinv,M67 lgamma,M68 digamma,M69 gamma_ratio,M70 gamma_p,M71 gamma_p_inv,M72 gamma_p_derivative,M73 gamma_p_inva,M74 gamma_q,M75 gamma_q_inv,M76 gamma_q_inva,M77 gamma_lower,M78 beta,M79 betac,M80 ibeta,M81 ibetac,M82 ibeta_inv,M83 ibetac_inv,M84 ibeta_inva,M85 ibetac_inva,M86 ibeta_invb,M87 ibetac_invb,M88 ibeta_derivative,M89 bessel_i,M90 bessel_k,M103 quad",
    "py": "M104 sqrt,M105 hypot,M106 log,M107 acos,M108 acosh,M109 cos,M110 cosh,M111 asin,M112 asinh,M113 sin,M114 sinh,M115 atan,M116 atan2,M117 atanh,M118 tan,M119 tanh,M120 ceil,M121 erf,M122 erfc,M123 exp,M124 expm1,M125 factorial,M126 floor,M127 fmod,M128 lgamma,M129 log10,M130 log1p",
    "scipy": "M132 beta,M133 gamma,M134 hyp2f1,M135 digamma,M136 erfcinv,M137 erfinv,M138 ibeta,M139 ibeta_inv,M140 lgamma,M141 beta_ln,M142 bessel_k,M143 bessel_i,M144 combination,M145 logit,M146 expit,M147 erf,M148 erfc,M149 expm1,M150 log1p,M151 factorial,M152 round,M153 floor,M154 log,M155 log1p,M156 exp,M157 expm1,M158 sqrt,M159 hypot,M160 cos,M161 sin,M162 tan,M163 cosh,M164 sinh,M165 tanh",
    "np": "M167 sign,M171 abs,M172 log,M173 log10,M174 log1p,M175 sqrt,M176 round,M177 cos,M178 sin,M179 tan,M180 hypot,M181 exp,M182 expm1,M183 floor,M185 abs,M186 round",
}
for _base, _members in MATH_MEMBERS.items():
    for _id, _name in (m.split(" ") for m in _members.split(",")):
        member(f"{_id}_{_name}", _base, *FUNCTIONS[_name], 7)
for _id, _name, _base in (("M166", "is_nan", "scipy"), ("M168", "is_nan", "np"), ("M169", "is_inf", "np"), ("M170", "is_finite", "np")):
    member(f"{_id}_{_name}", _base, *FUNCTIONS[_name])
for _id, _name, _sql, _f in (
    ("M2", "minus", "{x} - 7", lambda x: x - 7), ("M3", "times", "{x} * 7", lambda x: x * 7), ("M4", "divide", "{x} // 7", lambda x: M.floor_div(x, lit(7))), ("M5", "modulo", "{x} % 7", lambda x: x % 7),
    ("M7", "shift_left", "{x} << 3", lambda x: F.shiftleft(x, 3)), ("M8", "shift_right", "{x} >> 3", lambda x: F.shiftright(x, 3)), ("M9", "and", "{x} & 12", lambda x: x.bitwiseAND(lit(12))), ("M10", "or", "{x} | 12", lambda x: x.bitwiseOR(lit(12))), ("M11", "xor", "xor({x}, 12)", lambda x: x.bitwiseXOR(lit(12))),
    ("M60", "gcd", "gcd({x}, 360)", lambda x: M.gcd(x, lit(360))), ("M61", "lcm", "lcm({x}, 360)", lambda x: M.lcm(x, lit(360))),
    ("M187", "add", "{x} + 5", lambda x: x + 5), ("M188", "sub", "{x} - 5", lambda x: x - 5), ("M189", "mul", "{x} * 5", lambda x: x * 5), ("M190", "div", "{x} // 5", lambda x: M.floor_div(x, lit(5))), ("M191", "neg", "-{x}", lambda x: -x), ("M192", "pos", "+{x}", lambda x: x),
    ("M193", "invert", "~{x}", F.bitwise_not), ("M194", "pow", "pow({x}, 2)::BIGINT", lambda x: F.pow(x, lit(2)).cast("long")), ("M195", "xor", "xor({x}, 6)", lambda x: x.bitwiseXOR(lit(6))), ("M196", "mod", "{x} % 5", lambda x: M.floor_mod(x, lit(5))), ("M197", "abs", "abs({x} - 20)", lambda x: F.abs(x - 20)),
    ("M13", "nothing_plus", "coalesce(nullif({x} % 3, 0) + nullif({x} % 2, 0), nullif({x} % 3, 0), nullif({x} % 2, 0))", lambda x: F.coalesce(F.nullif(x % 3, lit(0)) + F.nullif(x % 2, lit(0)), F.nullif(x % 3, lit(0)), F.nullif(x % 2, lit(0)))),
):
    member(f"{_id}_{_name}", "whole" if _id.startswith("M1") and len(_id) == 4 else "size", _sql, _f)

# distances, norms and vector arithmetic over the embeddings
BASES["vector"] = ("embeddings", "vec_id", "list_transform(embedding, lambda z: z::DOUBLE)", lambda: F.transform("embedding", lambda v: v.cast("double")))
_pairs = "list_transform(list_zip({x}, list_reverse({x})), lambda z: {e})"
_abs = "list_transform({x}, lambda z: abs(z))"
for _id, _name, _sql, _f in (
    ("M20", "dot", "list_dot_product({x}, list_reverse({x}))", lambda a: Y.dot(a, F.reverse(a))),
    ("M92", "distance_l_infinity", f"list_max({_pairs.replace('{e}', 'abs(z[1] - z[2])')})", lambda a: Y.distance(a, F.reverse(a), "l_infinity")),
    ("M93", "distance_lp", f"pow(list_sum({_pairs.replace('{e}', 'pow(abs(z[1] - z[2]), 3)')}), 1 / 3.0)", lambda a: Y.distance(a, F.reverse(a), "lp", 3)),
    ("M94", "distance_l2", "list_distance({x}, list_reverse({x}))", lambda a: Y.distance(a, F.reverse(a))),
    ("M95", "distance_l2_squared", "pow(list_distance({x}, list_reverse({x})), 2)", lambda a: Y.distance(a, F.reverse(a), "l2_squared")),
    ("M96", "distance_l1", f"list_sum({_pairs.replace('{e}', 'abs(z[1] - z[2])')})", lambda a: Y.distance(a, F.reverse(a), "l1")),
    ("M97", "norm_l_infinity", f"list_max({_abs})", Y.l_infinity), ("M98", "norm_lp", "pow(list_sum(list_transform({x}, lambda z: pow(abs(z), 3))), 1 / 3.0)", lambda a: Y.lp(a, 3)), ("M99", "norm_l2", "sqrt(list_dot_product({x}, {x}))", Y.l2),
    ("M100", "norm_l2_squared", "list_dot_product({x}, {x})", Y.l2_squared), ("M101", "norm_l1", f"list_sum({_abs})", Y.l1),
    ("M102", "trapz", "list_sum({x}) - ({x}[1] + {x}[-1]) / 2", Y.trapz),
    ("M184", "median", "list_median({x})", lambda a: Y.median(a)),
):
    member(f"{_id}_{_name}", "vector", _sql, _f, 6)


def _rounded(a: Column) -> Column:
    return F.transform(a, lambda v: F.round(v, 6) + 0.0)


member("M21_vectors", "vector", "list_transform(list_zip({x}, list_reverse({x})), lambda z: round(atan2(z[1], z[2]), 6) + 0.0)", lambda a: _rounded(F.zip_with(a, F.reverse(a), F.atan2)))
member("M22_tuples", "unit", "[round(sin({x}), 6), round(sin({x} + 1), 6)]", lambda x: _rounded(F.array(F.sin(x), F.sin(x + 1))))
