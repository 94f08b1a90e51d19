"""Queries over strings, dates, mathematics and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.functions import arrays as Y, dates as D, mathfn as M, text as N
from stratalith.plans.catalog import query, table


def _part(name, sql, **columns):
    """A query over part: p_partkey and the given expressions of p_name."""
    fields = ", ".join(f"{e} AS {c}" for c, e in sql.items())

    @query(name, f"SELECT p_partkey, {fields} FROM part")
    def _(s, d):
        return table(s, d, "part").select("p_partkey", *(f(F.col("p_name")).alias(c) for c, f in columns.items()))


_part("N1_regex", {"a": "regexp_replace(p_name, '[aeiou]', '_', 'g')", "b": "regexp_full_match(p_name, '.*e[a-z ]*')", "c": "CASE WHEN regexp_matches(p_name, '([a-z]+) ([a-z]+)') THEN regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) END"},
      a=lambda c: N.regex_replace(c, "[aeiou]", "_"), b=lambda c: N.matches(c, ".*e[a-z ]*"), c=lambda c: N.extract(c, "([a-z]+) ([a-z]+)", 2)[1])
_part("N5_split_strip", {"a": "array_to_string(string_split(p_name, ' '), '|')", "b": "trim('  ' || p_name || ' ')", "c": "rtrim(' ' || p_name || ' ')", "d": "ltrim(' ' || p_name || ' ')", "e": "len(string_split(p_name, 'e'))::INTEGER"},
      a=lambda c: F.concat_ws("|", N.split(c)), b=lambda c: N.strip(F.concat(F.lit("  "), c, F.lit(" "))), c=lambda c: N.rstrip(F.concat(F.lit(" "), c, F.lit(" "))), d=lambda c: N.lstrip(F.concat(F.lit(" "), c, F.lit(" "))), e=lambda c: F.size(N.split(c, "e")))
_part("N10_find_count", {"a": "replace(p_name, 'e', 'EE')", "b": "((length(p_name) - length(replace(p_name, 're', ''))) / 2)::INTEGER", "c": "starts_with(p_name, 'b')", "d": "ends_with(p_name, 'e')", "e": "strpos(p_name, 'e')::INTEGER - 1", "f": "CASE WHEN strpos(p_name, 'e') = 0 THEN -1 ELSE length(p_name)::INTEGER - strpos(reverse(p_name), 'e')::INTEGER END", "g": "contains(p_name, 'an')"},
      a=lambda c: F.replace(c, F.lit("e"), F.lit("EE")), b=lambda c: N.count(c, "re"), c=lambda c: c.startswith("b"), d=lambda c: c.endswith("e"), e=lambda c: N.find(c, "e"), f=lambda c: N.rfind(c, "e"), g=lambda c: c.contains("an"))
_part("N18_case_slice", {"a": "reverse(p_name)", "b": "upper(p_name)", "c": "upper(p_name[1:1]) || lower(p_name[2:])", "d": "p_name[-1:]", "e": "p_name[3:6]", "f": "upper(p_name)", "g": "repeat(p_name, 2)", "h": "strlen(p_name)::INTEGER", "i": "sha1(p_name)", "j": "printf('%s-%05d', p_name, 7)"},
      a=F.reverse, b=F.upper, c=N.capitalize, d=lambda c: N.char_at(c, -1), e=lambda c: N.slice_(c, 2, 6), f=lambda c: N.swapcase(F.lower(c)), g=lambda c: N.repeat(c, 2), h=N.size, i=N.sha1, j=lambda c: N.format_("%s-%05d", c, F.lit(7)))
_part("N42_pad_partition", {"a": "rpad(p_name, greatest(30, length(p_name))::INTEGER, '.')", "b": "lpad(p_name, greatest(30, length(p_name))::INTEGER, '.')", "c": "CASE WHEN strpos(p_name, ' ') = 0 THEN p_name ELSE p_name[:strpos(p_name, ' ') - 1] END", "d": "regexp_full_match(p_name, '[0-9]+')", "e": "lower(p_name) = p_name AND upper(p_name) <> p_name", "f": "ascii(p_name)", "g": "chr(65)"},
      a=lambda c: N.ljust(c, 30, "."), b=lambda c: N.rjust(c, 30, "."), c=lambda c: N.partition(c, " ")[0], d=N.is_digit, e=N.is_lower, f=F.ascii, g=lambda c: F.char(F.lit(65)))


@query("D9_date_fields", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, dayname(o_orderdate) AS dow, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS dmy, epoch_us(o_orderdate) AS us FROM orders")
def _(s, d):
    t = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("d"), D.day_of_week(t).alias("dow"), D.iso_extended(t).alias("iso"), D.strftime(t, "%d/%m/%Y").alias("dmy"), D.micros(t).alias("us"))


@query("D7_strptime", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS t FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", D.strptime(D.strftime(F.col("o_orderdate"), "%d.%m.%Y"), "%d.%m.%Y").alias("t"))


@query("D21_durations", """SELECT event_id, x AS us, x // 3600000000 AS hours, x // 86400000000 AS days, x // 604800000000 AS weeks, (x % 3600000000) // 60000000 AS minutes, ts + INTERVAL 90 MINUTE AS later
FROM (SELECT event_id, ts, epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01') AS x FROM events)""")
def _(s, d):
    x = D.between(F.col("ts"), F.expr("timestamp_ntz'2020-01-01'"))
    return table(s, d, "events").select("event_id", x.alias("us"), D.total(x, "hours").alias("hours"), D.total(x, "days").alias("days"), D.total(x, "weeks").alias("weeks"), D.field(x, "minutes").alias("minutes"), D.plus(F.col("ts"), D.of(F.lit(90), "minutes")).alias("later"))


@query("D1_make", "SELECT n_nationkey, make_timestamp(2000 + n_nationkey, 3, 4, 5, 6, 7) AS t, make_timestamp((n_nationkey * 1000000)::BIGINT) AS e FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", D.make(F.lit(2000) + F.col("n_nationkey"), 3, 4, 5, 6, 7).alias("t"), D.from_seconds(F.col("n_nationkey")).alias("e"))


def _math(name, x, **pairs):
    """Rounded functions of a column x of part: DuckDB text and Spark function by name."""
    fields = ", ".join(f"round(({sql})::DOUBLE, 8) AS {c}" for c, (sql, _) in pairs.items())

    @query(name, f"SELECT p_partkey, {fields} FROM (SELECT p_partkey, {x} AS x FROM part)")
    def _(s, d):
        return table(s, d, "part").select("p_partkey", F.expr(x).alias("x")).select("p_partkey", *(F.round(f(F.col("x")).cast("double"), 8).alias(c) for c, (_, f) in pairs.items()))


_math("M15_roots_logs", "p_retailprice / 100.0", sqrt=("sqrt(x)", F.sqrt), hyp=("sqrt(x * x + 9)", lambda x: F.hypot(x, F.lit(3.0))), ln=("ln(x)", F.log), l10=("log10(x)", F.log10), lb=("ln(x) / ln(3)", lambda x: M.log_base(3, x)), l1p=("ln(1 + x)", F.log1p), e=("exp(x / 10)", lambda x: F.exp(x / 10)), em=("exp(x / 10) - 1", lambda x: F.expm1(x / 10)), cb=("pow(x, 1.5)", lambda x: F.pow(x, F.lit(1.5))))
_math("M30_trigonometry", "cast(p_size as double) / 60", sin=("sin(x)", F.sin), cos=("cos(x)", F.cos), tan=("tan(x)", F.tan), sec=("1 / cos(x)", F.sec), csc=("1 / sin(x)", F.csc), asin=("asin(x)", F.asin), acos=("acos(x)", F.acos), atan=("atan(x)", F.atan), at2=("atan2(x, 2)", lambda x: F.atan2(x, F.lit(2.0))), sinh=("sinh(x)", F.sinh), cosh=("cosh(x)", F.cosh), tanh=("tanh(x)", F.tanh), cot=("1 / tan(x)", F.cot), asinh=("asinh(x)", F.asinh), atanh=("atanh(x)", F.atanh), acosh=("acosh(x + 1)", lambda x: F.acosh(x + 1)), acot=("atan(1 / x)", M.acot), coth=("1 / tanh(x)", M.coth), sech=("1 / cosh(x)", M.sech), csch=("1 / sinh(x)", M.csch), logit=("ln(x / (1 - x))", M.logit), expit=("1 / (1 + exp(-x))", M.expit))
_math("M55_rounding", "p_retailprice - 1300.5", r=("floor(x + 0.5)", M.round_half_up), f=("floor(x)", F.floor), c=("ceil(x)", F.ceil), s=("sign(x)", F.signum), a=("abs(x)", F.abs))


@query("M1_integers", "SELECT p_partkey, p_partkey + p_size AS a, p_partkey - p_size AS b, p_partkey * p_size AS c, p_partkey // p_size AS d, p_partkey % p_size AS e, p_partkey << 2 AS f, p_partkey >> 1 AS g, p_partkey & p_size AS h, p_partkey | p_size AS i, xor(p_partkey, p_size::BIGINT) AS j, gcd(p_partkey, p_size::BIGINT) AS k, lcm(p_partkey, p_size::BIGINT) AS l FROM part")
def _(s, d):
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(s, d, "part").select("p_partkey", (a + b).alias("a"), (a - b).alias("b"), (a * b).alias("c"), M.floor_div(a, b).alias("d"), M.floor_mod(a, b).alias("e"), F.shiftleft(a, 2).alias("f"), F.shiftright(a, 1).alias("g"), a.bitwiseAND(b).alias("h"), a.bitwiseOR(b).alias("i"), a.bitwiseXOR(b).alias("j"), M.gcd(a, b).alias("k"), M.lcm(a, b).alias("l"))


@query("M58_factorial_combination", "SELECT i, factorial(i)::DOUBLE AS f, round((factorial(20) / (factorial(i) * factorial(20 - i)))::DOUBLE) AS c FROM (SELECT range::INTEGER AS i FROM range(1, 20))")
def _(s, d):
    i = F.col("id").cast("int")
    return s.range(1, 20).select(i.alias("i"), F.factorial(i).cast("double").alias("f"), M.combination(F.lit(20.0), i).alias("c"))


@query("M66_gamma", "SELECT p_size, round(gamma(p_size / 10.0), 6) AS g, round(lgamma(p_size / 10.0), 8) AS l FROM (SELECT DISTINCT p_size FROM part)")
def _(s, d):
    x = F.col("p_size") / 10.0
    return table(s, d, "part").select("p_size").distinct().select("p_size", F.round(M.special("tgamma", x), 6).alias("g"), F.round(M.special("lgamma", x), 8).alias("l"))


@query("M62_special_functions")
def _(s, d):
    x = F.col("id") / 10.0
    return s.range(1, 40).select("id", *(M.special(n, *a).alias(n) for n, a in {
        "erf": [x], "erfc": [x], "erfinv": [x / 5], "digamma": [x], "gamma_p": [x, F.lit(2.0)], "gamma_p_inv": [x, F.lit(0.3)], "beta": [x, F.lit(2.0)], "ibeta": [x, F.lit(2.0), F.lit(0.4)], "ibeta_inv": [x, F.lit(2.0), F.lit(0.4)], "bessel_i": [F.lit(1.0), x], "bessel_k": [F.lit(1.0), x]}.items()))


EMB = "FROM (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS a, list_reverse(list_transform(embedding, lambda z: z::DOUBLE)) AS b FROM embeddings)"


@query("M91_distances_norms", f"""SELECT vec_id, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, round(list_distance(a, b), 6) AS l2,
round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS li, round(sqrt(list_dot_product(a, a)), 6) AS n2,
round(pow(list_sum(list_transform(a, lambda z: pow(abs(z), 3))), 1 / 3.0), 6) AS n3 {EMB}""")
def _(s, d):
    a, b = F.col("embedding"), F.reverse("embedding")
    return table(s, d, "embeddings").select("vec_id", *(F.round(Y.distance(a, b, k), 6).alias(n) for n, k in (("cosine", "cosine"), ("l2", "l2"), ("l1", "l1"), ("li", "l_infinity"))), F.round(Y.l2(a), 6).alias("n2"), F.round(Y.lp(a, 3), 6).alias("n3"))


@query("Y5_arrays", f"""SELECT vec_id, a[1] AS first, a[-1] AS last, len(a[3:6])::INTEGER AS part, len(list_filter(a, lambda z: z > 0))::INTEGER AS pos, round(list_sum(a), 6) AS total, len(list_concat(a, a))::INTEGER AS twice {EMB}""")
def _(s, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", Y.get(a, 0).alias("first"), Y.get(a, -1).alias("last"), F.size(Y.slice_(a, 2, 6)).alias("part"), F.size(F.filter(a, lambda x: x > 0)).alias("pos"), F.round(Y.total(a), 6).alias("total"), F.size(Y.repeat(a, 2)).alias("twice"))


@query("Y40_iterators", "SELECT i, CASE WHEN i < 4 THEN i ELSE 4 END AS taken, greatest(i - 4, 0) AS rest, least(i, 3) AS zipped, i % 3 AS at FROM (SELECT range::INTEGER AS i FROM range(1, 30))")
def _(s, d):
    i = F.col("id").cast("int")
    a = F.sequence(F.lit(1), i)
    return s.range(1, 30).select(i.alias("i"), F.size(Y.take_while(a, lambda x: x < 5)).alias("taken"), F.size(Y.drop_while(a, lambda x: x < 5)).alias("rest"), F.size(Y.zip_shortest(a, F.array(*map(F.lit, (1, 2, 3))))).alias("zipped"), F.element_at(Y.cycle(F.array(*map(F.lit, (0, 1, 2))), 30), i + 1).alias("at"))


@query("Y13_maps", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def _(s, d):
    m = F.from_json("props", "map<string,string>")
    return table(s, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("int").alias("k"))
