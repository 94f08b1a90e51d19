"""One query for each member of the vector, dictionary, tuple, array, complex and type-filter families."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from stratalith.functions import arrays as Y, types as K
from stratalith.plans.catalog import listed, query, table
from stratalith.plans.scalar_members import BASES, lit, member

r6 = lambda a: F.transform(a, lambda v: F.round(v, 6) + 0.0)
BASES |= {
    "ints": ("part", "p_partkey", "range(1, p_size % 9 + 3)", lambda: F.sequence(lit(1).cast("long"), (F.col("p_size") % 9 + 2).cast("long"))),
    "count": ("part", "p_partkey", "p_size::BIGINT", lambda: F.col("p_size").cast("long")),
    "props": ("events", "event_id", "(props->>'k')::BIGINT", lambda: F.from_json("props", "struct<k: bigint>")["k"]),
    "point": ("customer", "c_custkey", "c_acctbal / 1000", lambda: F.col("c_acctbal") / 1000),
    "eight": ("embeddings", "vec_id", "list_transform(embedding[1:12], lambda z: round(z::DOUBLE, 3) + 0.0)", lambda: F.transform(F.slice("embedding", 1, 12), lambda v: F.round(v.cast("double"), 3) + 0.0)),
}
MAP, MAP_SQL = (lambda k: F.create_map(lit("k"), k, lit("a"), k + 1, lit("z"), k * 2)), "MAP {'a': {x} + 1, 'k': {x}, 'z': {x} * 2}"
odd = lambda x: x % 2 == 1
T3 = lambda a: Y.as_tuple(a, 3)
fields = lambda t, n: F.array(*(t[f"_{i}"] for i in range(n)))
LT, RT = "[{x}[1], {x}[2], {x}[3]]", lambda a: F.slice(a, 1, 3)

for _id, _name, _base, _sql, _f in (
    # vectors
    ("F18", "filter", "ints", "list_filter({x}, lambda z: z % 2 = 1)", lambda a: F.filter(a, odd)), ("F19", "filter_with_index", "ints", "list_filter({x}, lambda z, i: (z + i) % 3 = 0)", lambda a: F.filter(a, lambda x, i: (x + i + 1) % 3 == 0)),
    ("F20", "contains", "ints", "list_contains({x}, 5)", lambda a: F.array_contains(a, 5)), ("F21", "index", "ints", "list_position({x}, 2) - 1", lambda a: Y.index(a, 2)), ("F22", "slice", "ints", "list_filter({x}[2:], lambda z, i: i % 2 = 1)", lambda a: Y.slice_(a, 1, None, 2)),
    ("F23", "split", "ints", "CASE WHEN len({x}) < 3 THEN [{x}] WHEN len({x}) < 6 THEN [{x}[1:2], {x}[3:]] WHEN len({x}) < 9 THEN [{x}[1:2], {x}[3:5], {x}[6:]] ELSE [{x}[1:2], {x}[3:5], {x}[6:8], {x}[9:]] END", lambda a: Y.split_when(a, lambda x: x % 3 == 0)),
    ("U4", "append_element", "ints", "list_append({x}, 99)", lambda a: Y.append(a, lit(99).cast("long"))), ("U5", "intersection", "ints", "list_sort(list_intersect({x}, [2, 4, 6, 100]))", lambda a: F.array_sort(F.array_intersect(a, F.array(*(lit(v).cast("long") for v in (2, 4, 6, 100)))))),
    ("U6", "disjoint", "ints", "list_sort(list_concat(list_filter({x}, lambda z: z NOT IN (2, 100)), list_filter([2, 100], lambda z: NOT list_contains({x}, z))))", lambda a: F.array_sort(F.concat(F.array_except(a, F.array(lit(2).cast("long"), lit(100).cast("long"))), F.array_except(F.array(lit(2).cast("long"), lit(100).cast("long")), a)))),
    ("Y1", "range", "count", "list_transform(list_filter(range(0, {x}), lambda i: i % 3 = 0), lambda i: i * i)", lambda n: Y.build(n, lambda i: i * i, lambda i: i % 3 == 0)), ("Y2", "uniform", "count", "list_transform(range(0, {x}), lambda i: 7)", lambda n: Y.uniform(n.cast("int"), 7)),
    ("Y3", "apply", "ints", "list_transform({x}, lambda z: z * 2 + 1)", lambda a: F.transform(a, lambda x: x * 2 + 1)), ("Y4", "equal", "ints", "{x} = [1, 2, 3]", lambda a: a == F.array(*(lit(v).cast("long") for v in (1, 2, 3)))),
    ("Y7", "mutable", "ints", "list_transform({x}, lambda z, i: CASE WHEN i = 1 THEN 42 ELSE z END)", lambda a: F.transform(a, lambda x, i: F.when(i == 0, 42).otherwise(x))), ("Y8", "sequence", "count", "range(2, {x} + 3, 2)", lambda n: F.sequence(lit(2).cast("long"), n + 2, lit(2).cast("long"))),
    ("Y9", "zip_with", "ints", "list_transform({x}, lambda z: z + z * 2 + z * z)", lambda a: Y.zip_with(lambda x, y, z: x + y + z, a, F.transform(a, lambda v: v * 2), F.transform(a, lambda v: v * v))), ("Y10", "slice_copy", "ints", "{x}[2:3]", lambda a: Y.slice_(a, 1, 3)),
    ("Y11", "lazy_vector", "count", "list_sum(list_transform(range(0, {x}), lambda i: i * 3 + 1))::BIGINT", lambda n: F.aggregate(Y.build(n, lambda i: i * 3 + 1), lit(0).cast("long"), lambda s, x: s + x)),
    ("Y12", "lazy_matrix", "count", "list_transform(range(0, 6), lambda k: (k // 3) * 10 + k % 3 + {x})", lambda n: Y.build(6, lambda k: F.floor(k / 3) * 10 + k % 3 + n)),
    # iterators
    ("Y32", "length", "ints", "len({x})::INTEGER", F.size), ("Y33", "get", "ints", "{x}[2]", lambda a: Y.get(a, 1)), ("Y34", "repeat", "count", "list_transform(range(0, 5), lambda i: {x})", lambda n: Y.uniform(5, n)), ("Y35", "iterate", "count", "(({x} * 2 + 1) * 2 + 1) * 2 + 1", lambda n: Y.iterate(lambda x: x * 2 + 1, n, 3)),
    ("Y36", "cycle", "ints", "list_transform(range(0, 7), lambda i: {x}[i % len({x}) + 1])", lambda a: Y.cycle(a, 7)), ("Y37", "subseq", "ints", "{x}[2:4]", lambda a: Y.slice_(a, 1, 4)), ("Y38", "forall", "ints", "len(list_filter({x}, lambda z: z >= 6)) = 0", lambda a: Y.for_all(a, lambda x: x < 6)), ("Y39", "exists", "ints", "len(list_filter({x}, lambda z: z > 6)) > 0", lambda a: Y.exists(a, lambda x: x > 6)),
    ("Y41", "drop_while", "ints", "list_filter({x}, lambda z: z >= 3)", lambda a: Y.drop_while(a, lambda x: x < 3)), ("Y42", "span", "ints", "list_concat(list_filter({x}, lambda z: z < 3), [0], list_filter({x}, lambda z: z >= 3))", lambda a: F.concat(Y.span(a, lambda x: x < 3)["taken"], F.array(lit(0).cast("long")), Y.span(a, lambda x: x < 3)["rest"])),
    ("O15", "take_while", "ints", "list_filter({x}, lambda z: z < 4)", lambda a: Y.take_while(a, lambda x: x < 4)), ("Y43", "filter", "ints", "list_filter({x}, lambda z: z % 3 = 0)", lambda a: F.filter(a, lambda x: x % 3 == 0)), ("Y44", "filter_not", "ints", "list_filter({x}, lambda z: z % 3 <> 0)", lambda a: Y.filter_not(a, lambda x: x % 3 == 0)),
    ("Y45", "zip", "ints", "list_transform(list_zip({x}[1:2], [7, 8]), lambda z: z[1] * 10 + z[2])", lambda a: F.transform(Y.zip_shortest(a, F.array(lit(7), lit(8))), lambda t: t["a"] * 10 + t["b"])), ("Y46", "map", "ints", "list_transform({x}, lambda z: -z)", lambda a: F.transform(a, lambda x: -x)),
    ("Y47", "star_map", "ints", "list_transform({x}, lambda z: z * (z + 1))", lambda a: Y.star_map(lambda x, y: x * y, F.transform(a, lambda v: F.struct(v.alias("_0"), (v + 1).alias("_1"))), 2)), ("Y48", "zip_apply", "ints", "[{x}[1] + 1, {x}[2] * 5]", lambda a: Y.zip_apply([lambda v: v + 1, lambda v: v * 5], a)),
    ("Y51", "to_string", "ints", "array_to_string({x}, ';')", lambda a: Y.to_string(a, ";")), ("Y50", "to_tuple", "ints", "[{x}[1], {x}[2]]", lambda a: fields(Y.as_tuple(a, 2), 2)),
    # dictionaries
    ("Y14", "add_pair", "props", "[{x} + 1, 5, {x} * 2]", lambda k: Y.values(Y.put(MAP(k), lit("k"), lit(5).cast("long")))), ("Y15", "pair_at", "props", "'k=' || {x}", lambda k: F.concat(Y.pair_at(MAP(k), 1)["key"], lit("="), Y.pair_at(MAP(k), 1)["value"].cast("string"))),
    ("Y16", "has_key", "props", "map_contains(" + MAP_SQL + ", 'a')", lambda k: F.map_contains_key(MAP(k), "a")), ("Y17", "remove", "props", "['a', 'z']", lambda k: Y.keys(Y.remove(MAP(k), lit("k")))), ("Y18", "keys", "props", "map_keys(" + MAP_SQL + ")", lambda k: Y.keys(MAP(k))), ("Y19", "values", "props", "map_values(" + MAP_SQL + ")", lambda k: Y.values(MAP(k))),
    ("Y22", "plus_pair", "props", "list_append(map_keys(" + MAP_SQL + "), 'zz')", lambda k: Y.keys(Y.put(MAP(k), lit("zz"), k))), ("Y23", "in", "props", "map_contains(" + MAP_SQL + ", 'q')", lambda k: F.map_contains_key(MAP(k), "q")),
    ("Y62", "dict_keys", "props", "map_keys(" + MAP_SQL + ")", lambda k: Y.keys(MAP(k))), ("Y63", "dict_values", "props", "map_values(" + MAP_SQL + ")", lambda k: Y.values(MAP(k))), ("Y64", "dict_items", "props", "list_transform(map_entries(" + MAP_SQL + "), lambda e: e.key || e.value)", lambda k: F.transform(F.array_sort(F.map_entries(MAP(k))), lambda e: F.concat(e["key"], e["value"].cast("string")))),
    ("Y65", "dict_getitem", "props", MAP_SQL + "['z']", lambda k: F.element_at(MAP(k), "z")), ("Y66", "dict_len", "props", "3", lambda k: F.size(MAP(k))), ("Y67", "dict_iter", "props", "array_to_string(map_keys(" + MAP_SQL + "), ',')", lambda k: F.array_join(Y.keys(MAP(k)), ",")),
    # tuples
    ("Y24", "tuple_apply", "ints", "list_transform({x}[1:2], lambda z, i: z * 10 + i - 1)", lambda a: F.array(*(Y.as_tuple(a, 2)[f"_{i}"] * 10 + i for i in range(2)))), ("Y26", "tuple_field", "ints", "{x}[2]", lambda a: Y.as_tuple(a, 2)["_1"]), ("Y27", "tuple_plus", "ints", "[{x}[1], {x}[2], {x}[1], {x}[2]]", lambda a: fields(Y.join_tuples(Y.as_tuple(a, 2), Y.as_tuple(a, 2), 2, 2), 4)),
    ("Y28", "tuple_compare", "ints", "row({x}[1], {x}[-1]) < row(1, 5)", lambda a: F.struct(Y.get(a, 0), Y.get(a, -1)) < F.struct(lit(1).cast("long"), lit(5).cast("long"))), ("Y29", "tuple_in", "ints", "{x}[-1] IN (4, 6)", lambda a: Y.get(a, -1).isin(4, 6)), ("Y30", "tuple_times", "ints", "list_concat({x}[1:2], {x}[1:2])", lambda a: Y.repeat(fields(Y.as_tuple(a, 2), 2), 2)),
    ("Y31", "tuple_slice", "ints", "[{x}[2], {x}[3]]", lambda a: fields(Y.tuple_slice(T3(a), 1, 3), 2)), ("Y68", "tuple_getitem", "ints", "coalesce({x}[3], -1)", lambda a: F.coalesce(T3(a)["_2"], lit(-1).cast("long"))), ("Y69", "tuple_index", "ints", "1 + 0 * {x}[1]", lambda a: Y.index(fields(Y.as_tuple(a, 2), 2), 2)),
    ("Y70", "tuple_eq", "ints", "{x}[-1] = 4", lambda a: F.struct(Y.get(a, 0), Y.get(a, -1)) == F.struct(lit(1).cast("long"), lit(4).cast("long"))), ("Y71", "tuple_lt", "ints", "{x}[-1] < 4", lambda a: F.struct(Y.get(a, 0), Y.get(a, -1)) < F.struct(lit(1).cast("long"), lit(4).cast("long"))), ("Y72", "tuple_gt", "ints", "{x}[-1] > 4", lambda a: F.struct(Y.get(a, 0), Y.get(a, -1)) > F.struct(lit(1).cast("long"), lit(4).cast("long"))), ("Y73", "tuple_len", "ints", "3", lambda a: F.size(fields(T3(a), 3))),
    # lists and builtins of Python
    ("Y52", "list_getitem", "ints", "{x}[-1]", lambda a: Y.get(a, -1)), ("Y53", "list_append", "ints", "list_append({x}, 0)", lambda a: Y.append(a, lit(0).cast("long"))), ("Y54", "list_index", "ints", "list_position({x}, 1) - 1", lambda a: Y.index(a, 1)), ("Y55", "list_mul", "ints", "list_concat({x}, {x}, {x})", lambda a: Y.repeat(a, 3)), ("Y56", "list_eq", "ints", "{x} = list_reverse({x})", lambda a: a == F.reverse(a)),
    ("Y57", "list_gt", "ints", "len({x}) > 4", lambda a: Y.compare(a, F.array(*(lit(v).cast("long") for v in (1, 2, 3, 4)))) == 1), ("Y58", "list_lt", "ints", "len({x}) < 4", lambda a: Y.compare(a, F.array(*(lit(v).cast("long") for v in (1, 2, 3, 4)))) == -1), ("Y59", "list_len", "ints", "len({x})::INTEGER", F.size), ("Y60", "list_add", "ints", "list_concat({x}, list_reverse({x}))", lambda a: F.concat(a, F.reverse(a))),
    ("Y74", "len", "ints", "len({x})::INTEGER", F.size), ("Y75", "range", "count", "range(0, {x}, 5)", lambda n: F.filter(F.sequence(lit(0).cast("long"), n, lit(5).cast("long")), lambda i: i < n)), ("Y77", "map", "ints", "list_transform({x}, lambda z: z * z)", lambda a: F.transform(a, lambda x: x * x)), ("Y78", "all", "ints", "len({x}) < 7", lambda a: F.forall(a, lambda x: x < 7)), ("Y79", "any", "ints", "len({x}) > 6", lambda a: F.exists(a, lambda x: x > 6)), ("Y80", "min", "ints", "list_min({x})", F.array_min),
    # arrays of numbers
    ("Y81", "transpose", "eight", "list_transform(range(0, 12), lambda k: {x}[(k % 3) * 4 + k // 3 + 1])", lambda a: Y.transpose(a, 3, 4)), ("Y82", "flatten", "eight", "{x}", lambda a: F.flatten(Y.reshape(a, 3, 4))), ("Y83", "tolist", "eight", "[{x}[1:6], {x}[7:12]]", lambda a: Y.reshape(a, 2, 6)), ("Y84", "reshape", "eight", "[{x}[1:4], {x}[5:8], {x}[9:12]]", lambda a: Y.reshape(a, 3, 4)), ("Y86", "getitem", "eight", "{x}[6]", lambda a: Y.get(Y.get(Y.reshape(a, 3, 4), 1), 1)),
    ("Y87", "add", "eight", "list_transform({x}, lambda z: round(z + 2, 6) + 0.0)", lambda a: r6(Y.zip_with(lambda x, y: x + y, a, Y.uniform(12, 2.0)))), ("Y88", "sub", "eight", "list_transform({x}, lambda z: round(z - 2, 6) + 0.0)", lambda a: r6(Y.zip_with(lambda x, y: x - y, a, Y.uniform(12, 2.0)))), ("Y89", "mul", "eight", "list_transform({x}, lambda z: round(z * z, 6) + 0.0)", lambda a: r6(Y.zip_with(lambda x, y: x * y, a, a))), ("Y90", "div", "eight", "list_transform({x}, lambda z: round(z / 3, 6) + 0.0)", lambda a: r6(Y.zip_with(lambda x, y: x / y, a, Y.uniform(12, 3.0)))),
    ("Y91", "pow", "eight", "list_transform({x}, lambda z: round(pow(z, 2), 6) + 0.0)", lambda a: r6(F.transform(a, lambda x: F.pow(x, lit(2.0))))), ("Y92", "neg", "eight", "list_transform({x}, lambda z: -z)", lambda a: F.transform(a, lambda x: -x)), ("Y93", "eq", "eight", "list_transform({x}, lambda z: z = {x}[1])", lambda a: F.transform(a, lambda x: x == Y.get(a, 0))), ("Y94", "eye", "count", "[1.0::DOUBLE, 0, 0, 0, 1, 0, 0, 0, 1]", lambda n: Y.eye(3)), ("Y95", "zeros", "count", "list_transform(range(0, {x}), lambda i: 0.0::DOUBLE)", lambda n: Y.uniform(n.cast("int"), 0.0)),
    ("Y96", "array", "point", "[{x}, {x} * 2]", lambda x: F.array(x, x * 2)), ("Y97", "arange", "count", "range(0, {x}, 3)", lambda n: F.filter(F.sequence(lit(0).cast("long"), n, lit(3).cast("long")), lambda i: i < n)),
    ("Y99", "json", "props", "('{\"k\":' || {x} || '}')", lambda k: F.to_json(F.struct(k.alias("k")))),
    # complex numbers
    ("L106", "complex_is_nan", "point", "{x} < 0", lambda x: Y.c_is_nan(Y.complex_(F.when(x < 0, float("nan")).otherwise(x), x))), ("L107", "complex_is_infinity", "point", "{x} < 0", lambda x: Y.c_is_infinite(Y.complex_(F.when(x < 0, float("inf")).otherwise(x), x))),
):
    member(f"{_id}_{_name}", _base, _sql, _f)
for _id, _name, _base, _sql, _f in (
    ("Y85", "ndarray_dot", "eight", "list_dot_product({x}, list_reverse({x}))", lambda a: Y.dot(a, F.reverse(a))), ("Y98", "np_dot", "vector", "list_dot_product({x}, {x})", lambda a: Y.dot(a, a)),
    ("L20", "complex_arithmetic", "point", "({x} * {x} - 6) + ({x} * 3 + {x} * 2) * 1000", lambda x: (lambda p: p["re"] + p["im"] * 1000)(Y.c_mul(Y.complex_(x, lit(2)), Y.complex_(x, lit(3))))),
    ("L102", "complex_sq_norm", "point", "{x} * {x} + 4", lambda x: Y.sq_norm(Y.complex_(x, lit(2)))), ("L103", "complex_conj", "point", "{x} - 2", lambda x: (lambda c: c["re"] + c["im"])(Y.conj(Y.complex_(x, lit(2))))), ("L104", "complex_phase", "point", "atan2(2, {x})", lambda x: Y.phase(Y.complex_(x, lit(2)))),
    ("L105", "complex_polar", "point", "sqrt({x} * {x} + 4) + atan2(2, {x})", lambda x: (lambda p: p["r"] + p["phi"])(Y.polar(Y.complex_(x, lit(2))))), ("L108", "complex_i", "point", "-{x}", lambda x: Y.c_mul(Y.complex_(lit(0), lit(1)), Y.complex_(lit(0), x))["re"]), ("L109", "complex_rect", "point", "{x} * cos(0.5) + {x} * sin(0.5)", lambda x: (lambda c: c["re"] + c["im"])(Y.rect(x, lit(0.5)))),
):
    member(f"{_id}_{_name}", _base, _sql, _f, 6)


# rows out of vectors and dictionaries
INTS = "SELECT p_partkey, range(1, p_size % 9 + 3) AS x FROM part"


def _ints(s, d):
    return table(s, d, "part").select("p_partkey", BASES["ints"][3]().alias("x"))


@query("Y6_iterate_vector", f"SELECT p_partkey, unnest(x) AS y FROM ({INTS})")
def _(s, d):
    return _ints(s, d).select("p_partkey", F.explode("x").alias("y"))


@query("Y61_list_iter", f"SELECT p_partkey, unnest(x) * 2 AS y FROM ({INTS})")
def _(s, d):
    return _ints(s, d).select("p_partkey", F.explode(F.transform("x", lambda v: v * 2)).alias("y"))


@query("Y49_to_vector", "SELECT p_size, string_agg(p_partkey, ',' ORDER BY p_partkey) AS y FROM part GROUP BY 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_size").agg(listed(F.array_sort(F.collect_list("p_partkey")), "list").alias("y"))


@query("Y76_xrange", "SELECT range AS i FROM range(3, 40, 4)")
def _(s, d):
    return s.range(3, 40, 4).select(F.col("id").alias("i"))


@query("Y20_dictionary_iter", "SELECT event_id, unnest(['a', 'k', 'z']) AS k, unnest([x + 1, x, x * 2]) AS v FROM (SELECT event_id, (props->>'k')::BIGINT AS x FROM events)")
def _(s, d):
    return table(s, d, "events").select("event_id", F.explode(MAP(BASES["props"][3]())).alias("k", "v"))


@query("Y21_dictionary_iter_enum", "SELECT event_id, unnest([0, 1, 2]) AS i, unnest(['a', 'k', 'z']) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.posexplode(Y.keys(MAP(BASES["props"][3]()))).alias("i", "k"))


@query("Y25_tuple_names", "SELECT unnest(['_0', '_1', '_2']) AS name")
def _(s, d):
    names = _ints(s, d).select(T3(F.col("x")).alias("t")).schema["t"].dataType.fieldNames()
    return s.createDataFrame([(n,) for n in names], "name string")


# type filters: a row for each column of a frame that has a column of every kind
KINDS = {"id": "long", "name": "string", "flag": "boolean", "price": "double", "at": "timestamp_ntz", "lasts": "interval", "list": "array", "pairs": "map", "both": "struct", "any": "variant"}


def _all_kinds(s, d):
    p = table(s, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 9).alias("flag"), F.col("p_retailprice").alias("price"), F.expr("timestamp_ntz'2024-01-01'").alias("at"),
        F.expr("make_dt_interval(1)").alias("lasts"), F.array("p_size").alias("list"), F.create_map(F.col("p_name"), F.col("p_size")).alias("pairs"), F.struct("p_size").alias("both"), F.parse_json(F.lit("1")).alias("any"))


def _filter_query(name: str, predicate, *holds: str) -> None:
    rows = ", ".join(f"('{c}', {str(c in holds).lower()})" for c in KINDS)

    @query(name, f'SELECT "column", holds FROM (VALUES {rows}) t("column", holds)')
    def _(s, d):
        return K.verdicts(_all_kinds(s, d), predicate)


_filter_query("F24_of_type", K.of_type(T.LongType, T.BooleanType), "id", "flag")
for _id, _kind, *_holds in (
    ("F25", "iterable", "name", "list", "pairs"), ("F26", "string", "name"), ("F29", "dictionary", "pairs"), ("F30", "date_time", "at"), ("F31", "time_duration", "lasts"), ("F33", "float", "price"), ("F34", "integer", "id"),
    ("F35", "numeric", "id", "price"), ("F36", "bool", "flag"), ("F37", "alternative", "any"), ("F38", "vector", "list"), ("F45", "tuple", "both"),
):
    _filter_query(f"{_id}_is_{_kind}", K.is_(_kind), *_holds)

#: Python values that the other predicates are asked about.
VALUES = {"name": "abc", "text": "a b", "list": [1], "number": 7, "class": dict, "module": F, "function": len, "lambda": lambda x: x, "instance": K.T.LongType()}
for _id, _kind, *_holds in (
    ("F27", "tag", "name"), ("F28", "symbol", "name", "text"), ("F32", "mutable_vector", "list"), ("F39", "code", "lambda"), ("F40", "class", "class"), ("F41", "object", "name", "text", "list", "number", "instance"),
    ("F42", "instance", "instance"), ("F43", "module", "module"), ("F44", "function", "function", "lambda"),
):
    _rows = ", ".join(f"('{c}', {str(c in _holds).lower()})" for c in VALUES)

    @query(f"{_id}_is_{_kind}", f"SELECT what, holds FROM (VALUES {_rows}) t(what, holds)")
    def _(s, d, kind=_kind):
        return s.createDataFrame([(n, bool(K.VALUE[kind](v))) for n, v in VALUES.items()], "what string, holds boolean")
