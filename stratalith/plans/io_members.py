"""One query for each member of the source, sink, stream, random, assertion and plot families."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from stratalith.functions import random as R
from stratalith.operators import functional, timeseries
from stratalith.plans import checks
from stratalith.plans.catalog import query, table
from stratalith.plans.frame_queries import SER, series
from stratalith.plans.session import shared_dir
from stratalith.sources import csvio as C
from stratalith.streaming import events as E

NATIONS = "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation"


def folder(s) -> str:
    """A new folder in the shared one, as a local path."""
    return tempfile.mkdtemp(prefix="members-", dir=shared_dir(s).removeprefix("file://"))


def nation(s, d):
    return table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def text_file(s, d) -> str:
    """nation as one CSV file."""
    path = f"{folder(s)}/nation.csv"
    with open(path, "w") as f:
        f.writelines(C.csv_chunks(nation(s, d), ["n_nationkey"]))
    return path


def add(name: str, sql: str | None, f: Callable) -> None:
    query(name, sql)(f)


def one(s, **values):
    return s.createDataFrame([tuple(values.values())], list(values))


BYTES = "SELECT sum(length(n_nationkey || ',' || n_name || ',' || n_regionkey) + 1)::BIGINT + length('n_nationkey,n_name,n_regionkey') + 1 AS n FROM nation"
SIZE = lambda df: df.agg(F.sum(F.octet_length("content")).cast("long").alias("n"))
TABLE = "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation"
TYPES = {"types": {"n_nationkey": "double", "n_regionkey": "double"}}
# ------------------------------------------------------------------------------ sources
add("S1_object_store", BYTES, lambda s, d: SIZE(C.load(s, C.Source("file", text_file(s, d)))))
add("S4_file", BYTES, lambda s, d: SIZE(C.load(s, C.Source("file", "file://" + text_file(s, d)))))
add("S5_builtin", "SELECT range AS digit FROM range(10)", lambda s, d: C.load(s, C.Source("builtin", "digits")))
add("S6_descriptor", "SELECT 'text' AS kind, 25 + 1 AS n", lambda s, d: (lambda x: one(s, kind=x.kind, n=C.load(s, x).count()))(C.Source("text", text_file(s, d))))
add("S7_load_external", TABLE, lambda s, d: C.load(s, C.Source("csv", text_file(s, d)), **TYPES))
add("S10_entire_object", BYTES, lambda s, d: SIZE(C.read_bytes(s, text_file(s, d))))
add("S11_object_slice", "SELECT 'nationkey,' AS text", lambda s, d: C.read_slice(s, text_file(s, d), 2, 12).select(F.decode("content", "utf-8").alias("text")))
add("S12_file_slice", BYTES.replace(" AS n", " - 100 AS n"), lambda s, d: SIZE(C.load(s, C.Source("file", text_file(s, d), 100, None))))
add("S13_file_slices", BYTES, lambda s, d: SIZE(C.read_slices(s, text_file(s, d), 100)))
add("S14_numbered_objects", "SELECT 'a_2,a_10' AS names", lambda s, d: one(s, names=",".join(C.numbered_files(["a_10", "a_2", "b_1", "a_x"], "a"))))
add("S16_tsv", TABLE, lambda s, d: C.read_csv(s, nation(s, d).select(F.concat_ws("\t", *nation(s, d).columns)), columns=nation(s, d).columns, has_headers=False, sep="\t", **TYPES))
add("S17_separated", TABLE, lambda s, d: C.read_csv(s, nation(s, d).select(F.concat_ws("|", *nation(s, d).columns)), columns=nation(s, d).columns, has_headers=False, sep="|", **TYPES))
add("S18_headers", "SELECT unnest(['a', 'b c', 'd']) AS name", lambda s, d: s.createDataFrame([(h,) for h in C.headers('a, "b c" ,d\n1,2,3\n')], "name string"))
add("S19_scan_over_range", "SELECT n_name FROM nation", lambda s, d: C.read_csv(s, text_file(s, d)).select("n_name"))
add("S20_make_column", "SELECT n_nationkey * 2.0::DOUBLE AS y FROM nation", lambda s, d: C.read_csv(s, text_file(s, d), types={"n_nationkey": lambda c: c.cast("double") * 2}).select(F.col("n_nationkey").alias("y")))
add("S21_is_na", "SELECT x, x IN ('', 'na', 'NA') AS y FROM (VALUES ('1'), (''), ('na'), ('NA')) t(x)", lambda s, d: s.createDataFrame([("1",), ("",), ("na",), ("NA",)], "x string").select("x", F.isnan(C.as_float(F.col("x"))).alias("y")))
add("S22_csv_from_string", "SELECT * FROM (VALUES (1.0::DOUBLE, 2.0::DOUBLE), (3.0, 4.5)) t(a, b)", lambda s, d: C.read_csv_text(s, "a,b\n1,2\n\n3,4.5\n6,7,8"))
add("S23_import_object", "SELECT count(*) + 1 AS n FROM nation", lambda s, d: one(s, n=C.read_text(s, text_file(s, d)).count()))
add("S25_import_remote", BYTES, lambda s, d: C.read_text(s, text_file(s, d), whole=True).select(F.octet_length("value").cast("long").alias("n")))
add("S26_pure_datasets", "SELECT count(*) + 1 AS n FROM nation", lambda s, d: C.load(s, C.Source("text", text_file(s, d))).agg(F.count("*").alias("n")))


def served(s, d):
    """The text of nation from a server of our own, on this machine."""
    with open(text_file(s, d), "rb") as f:
        body = f.read()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        n = SIZE(C.load(s, C.Source("http", (f"http://127.0.0.1:{server.server_port}/nation",)))).first().n
    finally:
        server.shutdown()
    return one(s, n=n)


def database(s, d):
    """nation in a database that every executor can read, by JDBC: a Derby one, written here by the driver and packed, as only packed ones open in several processes."""
    at, jvm, driver = folder(s), s.sparkContext._jvm, "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    connect = lambda how: jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"jdbc:derby:{at}/db;{how}", jvm.java.util.Properties())
    link = connect("create=true")
    link.createStatement().execute('CREATE TABLE nation ("n_nationkey" INTEGER NOT NULL, "n_name" CLOB, "n_regionkey" INTEGER)')
    insert = link.prepareStatement("INSERT INTO nation VALUES (?, ?, ?)")
    for r in nation(s, d).toLocalIterator():
        insert.setInt(1, r.n_nationkey)
        insert.setString(2, r.n_name)
        insert.setInt(3, r.n_regionkey)
        insert.executeUpdate()
    link.close()
    try:
        connect("shutdown=true")
    except Py4JJavaError as e:  # how Derby says that it is down
        if e.java_exception.getSQLState() != "08006":
            raise
    shutil.make_archive(f"{at}/nation", "zip", at, "db")
    return C.load(s, C.Source("sql", (f"jdbc:derby:jar:({at}/nation.zip)db", "SELECT * FROM nation WHERE \"n_regionkey\" > 1")), driver=driver)


add("S3_odbc", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 1", database)
add("S9_odbc_request", "SELECT n_name FROM nation WHERE n_regionkey > 1", lambda s, d: database(s, d).select("n_name"))
add("S2_http", BYTES, served)
add("S8_http_request", BYTES, served)
# ------------------------------------------------------------------------------ sinks


def exported(s, d):
    e = C.Export(C.csv_lines(nation(s, d)), f"{folder(s)}/out").run()
    return s.read.text(e.path).select(F.col("value").alias("line"))


def parts(s, d):
    path = f"{folder(s)}/whole"
    w = C.MultipartWriter(path)
    lines = [r.line for r in C.csv_lines(nation(s, d), ["n_nationkey"]).collect()]
    for k in (2, 0, 1, 1):  # parts come in any order, and again
        w.write_part(k, "".join(x + "\n" for x in lines[k * 10 : k * 10 + 10]).encode())
    before = os.path.exists(path)
    w.complete()
    return path, before


add("S24_export", NATIONS, exported)
add("S27_export_status", "SELECT unnest(['finished', 'failed']) AS status", lambda s, d: s.createDataFrame([(C.Export(C.csv_lines(nation(s, d)), p).run().status,) for p in (f"{folder(s)}/out", "nowhere://x/y")], "status string"))
add("S28_multipart_begin", "SELECT false AS seen", lambda s, d: one(s, seen=parts(s, d)[1]))
add("S29_multipart_part", NATIONS, lambda s, d: s.read.text(parts(s, d)[0]).select(F.col("value").alias("line")))
add("S30_multipart_complete", "SELECT count(*) AS n FROM nation", lambda s, d: s.read.text(parts(s, d)[0]).agg(F.count("*").alias("n")))
add("S31_persist", "SELECT n_nationkey, n_name, n_regionkey FROM nation", lambda s, d: C.persist(nation(s, d), f"{folder(s)}/kept"))
add("S33_vector_stream", "SELECT n_name AS line FROM nation", lambda s, d: C.vector_lines(nation(s, d), "n_name"))
add("S34_tuple_stream", "SELECT n_nationkey || ',' || n_name AS line FROM nation", lambda s, d: C.tuple_lines(nation(s, d).select(F.struct("n_nationkey", "n_name").alias("t")), ["t"]))
add("S35_tuples_stream", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation", lambda s, d: C.tuple_lines(nation(s, d).select(F.struct("n_nationkey", "n_name").alias("t"), F.struct("n_regionkey").alias("u")), ["t", "u"]))
# ------------------------------------------------------------------------------ streams
LINES = "SELECT o_orderkey || ',' || o_custkey AS line FROM orders"


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey")


add("X2_stream_chunks", LINES, lambda s, d: C.csv_chunk_frame(orders(s, d), ["o_orderkey"]).select(F.explode(F.split(F.expr("left(text, length(text) - 1)"), "\n")).alias("line")).where("line <> 'o_orderkey,o_custkey'"))
add("X3_get_chunk", f"SELECT line FROM (SELECT o_orderkey || ',' || o_custkey AS line, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 500 AND i < 1000", lambda s, d: C.chunk(orders(s, d), ["o_orderkey"], 1, 500))
add("X4_chunk_count", "SELECT ceil(count(*) / 10000.0)::BIGINT AS n FROM orders", lambda s, d: one(s, n=C.chunk_count(orders(s, d).count())))
add("X5_tuple_chunk", "SELECT line FROM (SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i >= 10 AND i < 20", lambda s, d: C.chunk(nation(s, d), ["n_nationkey"], 1, 10))
add("X6_pull_series", f"SELECT series, t, max(x) OVER (PARTITION BY series ORDER BY t) AS x FROM ({SER})", lambda s, d: timeseries.coiterate(series(s, d), "series", "t", _running_max, "series long, t double, x double"))
add("X8_future", "SELECT count(*) AS n, 'refused' AS error FROM nation", lambda s, d: _futures(s, d))
add("X1_late_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", lambda s, d: E.windowed(table(s, d, "events"), "ts", "value", "1 day").select("start", "n", F.round("total", 4).alias("total")))


def _running_max(rows):
    top = -math.inf
    for r in rows:
        top = max(top, r["x"])
        yield r["series"], r["t"], top


def _futures(s, d):
    def refuse():
        raise ValueError("refused")

    bad = functional.submit(refuse)
    try:
        bad.result()
    except ValueError as e:
        error = str(e)
    return one(s, n=functional.submit(lambda: nation(s, d).count()).result(), error=error)


# ------------------------------------------------------------------------------ random columns: mean and variance of 40,000 draws against theory
N = 40_000
EULER = 0.5772156649015329
#: id, name: draws, mean, variance (None: there is none; then the median)
DRAWS = {
    "R2_binomial": (lambda k: R.binomial(k, 8, 0.3), 2.4, 1.68), "R3_cauchy": (lambda k: R.cauchy(k, 2.0, 1.0), 2.0, None), "R4_chi_squared": (lambda k: R.chi_squared(k, 3), 3.0, 6.0), "R5_exponential": (lambda k: R.exponential(k, 2.0), 0.5, 0.25),
    "R6_extreme_value": (lambda k: R.extreme_value(k, 1.0, 2.0), 1 + 2 * EULER, 4 * math.pi**2 / 6), "R7_f": (lambda k: R.f_ratio(k, 4, 12), 1.2, 2 * 144 * 14 / (4 * 100 * 8)), "R8_gamma": (lambda k: R.draw("gamma", k, 2.0, 1.5), 3.0, 4.5), "R9_geometric": (lambda k: R.geometric(k, 0.3), 0.7 / 0.3, 0.7 / 0.09),
    "R10_hypergeometric": (lambda k: R.draw("hypergeometric", k, 10, 20, 6), 2.0, 6 * (1 / 3) * (2 / 3) * 24 / 29), "R11_inverse_chi_squared": (lambda k: R.inverse_chi_squared(k, 9), 1 / 7, 2 / (49 * 5)), "R12_inverse_gamma": (lambda k: R.draw("inverse_gamma", k, 6.0), 0.2, 1 / (25 * 4)),
    "R13_inverse_gaussian": (lambda k: R.draw("inverse_gaussian", k, 1.0, 3.0), 1.0, 1 / 3), "R14_log_normal": (lambda k: R.log_normal(k, 0.0, 0.5), math.exp(0.125), (math.exp(0.25) - 1) * math.exp(0.25)), "R15_logistic": (lambda k: R.logistic(k, 1.0, 2.0), 1.0, 4 * math.pi**2 / 3),
    "R18_negative_binomial": (lambda k: R.draw("negative_binomial", k, 4, 0.4), 6.0, 15.0), "R19_noncentral_chi_squared": (lambda k: R.draw("noncentral_chi_squared", k, 3.0, 2.0), 5.0, 14.0), "R20_normal": (lambda k: R.normal(k, 1.0, 2.0), 1.0, 4.0), "R21_poisson": (lambda k: R.draw("poisson", k, 3.5), 3.5, 3.5),
    "R22_rayleigh": (lambda k: R.rayleigh(k, 2.0), 2 * math.sqrt(math.pi / 2), 4 * (2 - math.pi / 2)), "R23_scaled_inverse_chi_squared": (lambda k: R.scaled_inverse_chi_squared(k, 9, 2.0), 18 / 7, 2 * 81 * 4 / (49 * 5)), "R24_t": (lambda k: R.student_t(k, 10), 0.0, 10 / 8), "R25_triangular": (lambda k: R.triangular(k, 0, 1, 3), 4 / 3, 7 / 18),
    "R26_uniform_real": (lambda k: R.uniform_real(k, -1.0, 3.0), 1.0, 16 / 12), "R27_weibull": (lambda k: R.weibull(k, 2.0), math.gamma(1.5), math.gamma(2) - math.gamma(1.5) ** 2), "R1_beta": (lambda k: R.draw("beta", k, 2.0, 3.0), 0.4, 6 / (25 * 6)),
}


def _fits(s, f, mean, var):
    d = s.range(N).select("id", f(F.col("id")).cast("double").alias("x"))
    r = d.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.percentile_approx("x", 0.5, 10_000).alias("h")).first()
    if var is None:
        return one(s, n=r.n, place=abs(r.h - mean) < 0.05, spread=True)
    return one(s, n=r.n, place=abs(r.m - mean) < 5 * math.sqrt(var / N), spread=abs(r.v / var - 1) < 0.25)


for _name, (_f, _mean, _var) in DRAWS.items():
    add(_name, f"SELECT {N} AS n, true AS place, true AS spread", lambda s, d, f=_f, m=_mean, v=_var: _fits(s, f, m, v))
# the published first word for seed 5489, and words of the recurrence worked out by hand
add("R16_mersenne_twister", "SELECT 3499211612 AS word", lambda s, d: one(s, word=int(R.MersenneTwister(5489).uint32(1)[0])))
add("R17_multiply_with_carry", "SELECT ((4294957665::HUGEINT * 7 + 362436)::HUGEINT % 4294967296)::BIGINT AS a", lambda s, d: one(s, a=R.multiply_with_carry(7, 1)[0]))
add("R28_random_state", "SELECT '0.374540' AS a, '0.950714' AS b", lambda s, d: (lambda v: one(s, a=f"{v[0]:.6f}", b=f"{v[1]:.6f}"))(R.MersenneTwister(42).rand(2)))

# ------------------------------------------------------------------------------ assertions and plots


def _holds(s, good: Callable, bad: Callable):
    good()
    try:
        bad()
    except AssertionError:
        return one(s, holds=True)
    return one(s, holds=False)


HOLDS = "SELECT true AS holds"
nan = float("nan")
add("Z1_frames_equal", HOLDS, lambda s, d: _holds(s, lambda: checks.assert_frames_equal(nation(s, d), nation(s, d).orderBy("n_name")), lambda: checks.assert_frames_equal(nation(s, d), nation(s, d).where("n_nationkey > 1"))))
add("Z2_series_equal", HOLDS, lambda s, d: _holds(s, lambda: checks.assert_series_equal([1.0, nan], [1.0, nan]), lambda: checks.assert_series_equal([1.0], [2.0])))
add("Z3_rows_equal", HOLDS, lambda s, d: (lambda r: _holds(s, lambda: checks.assert_rows_equal(r[0], r[0]), lambda: checks.assert_rows_equal(r[0], r[1])))(nation(s, d).limit(2).collect()))
add("Z4_equal", HOLDS, lambda s, d: _holds(s, lambda: (checks.assert_equal(nan, nan), checks.assert_not_equal(1, 2)), lambda: checks.assert_equal(1, 2)))
add("Z5_close", HOLDS, lambda s, d: _holds(s, lambda: checks.assert_close([1.0, 2.0], [1.000001, 2.0]), lambda: checks.assert_close(1.0, 1.1)))


def _summed(s, p, *lists):
    return one(s, kind=p["kind"], total=float(sum(sum(x) for x in lists)))


PART = "SELECT '{}' AS kind, ({})::DOUBLE AS total FROM part"
NAT = PART.replace("part", "nation")
add("Z6_line_plot", NAT.format("line", "sum(n_nationkey + n_regionkey)"), lambda s, d: (lambda p: _summed(s, p, p["x"], p["series"]["n_regionkey"]))(checks.line_plot(nation(s, d), "n_nationkey", "n_regionkey")))
add("Z7_scatter_plot", NAT.format("scatter", "sum(n_nationkey + n_regionkey)"), lambda s, d: (lambda p: _summed(s, p, p["x"], p["y"]))(checks.scatter_plot(nation(s, d), "n_nationkey", "n_regionkey")))
add("Z8_bar_plot", NAT.format("bar", "sum(n_regionkey)"), lambda s, d: (lambda p: _summed(s, p, p["values"]))(checks.bar_plot(nation(s, d), "n_name", "n_regionkey")))
add("Z9_histogram_plot", "SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS b, count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY 1", lambda s, d: s.createDataFrame([(i, n) for i, n in enumerate(checks.histogram_plot(table(s, d, "part"), "p_retailprice")["counts"]) if n], "b long, n long"))
add("Z10_surface_plot", NAT.format("surface", "sum(n_nationkey * 2 + n_regionkey)"), lambda s, d: (lambda p: _summed(s, p, p["x"], p["y"], p["z"]))(checks.surface_plot(nation(s, d), "n_nationkey", "n_regionkey", "n_nationkey")))
add("Z11_sparkline", "SELECT '▁▃▅█' AS line", lambda s, d: one(s, line=checks.sparkline([0, 2.5, 5.0, 9.0])))
add("Z12_bmp", "SELECT 54 + 2 * 8 AS n, 'BM' AS head", lambda s, d: (lambda b: one(s, n=len(b), head=b[:2].decode()))(checks.bmp([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 9, 9)]])))
add("Z13_layout", "SELECT 'stack' AS kind, 2 AS panes", lambda s, d: (lambda x: one(s, kind=x["layout"], panes=len(x["panes"])))(checks.layout("stack", {}, checks.layout("pane", {}))))
add("Z14_grid", "SELECT '+---+----+' AS rule, 5 AS lines", lambda s, d: (lambda t: one(s, rule=t[0], lines=len(t)))(checks.grid([["a", "bb"], [1, 2]]).split("\n")))
