"""Strict CSV reading and chunked CSV export; other sources and sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def headers(text: str, sep: str = ",") -> list[str] | None:
    """The header row, stripped of blanks and quotes; None for no text."""
    row = next(csv.reader(io.StringIO(text), delimiter=sep), None)
    return [h.strip().strip('"') for h in row] if row else None


def as_float(c: Column, kind: str = "double") -> Column:
    """"", na and NA are NaN; what is no number is an error (ANSI cast)."""
    t = F.trim(c)
    return F.when(c.isNull() | t.isin("", "na", "NA"), F.lit(float("nan"))).otherwise(t).cast(kind)


def read_csv(spark: SparkSession, path, columns: list[str] | None = None, types: dict[str, str | Callable[[Column], Column]] | None = None, default: str | Callable[[Column], Column] = "string", has_headers: bool = True, sep: str = ",") -> DataFrame:
    """Files (or a DataFrame of lines) as a frame.

    Blank lines and rows with too many fields are dropped; cells are stripped. A
    type is string, double, float, or a function of the string column; a cell
    that cannot be converted stops the read.
    """
    if columns is None:
        if not has_headers:
            raise ValueError("without headers the column names have to be given")
        first = path.first() if isinstance(path, DataFrame) else spark.read.text(path).first()
        columns = headers(first[0], sep) if first else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).option("header", has_headers).option("sep", sep).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if isinstance(path, DataFrame):
        raw = _parsed(path, columns, schema, sep, has_headers)
    else:
        raw = reader.option("multiLine", True).csv(path)
    # a short row is marked too, but has its last field null; a long one has all its fields
    keep = F.col("_bad").isNull() | F.col(f"`{columns[-1]}`").isNull() if columns else F.lit(True)
    out = []
    for c in columns:
        kind = (types or {}).get(c, default)
        col = F.col(f"`{c}`")
        out.append((kind(col) if callable(kind) else as_float(col, kind) if kind in ("double", "float") else F.coalesce(col, F.lit("")) if kind == "string" else F.trim(col).cast(kind)).alias(c))
    return raw.where(keep).select(*out)


def _parsed(lines: DataFrame, columns: list[str], schema: T.StructType, sep: str, has_headers: bool) -> DataFrame:
    """Lines (the first column) parsed by Spark's own reader, a line a record; every line equal to the header is left out."""
    c = F.col(f"`{lines.columns[0]}`")
    kept = lines.where(F.length(F.trim(c)) > 0)
    if has_headers:
        first = lines.first()
        kept = kept.where(c != F.lit(first[0])) if first else kept
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    return kept.select(F.from_csv(c, ddl, options).alias("r")).select("r.*")


def read_csv_text(spark: SparkSession, text: str, **how) -> DataFrame:
    """A string as a frame; every column double unless `default` says otherwise."""
    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "line string")
    return read_csv(spark, lines, default=how.pop("default", "double"), **how)


def csv_lines(df: DataFrame, order: list | None = None) -> DataFrame:
    """Each row as one CSV line (column `line`)."""
    d = df.orderBy(*order) if order else df
    return d.select(_line(df.columns))


def _line(columns: list[str]) -> Column:
    return F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns)).alias("line")


def csv_chunk_frame(df: DataFrame, order: list | None = None, rows: int = 10_000) -> DataFrame:
    """chunk, text: the chunks of csv_chunks(), made by tasks and kept by them. The order has to be total; without one, rows are as they come."""
    from stratalith.operators.order import with_index

    d = with_index(df, *order, name="_ix") if order else with_index(df.withColumn("_came", F.monotonically_increasing_id()), "_came", name="_ix")
    lines = d.select((F.col("_ix") + 1).alias("_ix"), _line(df.columns))
    head = df.sparkSession.range(1).select(F.col("id").alias("_ix"), F.lit(",".join(df.columns)).alias("line"))
    chunks = lines.unionByName(head).groupBy(F.expr(f"_ix div {int(rows)}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_ix", "line"))).alias("lines"))
    return chunks.select("chunk", F.concat(F.array_join("lines.line", "\n"), F.lit("\n")).alias("text"))


def csv_chunks(df: DataFrame, order: list | None = None, rows: int = 10_000) -> Iterator[str]:
    """CSV text in chunks, the header in the first; partitions are streamed to the caller one at a time. What stays in Spark uses csv_chunk_frame()."""
    chunk = [",".join(df.columns)]
    for r in csv_lines(df, order).toLocalIterator():
        chunk.append(r.line)
        if len(chunk) >= rows:
            yield "\n".join(chunk) + "\n"
            chunk = []
    if chunk:
        yield "\n".join(chunk) + "\n"


def write_csv(df: DataFrame, path: str, rows: int = 10_000) -> None:
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (local, shared or object store) as path, content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def read_sql(spark: SparkSession, url: str, query: str, **properties: str) -> DataFrame:
    return spark.read.jdbc(url, f"({query}) q", properties=properties)


def read_http(spark: SparkSession, urls: list[str], timeout: float = 60.0) -> DataFrame:
    """url, content of each address; anything but 200 is an error. Fetched by the executors."""
    from urllib.request import urlopen

    def fetch(batches):
        for b in batches:
            out = []
            for u in b["url"]:
                with urlopen(u, timeout=timeout) as r:  # noqa: S310
                    if r.status != 200:
                        raise OSError(f"{u}: {r.status}")
                    out.append(r.read())
            yield b.assign(content=out)

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls))).mapInPandas(fetch, "url string, content binary")


# ---------------------------------------------------------------- slices, descriptors, export


@dataclass(frozen=True)
class Source:
    """What a dataset is read from: kind (file, text, csv, sql, http, builtin), where, and for a file a byte range."""

    kind: str
    where: str | tuple[str, ...]
    low: int | None = None
    high: int | None = None


#: Named datasets of the library: name -> a function of the session.
BUILTIN: dict[str, Callable[[SparkSession], DataFrame]] = {"digits": lambda spark: spark.range(10).select(F.col("id").alias("digit"))}


def load(spark: SparkSession, source: Source, **how) -> DataFrame:
    """A source as a frame, by its kind."""
    if source.kind == "file":
        return read_bytes(spark, source.where) if source.low is None else read_slice(spark, source.where, source.low, source.high)
    if source.kind == "builtin":
        if source.where not in BUILTIN:
            raise KeyError(source.where)
        return BUILTIN[source.where](spark)
    readers = {"text": read_text, "csv": read_csv, "sql": read_sql, "http": lambda s, urls: read_http(s, list(urls))}
    if source.kind not in readers:
        raise ValueError(f"no source of kind {source.kind}")
    return readers[source.kind](spark, *source.where, **how) if source.kind == "sql" else readers[source.kind](spark, source.where, **how)


def byte_slices(size: int, chunk: int) -> list[tuple[int, int]]:
    """Ranges of `chunk` bytes; a last one of under half of that is a part of the one before."""
    cuts = list(range(0, size, chunk)) or [0]
    if len(cuts) > 1 and size - cuts[-1] < chunk / 2:
        cuts.pop()
    return list(zip(cuts, cuts[1:] + [size]))


def _open(path: str):
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"a mounted folder is needed for byte ranges, not {path}")
    return open(path.removeprefix("file://"), "rb")


def read_slice(spark: SparkSession, path: str, low: int, high: int | None = None) -> DataFrame:
    """path, low, content of the bytes [low, high), read by a task."""
    return _read_ranges(spark, [(path, low, high)])


def read_slices(spark: SparkSession, path: str, chunk: int = 50 << 20) -> DataFrame:
    """A file in byte ranges, each read by a task of its own."""
    import os

    size = os.path.getsize(path.removeprefix("file://"))
    return _read_ranges(spark, [(path, lo, hi) for lo, hi in byte_slices(size, chunk)])


def _read_ranges(spark: SparkSession, ranges: list[tuple]) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for path, low, high in zip(b["path"], b["low"], b["high"]):
                with _open(path) as f:
                    f.seek(int(low))
                    out.append(f.read() if high < 0 else f.read(int(high) - int(low)))
            yield b[["path", "low"]].assign(content=out)

    rows = [(p, lo, -1 if hi is None else hi) for p, lo, hi in ranges]
    return spark.createDataFrame(rows, "path string, low long, high long").repartition(max(1, len(rows))).mapInPandas(run, "path string, low long, content binary")


def numbered_files(paths: list[str], prefix: str) -> list[str]:
    """Of the paths those that are prefix_<number>, in the numbers' order."""
    import re

    found = [(int(m.group(1)), p) for p in paths if (m := re.fullmatch(re.escape(prefix) + r"_([0-9]+)", p))]
    return [p for _, p in sorted(found)]


class Export:
    """A write of text lines that can be asked how it went: waiting, finished or failed."""

    def __init__(self, lines: DataFrame, path: str):
        self.lines, self.path, self.status, self.error = lines, path, "waiting", None

    def run(self) -> Export:
        try:
            self.lines.select(F.col(self.lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(self.path)
            self.status = "finished"
        except Exception as e:  # kept for whoever asks
            self.status, self.error = "failed", e
        return self


class MultipartWriter:
    """Parts of one file: each is written under its number, and complete() puts them in place at once.

    Parts of equal number replace one another; until complete() no reader sees any.
    """

    def __init__(self, path: str):
        import os

        self.path, self.staging, self.parts = path.removeprefix("file://"), path.removeprefix("file://") + ".parts", set()
        os.makedirs(self.staging, exist_ok=True)

    def write_part(self, number: int, data: bytes) -> None:
        import os

        name = f"{self.staging}/{number:09d}"
        with open(name + ".new", "wb") as f:
            f.write(data)
        os.replace(name + ".new", name)
        self.parts.add(number)

    def complete(self) -> None:
        import os
        import shutil

        with open(self.path + ".new", "wb") as out:
            for n in sorted(self.parts):
                with open(f"{self.staging}/{n:09d}", "rb") as part:
                    shutil.copyfileobj(part, out)
        os.replace(self.path + ".new", self.path)
        shutil.rmtree(self.staging)


def persist(df: DataFrame, path: str) -> DataFrame:
    """Write a frame and give back what reads it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def vector_lines(df: DataFrame, column: str) -> DataFrame:
    """One value a line."""
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("line"))


def tuple_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tuples (structs of equal fields by position) as CSV lines, all columns' fields side by side."""
    fields = [F.col(f"{c}.{f.name}") for c in columns for f in df.schema[c].dataType]
    return df.select(F.concat_ws(",", *(F.coalesce(x.cast("string"), F.lit("")) for x in fields)).alias("line"))


def chunk_count(rows: int, size: int = 10_000) -> int:
    """Chunks of an export: one at least where there is a row."""
    return -(-rows // size)


def chunk(df: DataFrame, order: list, i: int, rows: int = 10_000) -> DataFrame:
    """The lines of chunk i in the order, without those before: a range of row positions."""
    from stratalith.operators.order import with_index

    d = with_index(df, *order, name="_ix").where((F.col("_ix") >= i * rows) & (F.col("_ix") < (i + 1) * rows))
    return csv_lines(d.drop("_ix"))
