"""Contributed files: tables, documents and logger exports."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions.datetimes import parse_logger_time
from cubemerge.functions.values import safe_double
from cubemerge.operators.lookup import attribute_lookup
from cubemerge.session import materialize

CORRUPT = "_corrupt"
# Headers of up to this many files are broadcast: a path and a few names each.
BROADCAST_FILES = 20_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             header: bool = True, skip_rows: int = 0) -> DataFrame:
    """Tabular text. Without a schema every column is text (nothing is inferred from the data); with one, a
    malformed line keeps its text in ``_corrupt``. ``skip_rows`` drops leading lines of every file."""
    if skip_rows:
        return read_delimited(spark, path, sep, header, skip_rows)
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is None:
        return reader.csv(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def _fields(line: str, sep: str) -> list[str]:
    parts = next(csv.reader([line], delimiter=sep), []) if '"' in line else line.split(sep)
    return [x.strip() for x in parts]


def _first_lines(skip: int):
    """Task step over lines in file order: of every file the line after its title lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, 0
        for batch in batches:
            found, paths = [], batch.column(0)
            for (begin, end), path in _runs(paths):
                if path != at:
                    at, seen = path, 0
                if seen <= skip < seen + end - begin:
                    found.append((path, batch.column(1)[begin + skip - seen].as_py()))
                seen += end - begin
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["path", "line"])

    return run


def _runs(paths: pa.Array) -> Iterator[tuple[tuple[int, int], str]]:
    """((first, end), value) of each stretch of one value."""
    codes = paths.dictionary_encode()
    places = codes.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)] if len(places) else [0]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield (first, end), codes.dictionary[int(places[first])].as_py()


def _split(sep: str, drop: int):
    """Task step over lines in file order: the fields of every line but the first ``drop`` of a file and those without any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, 0
        for batch in batches:
            paths, starts, values = batch.columns
            for (first, end), path in _runs(paths):
                start = starts[first].as_py()
                if (path, start) != at:
                    at, seen = (path, start), 0
                # title lines and header stand in the first part of a file
                gone = max(0, min(end - first, drop - seen)) if start == 0 else 0
                texts = values.slice(first + gone, end - first - gone).to_pylist()
                rows = [(k, r) for k, r in enumerate((_fields(t, sep) for t in texts), seen + gone) if any(r)]
                seen += end - first
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(rows), pa.string()), "start": pa.array([start] * len(rows), pa.int64()),
                    "line": pa.array([k for k, _ in rows], pa.int64()), "fields": pa.array([r for _, r in rows], pa.list_(pa.string())),
                })

    return run


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, skip_rows: int = 0, stem: str | None = None, line: str | None = None) -> DataFrame:
    """Delimited files of any size, each with a header of its own: columns go by name, not by place.

    ``skip_rows`` title lines stand above the header of every file. The result has the columns of all headers, in the order of the first file by path
    that has each; a file without a column, or a line that ends early, gives NULL, as does an empty field. All columns are text, stripped; lines without any text are left out.
    Files are read in byte ranges by Spark's text source, on any file system it reaches, so a large file is
    the work of many tasks; a quoted field must not hold a line end. ``stem`` adds the file name without its ending, ``line`` a struct by which lines can be ordered as they stand in the
    files. Without ``header`` the columns are _c0, _c1 and so on, as many as the longest first line has.

    Runs a job over the first part of every file, for the headers: one small row a file, of which the distinct ones come to the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.where("start = 0").select("path", "value").mapInArrow(_first_lines(skip_rows), "path string, line string")
    headers = materialize(first, "headers")
    own: dict[str, list[str]] = {}
    count = 0
    for row in headers.groupBy("line").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).orderBy("path").toLocalIterator():
        count += row["n"]
        fields = _fields(row["line"].removeprefix("\ufeff"), sep)
        own[row["line"]] = fields if header else [f"_c{i}" for i in range(len(fields))]
    names = list(dict.fromkeys(n for fields in own.values() for n in fields if n))
    known = spark.createDataFrame(list(own.items()), "line string, names array<string>")
    places = headers.join(known, "line").select("path", "names")
    rows = lines.mapInArrow(_split(sep, skip_rows + header), "path string, start long, line long, fields array<string>")
    # one row a file: lines keep their place while these can be broadcast
    joined = rows.join(F.broadcast(places) if count <= BROADCAST_FILES else places, "path")
    columns = [F.nullif(F.get("fields", F.array_position("names", n).cast("int") - 1), F.lit("")).alias(n) for n in names]
    if line is not None:
        columns.append(F.struct("path", "start", "line").alias(line))
    if stem is not None:
        columns.append(file_stem(F.col("path")).alias(stem))
    return joined.select(*(columns or [F.col("path").alias("value")]))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """Tabular JSON: an array of records (or one record) per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): one VARIANT document per file; NULL when the text is not JSON."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def file_stem(path: F.Column) -> F.Column:
    """File name without directories and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_glob(spark: SparkSession, pattern: str, sep: str = ",", stem: str = "stem", schema: T.StructType | str | None = None) -> DataFrame:
    """All CSV files of a glob, the file stem as a column; files without rows add none.

    Columns go by the header of each file, a column that a file lacks is NULL. ``schema`` lists the columns as text fields by name; a file with another header then
    fails the read."""
    if schema is None:
        return read_delimited(spark, pattern, sep, stem=stem)
    table = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).schema(schema).csv(pattern)
    return table.select("*", file_stem(F.col("_metadata.file_path")).alias(stem))


def newest_per_key(lists: list[DataFrame], key: str) -> DataFrame:
    """Merge logger lists read with ``modified``: the entry of the newest file wins per key."""
    merged = reduce(DataFrame.unionByName, lists)
    rest = [c for c in merged.columns if c != key]
    best = merged.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("modified")).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


LOGGER_SENSORS = 5


def normalize_loggers(raw: DataFrame, sites: DataFrame, time: str = "dateTime", uid: str = "loggerUid", stem: str = "stem",
                      sensors: int = LOGGER_SENSORS) -> DataFrame:
    """Logger exports to one table with positions.

    Times parsed from three forms (rows without one dropped), all other columns to numbers, moisture from
    percent to a fraction, temperature columns renamed, the file stem as logger id, position by lookup.
    """
    dropped = {"ttlDate", "logDateTime", time, uid, stem}
    timed = raw.withColumn("date_time", parse_logger_time(F.col(time))).where(F.col("date_time").isNotNull())
    columns = [F.col("date_time"), F.col(stem).alias(uid), F.col(uid).alias("fullLoggerUid")]
    renames = {f"s{i}t": f"t{i}" for i in range(1, sensors + 1)} | {"s11t": "t0"}
    moisture = {f"s{i}" for i in range(1, sensors + 1)}
    for name in raw.columns:
        if name in dropped:
            continue
        value = safe_double(F.col(f"`{name}`"))
        columns.append((value / 100 if name in moisture else value).alias(renames.get(name, name)))
    table = timed.select(*columns)
    lookup = sites.withColumnRenamed("logger_id", uid)
    return attribute_lookup(table, lookup, uid, ["latitude", "longitude"])
