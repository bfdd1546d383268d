"""Scratch tables in the shared folder, row keys, and texts packed for a shuffle."""

from __future__ import annotations

import atexit
import gc
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_llm_row"
# rows sent to a Python worker at once: texts can be long, and buffers of a batch are held on both sides
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator run, deleted when the ``with`` block ends.

    A table is written once and read by every later step, so the steps agree even when tasks are retried, and a lost
    executor costs no recomputation. ``result`` keeps a table until the Python process ends. Inside the block, batches
    for Python workers are small.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def __enter__(self) -> Scratch:
        self._batch = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, BATCH_ROWS)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(_BATCH, self._batch)
        delete(self.spark, self.path)
        self.release()

    def folder(self) -> str:
        self._made += 1
        return f"{self.path}/{self._made}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(T.StructType.fromJson(json.loads(df.schema.json()))).parquet(path)
        kept._scratch_path = path
        self.release()
        return kept

    def table(self, df: DataFrame) -> DataFrame:
        return self._write(df, self.folder())

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, df._scratch_path)

    def result(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.path}-result-{self._made}"
        atexit.register(_delete_quietly, self.spark, path)
        return self._write(df, path)

    def release(self) -> None:
        """Spark removes the shuffle files of finished jobs once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


def keyed(docs: DataFrame, scratch: Scratch, keep: bool = False) -> DataFrame:
    """``docs`` with a long ``_llm_row`` that identifies each row.

    ``_llm_row`` is ``doc_id`` where that is an integer, never NULL and unique. Otherwise (NULL ids, repeated rows) the
    rows are numbered and written once, so that every reader sees the same numbers (with ``keep``, as a result).
    """
    docs = docs.drop(ROW)
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        clash = docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
        if clash.isEmpty():
            return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return scratch.result(numbered) if keep else scratch.table(numbered)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = part.column(part.num_columns - 1).to_pylist()
            packed = pa.array([None if t is None else tool.compress(t.encode()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "packed"])


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the compressed ``text`` as ``packed``: texts dominate every shuffle they take part in, and single
    texts compress by more than the shuffle's block compression."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return docs.select(*keys, "text").mapInArrow(_pack, f"{schema}, packed binary")


def unpack(column: pa.Array) -> pa.Array:
    """The texts of a ``packed`` column."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    return pa.array([None if p is None else tool.decompress(p).decode() for p in column.to_pylist()], pa.string())
