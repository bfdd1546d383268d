"""Message files of a folder that all executors have mounted: found and read in tasks.

Spark's file source keeps the path and the status of every file on the driver, several times over: about 3 KB a file. Here one task walks the folder and
writes what it finds, files listed before are told by a join, and each batch of new files is a part of a table. The driver holds only the number of batches.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubemerge.operators.blocks import with_position
from cubemerge.session import materialize, scratch_scope
from cubemerge.sources.store import Files

LISTED = "path string, modificationTime timestamp"
TURN = "files long"
# as in Spark's file source: of a file that is so many microseconds older than the newest one listed nothing is remembered, and it is not taken
REMEMBERED = 7 * 86400 * 1_000_000
# rows and bytes in a batch of a task
ROWS, BYTES = 1000, 1 << 23
# files that one task reads: at least, and at most where there are more than tasks for all cores
FEW, MANY, TASKS_A_CORE = 16, 8192, 4
_SCHEME = "file:"


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder on a mounted file system; None for anything else: other file systems, patterns, what is no folder."""
    if set(folder) & set("*?[]{}\\"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" and fs.exists(path) and fs.getFileStatus(path).isDirectory() else None


def _hidden(name: str) -> bool:
    """Names that Spark's sources pass over."""
    return (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def _files(folder: str) -> Iterator[tuple[str, int]]:
    """Path and time (microseconds, whole milliseconds) of every file below a folder."""
    folders = [folder]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    folders.append(entry.path)
                elif entry.is_file():
                    try:
                        yield _SCHEME + entry.path, entry.stat().st_mtime_ns // 1_000_000 * 1000
                    except FileNotFoundError:
                        continue


def found(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime) of the files below a mounted folder."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, times = [], []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "modificationTime"])
            paths.clear(), times.clear()
            return made

        for batch in batches:
            for _ in range(batch.num_rows):
                for path, time in _files(folder):
                    paths.append(path)
                    times.append(time)
                    if len(paths) == ROWS:
                        yield rows()
        yield rows()

    return spark.range(0, 1, 1, 1).mapInArrow(walk, LISTED)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, contents, size = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open(path.removeprefix(_SCHEME), "rb") as handle:
                data = handle.read()
            # as in Spark's file source, an empty file is no row
            if data:
                paths.append(path)
                contents.append(data)
                size += len(data)
            if size >= BYTES or len(paths) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


def read_files(paths: DataFrame, files: int) -> DataFrame:
    """(path, content) of the ``files`` files named in ``paths``, by about as many tasks as there are cores."""
    cores = paths.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(math.ceil(files / FEW), max(TASKS_A_CORE * cores, math.ceil(files / MANY))))
    return paths.select("path").repartition(tasks).mapInArrow(_contents, "path string, content binary")


class Listing:
    """The files of a mounted folder as a stream has taken them: ``files``, a table of paths by batch, and ``turns``, one small file a batch.

    ``turns`` is what the stream reads, one file in each micro-batch; batch ``n`` of the stream is batch ``n`` of the table, so one that is repeated gets the same
    files. A batch exists once its turn is there; what a failed listing left behind is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, root: str, files_per_batch: int):
        self.spark, self.folder, self.most = spark, folder, files_per_batch
        self.store = Files(spark, root)
        self.turns, self.table = f"{self.store.root}/turns", f"{self.store.root}/files"
        self.store.mkdirs("turns")
        self.batches = 1 + max((int(n.split(".")[0]) for n in self.store.names("turns") if n.endswith(".json")), default=-1)
        for name in self.store.names("files"):
            if name.startswith("batch=") and int(name.split("=")[1]) >= self.batches:
                self.store.delete(f"files/{name}")

    def extend(self) -> int:
        """Walk the folder and add batches of the files that are new, oldest first; returns their number."""
        with scratch_scope(self.spark):
            new = found(self.spark, self.folder)
            if self.batches:
                before = self.spark.read.schema(f"{LISTED}, batch long").parquet(self.table)
                time = F.unix_micros("modificationTime")
                since = before.agg(F.max(time)).first()[0] - REMEMBERED
                new = new.where(time >= since).join(before.where(time >= since).select("path"), "path", "left_anti")
            new = materialize(new, "found")
            count = new.count()
            some = math.ceil(count / self.most)
            if some > 1:
                number = F.call_function("div", F.col("_at"), F.lit(self.most)) + self.batches
                new = with_position(new, ["modificationTime", "path"], "_at", rows=count).withColumn("batch", number).drop("_at")
            if count:
                placed = new if some > 1 else new.withColumn("batch", F.lit(self.batches).cast("long"))
                placed.write.mode("append").partitionBy("batch").parquet(self.table)
        for k in range(some):
            self.store.publish_json(f"turns/{self.batches:010d}.json", {"files": min(self.most, count - k * self.most)})
            self.batches += 1
        return some

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        """(path, content) of the files of a batch."""
        paths = spark.read.schema(LISTED).parquet(f"{self.table}/batch={batch}")
        return read_files(paths, self.store.read_json(f"turns/{batch:010d}.json")["files"])
