"""Continuous ingest: message files -> validated, routed, extracted and merged, or into the dead-letter table.

A message is a data file with a ``<name>.meta.json`` next to it, or a row of a queue table. Files of a mounted queue are listed and read in tasks, those
of another file system by the Structured Streaming file source; each micro-batch goes through ``foreachBatch``. Merging is keyed by coordinates and
``_done`` remembers finished messages, so a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

import csv
import io
import math
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cubemerge.functions.text import content_kind
from cubemerge.session import materialize, scratch_scope
from cubemerge.sources.store import Files, Store
from cubemerge.streaming.listing import TURN, Listing, found, mounted, read_files
from cubemerge.streaming.messages import METADATA, failure_summary, reject_reason, route

SIDECAR = ".meta.json"
# folder of a checkpoint
LISTED_FILES = "listing"
SIDECAR_END = r"\.meta\.json$"
FILE_TYPE = "path string, modificationTime timestamp, length long, content binary"
DEAD_LETTER = "path string, node string, reason string, content binary, metadata_json string, at timestamp, run string, batch long"
WAITING = "path string, content binary, metadata_json string, since timestamp"
ENVELOPE = "name string, content binary, metadata string"
# batch numbers of the stream and of replays are apart
STREAM, REPLAY = "stream", "replay"
ROW = "_order"
ERROR = "_error"
# lines of CSV payloads in a batch of an extractor
LINES = 10_000
# Message files are many and small. Spark's defaults list them in up to 10,000 tasks and read 32 of them in a task, so that starting tasks takes longer than their work.
LISTING, OPEN_COST = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
LISTING_TASKS_A_CORE, OPEN_COST_BYTES = 4, 1 << 16

Extractor = Callable[[DataFrame], DataFrame]


@dataclass
class Extractors:
    """Named extractors: a DataFrame of messages (path, content, metadata) to a table that still has ``path``."""

    functions: dict[str, Extractor] = field(default_factory=dict)

    def register(self, name: str) -> Callable[[Extractor], Extractor]:
        def add(function: Extractor) -> Extractor:
            self.functions[name] = function
            return function

        return add

    def register_python(self, name: str, function: Callable[[bytes, dict[str, Any]], pd.DataFrame], schema: str) -> None:
        """An opaque Python function of one payload and its metadata, run per message inside the tasks.

        An exception sets aside that message only.
        """
        full = T.StructType(T.StructType.fromDDL(schema).fields + [T.StructField("path", T.StringType()), T.StructField(ERROR, T.StringType())])

        def run(messages: DataFrame) -> DataFrame:
            def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                import json

                for batch in batches:
                    for path, content, meta in zip(batch["path"], batch["content"], batch["metadata_json"]):
                        try:
                            table = function(content, json.loads(meta or "{}")).assign(path=path, **{ERROR: None})
                        except Exception as problem:
                            table = pd.DataFrame({"path": [path], ERROR: [f"{type(problem).__name__}: {problem}"]})
                        yield table.reindex(columns=full.names).astype(object).where(lambda t: t.notna(), None)

            return messages.select("path", "content", "metadata_json").mapInPandas(apply, full)

        self.functions[name] = run

    def csv(self, name: str, schema: str, sep: str = ",", header: bool = True) -> None:
        """Tabular CSV payloads, columns by the names in the header (by position without one).

        A header that lacks a column of the schema makes the message fail. A line with another number of fields than the
        header, or with a text that its column's type cannot hold, is dropped. Quoted fields may hold line ends.
        """
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
        written = ", ".join(f"`{n}` string" for n in kinds)
        out = pa.schema([("path", pa.string()), ("_line", pa.int64()), *[(n, pa.string()) for n in kinds], (ERROR, pa.string())])

        def parsed(path: str, content: bytes | None) -> Iterator[tuple[Any, ...]]:
            lines = [r for r in csv.reader(io.StringIO((content or b"").decode("utf-8-sig", "replace")), delimiter=sep) if any(x.strip() for x in r)]
            names = [n.strip() for n in lines[0]] if header and lines else list(kinds)
            lacking = [n for n in kinds if n not in names]
            if lacking:
                yield (path, None, *[None] * len(kinds), f"columns not in the header: {lacking}")
                return
            at = [names.index(n) for n in kinds]
            for k, r in enumerate(lines):
                if k >= header and len(r) == len(names):
                    yield (path, k, *[r[i].strip() or None for i in at], None)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the lines of many small messages make one batch
            rows = (r for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for r in parsed(p, c))
            while some := list(islice(rows, LINES)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), out)], schema=out)

        def run(messages: DataFrame) -> DataFrame:
            texts = messages.select("path", "content").mapInArrow(read, f"path string, _line long, {written}, {ERROR} string")
            fits = F.lit(True)
            for column, kind in kinds.items():
                fits = fits & (F.col(column).isNull() | F.col(column).try_cast(kind).isNotNull())
            typed = [F.col(n).try_cast(k).alias(n) for n, k in kinds.items()]
            return texts.where(fits).select("path", "_line", *typed, ERROR)

        self.functions[name] = run

    def json_records(self, name: str, schema: str) -> None:
        """Tabular JSON payloads: a list of records."""

        def run(messages: DataFrame) -> DataFrame:
            rows = messages.select("path", F.from_json(F.col("content").cast("string"), F.lit(f"array<struct<{schema}>>")).alias("_r"))
            return rows.select("path", F.posexplode("_r").alias("_line", "_e")).select("path", "_line", "_e.*")

        self.functions[name] = run


class Ingest:
    """One queue feeding a store, or several stores: one for each schema that messages name.

    A data file and its sidecar need not come in one batch. What came alone waits in ``_waiting`` (a small table that each batch reads from the batch before and
    writes anew, so a repeated batch finds the same) and is reported as failed meanwhile; when the other file comes, the message is merged. Nothing looks up single files.
    """

    def __init__(self, store: Store, queue: str, extractors: Extractors, default: dict[str, str] | None = None,
                 schemas: dict[str, Store] | None = None, patience: str = "7 days"):
        self.store, self.spark, self.queue, self.extractors = store, store.spark, queue.rstrip("/"), extractors
        # extractor used when the metadata names none, per payload kind
        self.default = default or {}
        # the metadata's schema_path -> store; messages that name no schema go to ``store``
        self.schemas = {"": store, **(schemas or {})}
        self.patience = patience

    # --- messages --------------------------------------------------------------------------------------

    def _paired(self, files: DataFrame, waiting: DataFrame) -> DataFrame:
        """(path, content, metadata_json, since, fresh): data files and sidecars of a batch and of those waiting, by name.

        A side that has not come is NULL; ``fresh`` says that one came in this batch. At most four rows of one name meet.
        """
        text = F.col("content").cast("string")
        side = F.col("path").endswith(SIDECAR)
        now = F.current_timestamp().alias("since")
        came = files.select(
            F.when(side, F.regexp_replace("path", SIDECAR_END, "")).otherwise(F.col("path")).alias("path"),
            F.when(~side, F.col("content")).alias("content"), F.when(side, text).alias("metadata_json"), now, F.lit(True).alias("fresh"),
        )
        both = came.unionByName(waiting.withColumn("fresh", F.lit(False)))
        newest = lambda c: F.expr(f"max_by({c}, fresh) FILTER (WHERE {c} IS NOT NULL)").alias(c)
        return both.groupBy("path").agg(newest("content"), newest("metadata_json"), F.min("since").alias("since"), F.bool_or("fresh").alias("fresh"))

    def process(self, files: DataFrame, batch: int, run: str = STREAM) -> None:
        """Handle one batch of message files (path, content); its intermediate tables are deleted when it is done."""
        with scratch_scope(self.spark):
            self._process(files.select("path", "content"), batch, run)

    def process_rows(self, rows: DataFrame, batch: int) -> None:
        """Handle one batch of message rows (name, content, metadata), as ``append_messages`` writes them."""
        data = rows.select(F.col("name").alias("path"), F.coalesce("content", F.lit(b"")).alias("content"))
        side = rows.where("metadata IS NOT NULL").select(F.concat("name", F.lit(SIDECAR)).alias("path"), F.col("metadata").cast("binary").alias("content"))
        self.process(data.unionByName(side), batch)

    def _process(self, files: DataFrame, batch: int, run: str) -> None:
        files = materialize(files, "batch")
        waiting = self._waiting(batch) if run == STREAM else self.spark.createDataFrame([], WAITING)
        paired = materialize(self._paired(files, waiting), "paired")
        # a batch delivered again after a failure skips what it had finished
        seen = self._table(f"_done/run={run}/batch={batch}", "path string").select("path")
        fresh = paired.where("fresh").join(seen, "path", "left_anti")
        metadata = F.from_json("metadata_json", METADATA)
        fresh = fresh.withColumn("metadata", metadata).withColumn("content", F.coalesce("content", F.lit(b"")))
        fresh = fresh.withColumn("schema", F.coalesce("metadata.schema_path", F.lit("")))
        catalog = self.spark.createDataFrame([(s, p) for s, store in self.schemas.items() for p in store.nodes], "schema string, path string")
        joined = route(fresh, catalog, ("schema",))
        kind = content_kind(F.col("metadata.content_type"))
        chosen = F.coalesce(F.col("metadata.extract_fn"), *[F.when(kind == k, F.lit(v)) for k, v in self.default.items()], F.lit(""))
        known = chosen.isin(list(self.extractors.functions)) if self.extractors.functions else F.lit(False)
        reason = F.coalesce(
            F.when(F.col("metadata").isNull(), "no metadata"),
            reject_reason(F.col("content"), F.col("metadata.content_type")),
            F.when(~F.col("schema").isin(list(self.schemas)), "unknown schema"),
            F.col("route_error"),
            F.when(~known, "unknown extractor"),
        )
        # several jobs read the batch: one group per schema, node and extractor, and the dead letters
        messages = materialize(joined.withColumn("extractor", chosen).withColumn("reason", reason), "messages")
        self._dead_letter(messages.where("reason IS NOT NULL"), batch, run)
        accepted = messages.where("reason IS NULL")
        keys = ["schema", "node", "extractor"]
        for target in sorted(accepted.select(*keys).distinct().collect()):
            mine = accepted
            for key in keys:
                mine = mine.where(F.col(key) == target[key])
            self._merge(mine, self.schemas[target["schema"]], target["node"], target["extractor"], batch, run)
        self._mark_done(messages, batch, run)
        if run == STREAM:
            # one file each side; what waits too long stays a dead letter
            alone = paired.where("content IS NULL OR metadata_json IS NULL").where(F.col("since") >= F.current_timestamp() - F.expr(f"INTERVAL {self.patience}"))
            accepted_later = self.done().where("accepted").select("path")
            left = alone.drop("fresh").join(accepted_later, "path", "left_anti")
            left.write.mode("overwrite").parquet(f"{self.store.root}/_waiting/batch={batch}")
            self._forget_waiting(batch)

    def _waiting(self, batch: int) -> DataFrame:
        """What waited after the last batch before this one."""
        before = [n for n in self._waiting_batches() if n < batch]
        if not before:
            return self.spark.createDataFrame([], WAITING)
        return self.spark.read.schema(WAITING).parquet(f"{self.store.root}/_waiting/batch={max(before)}")

    def _waiting_batches(self) -> list[int]:
        return [int(n.split("=", 1)[1]) for n in self.store.files.names("_waiting") if n.startswith("batch=")]

    def _forget_waiting(self, batch: int) -> None:
        """Only a batch that is repeated reads an earlier state: the one before it."""
        for number in sorted(n for n in self._waiting_batches() if n < batch)[:-1]:
            self.store.files.delete(f"_waiting/batch={number}")

    def _merge(self, messages: DataFrame, store: Store, node: str, extractor: str, batch: int, run: str) -> None:
        """Extract and merge a group of messages. Those that fail by themselves are set aside by their error columns, in a fixed number of jobs.

        An exception that names no message (an extractor's own function fails as a whole) halves the group, in name order, until it is down to the messages that raise it.
        """
        try:
            rows = self.extractors.functions[extractor](messages)
            if "_line" not in rows.columns:
                rows = rows.withColumn("_line", F.monotonically_increasing_id())
            # later files win over earlier ones by name, later lines over earlier ones
            order = F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "path", F.col("_line").cast("long").alias("line"))
            ordered = materialize(rows.withColumn(ROW, order), "rows")
            failed = ordered.select("path", F.lit("").alias("reason")).limit(0)
            if ERROR in ordered.columns:
                failed = ordered.where(F.col(ERROR).isNotNull()).groupBy("path").agg(F.min(ERROR).alias("reason"))
                # a message is merged as a whole or not at all
                ordered = ordered.join(failed.select("path"), "path", "left_anti").drop(ERROR)
            if not ordered.isEmpty():
                _, alone = store.node(node).update_messages(ordered.drop("path", "_line"), ROW, "path")
                failed = failed.unionByName(alone.select(F.col("message").alias("path"), "reason"))
        except Exception as problem:
            text = f"{type(problem).__name__}: {problem}"
            store.log_event("ERROR", node, text)
            # no more names than files in a batch
            names = sorted((r["path"].rsplit("/", 1)[-1], r["path"]) for r in messages.select("path").collect())
            if len(names) == 1:
                self._dead_letter(messages.withColumn("reason", F.lit(text)), batch, run)
                return
            middle = names[len(names) // 2]
            later = F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "path") >= F.struct(F.lit(middle[0]).alias("name"), F.lit(middle[1]).alias("path"))
            for half in (~later, later):
                self._merge(messages.where(half), store, node, extractor, batch, run)
            return
        self._dead_letter(messages.drop("reason").join(failed, "path"), batch, run)

    # --- bookkeeping -----------------------------------------------------------------------------------

    def _dead_letter(self, failed: DataFrame, batch: int, run: str) -> None:
        rows = failed.select("path", "node", "reason", "content", "metadata_json", F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"), F.current_timestamp().alias("at"))
        rows.write.mode("append").partitionBy("run", "batch").parquet(f"{self.store.root}/_failed")

    def _mark_done(self, messages: DataFrame, batch: int, run: str) -> None:
        bad = self._table(f"_failed/run={run}/batch={batch}", "path string").select("path", F.lit(True).alias("_bad")).distinct()
        accepted = F.col("_bad").isNull().alias("accepted")
        done = messages.join(bad, "path", "left").select("path", accepted, F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"))
        done.write.mode("append").partitionBy("run", "batch").parquet(f"{self.store.root}/_done")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.store.files.names(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/{name}")

    def done(self) -> DataFrame:
        return self._table("_done", "path string, accepted boolean, run string, batch long")

    def failed(self) -> DataFrame:
        """The dead-letter table; a message may appear once per attempt."""
        return self._table("_failed", DEAD_LETTER)

    def failures(self) -> DataFrame:
        return failure_summary(self.failed(), "reason", "path")

    # --- running ---------------------------------------------------------------------------------------

    def start(self, checkpoint: str, once: bool = False, every: str = "30 seconds", files_per_batch: int = 1000) -> StreamingQuery:
        """Start the stream of message files; with ``once`` it takes what is there and stops.

        A queue on a mounted file system is listed and read in tasks. Elsewhere, and for a checkpoint begun that way, Spark's file source lists it, which holds about 3 KB a file on the driver.
        """
        folder, begun = mounted(self.spark, self.queue), Files(self.spark, checkpoint)
        if folder is None or begun.exists("sources") and not begun.exists(LISTED_FILES):
            stream = self._session().readStream.format("binaryFile").schema(FILE_TYPE).option("recursiveFileLookup", True)
            return self._started(stream.option("maxFilesPerTrigger", files_per_batch).load(self.queue), self.process, checkpoint, once, every)
        listing = Listing(self.spark, folder, f"{begun.root}/{LISTED_FILES}", files_per_batch)
        listing.extend()
        # a turn that is being written has another name
        turns = self._session().readStream.schema(TURN).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(listing.turns)
        query = self._started(turns, lambda rows, batch: self.process(listing.read(rows.sparkSession, batch), batch), checkpoint, once, every)
        if not once:
            self._watch(query, listing, every)
        return query

    def _watch(self, query: StreamingQuery, listing: Listing, every: str) -> None:
        """List the queue again after each interval, as long as the query runs."""
        interval = every.strip().lower().removeprefix("interval")
        seconds = self.spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {interval}) / 1e6")).first()[0]

        def run() -> None:
            try:
                while not query.awaitTermination(max(1, math.ceil(seconds))):
                    listing.extend()
            except StreamingQueryException:
                pass  # the query's own failure, which it tells itself
            except Exception as problem:
                query.stop()
                self.store.log_event("ERROR", "", f"{type(problem).__name__}: {problem}")
                self.store.flush_events()

        threading.Thread(target=run, name="queue listing", daemon=True).start()

    def start_rows(self, checkpoint: str, once: bool = False, every: str = "30 seconds", files_per_batch: int = 100) -> StreamingQuery:
        """Start the stream of a queue that is a table of message rows."""
        stream = self._session().readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).parquet(self.queue)
        return self._started(stream, self.process_rows, checkpoint, once, every)

    def _started(self, stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: handle(rows, batch))
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
        return writer.start()

    def _session(self) -> SparkSession:
        """A session for a stream: the settings of this one, but few tasks for many files."""
        session = self.spark.newSession()
        few = {LISTING: str(LISTING_TASKS_A_CORE * self.spark.sparkContext.defaultParallelism), OPEN_COST: str(OPEN_COST_BYTES)}
        for key, value in {**self.spark.conf.getAll, **few}.items():
            if session.conf.get(key, None) != value and session.conf.isModifiable(key):
                session.conf.set(key, value)
        return session

    def replay(self, limit: int | None = None) -> int:
        """Try failed messages again, all of them or the ``limit`` tried longest ago; returns how many were tried.

        Metadata is read again from the queue's sidecars, in one read of the folder, so a corrected one counts. Replays have batch numbers of their own.
        """
        last = self.failed().groupBy("path").agg(F.max_by("content", "at").alias("content"), F.max_by("metadata_json", "at").alias("metadata_json"), F.max("at").alias("at"))
        open_ones = self.done().groupBy("path").agg(F.bool_or("accepted").alias("ok")).where(~F.col("ok")).select("path")
        chosen = last.join(open_ones, "path", "left_semi")
        if limit is not None:
            chosen = chosen.orderBy("at", "path").limit(limit)
        with scratch_scope(self.spark):
            again = materialize(chosen, "replay")
            count = again.count()
            if count:
                names = again.select(F.concat("path", F.lit(SIDECAR)).alias("path"))
                folder = mounted(self.spark, self.queue)
                if folder is None:
                    queue = self.spark.read.format("binaryFile").schema(FILE_TYPE).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SIDECAR}").load(self.queue)
                    now = queue.select("path", "content").join(names, "path", "left_semi")
                else:
                    now = read_files(found(self.spark, folder).where(F.col("path").endswith(SIDECAR)).join(names, "path", "left_semi"), count)
                kept = again.where("metadata_json IS NOT NULL").select(F.concat("path", F.lit(SIDECAR)).alias("path"), F.col("metadata_json").cast("binary").alias("content"))
                sides = now.unionByName(kept.join(now.select("path"), "path", "left_anti"))
                number = (self.done().where(F.col("run") == REPLAY).agg(F.max("batch")).first()[0] or 0) + 1
                self.process(again.select("path", "content").unionByName(sides), number, REPLAY)
        return count


def append_messages(messages: DataFrame, folder: str) -> None:
    """Append (name, content, metadata) rows to a queue that is a table: committed by Spark, on any file system, with as few files as the rows need."""
    messages.select(F.col("name").cast("string"), F.col("content").cast("binary"), F.col("metadata").cast("string")).hint("rebalance").write.mode("append").parquet(folder)


def write_messages(messages: DataFrame, folder: str) -> None:
    """Write (name, content, metadata) rows as message files with sidecars, as other programs leave them; a NULL side is not written. Runs in the tasks and needs a folder
    mounted on all executors. ``append_messages`` has no such need."""
    folder = folder.removeprefix("file://")

    def put(rows: Iterator[Any]) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            # the sidecar first: a data file without one waits for it
            sides = (row["name"] + SIDECAR, row["metadata"] and row["metadata"].encode("utf-8")), (row["name"], row["content"])
            for name, data in sides:
                if data is None:
                    continue
                temp = os.path.join(folder, f".{name}.tmp")
                with open(temp, "wb") as handle:
                    handle.write(bytes(data))
                os.replace(temp, os.path.join(folder, name))

    messages.select("name", "content", "metadata").foreachPartition(put)
