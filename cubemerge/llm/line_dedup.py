"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference counts.

A ``LineIndex`` holds three tables. ``references`` has one row for each key and document that holds it, ``counts`` the number of documents and the
largest of them for each key, and ``filters`` one cuckoo filter a shard, with a fingerprint of every key that is common (held by at least
``least`` documents). Keys are told by 128-bit hashes. ``insert`` adds documents and ``delete`` takes them out again: counts go up and down, keys that
become common enter their shard's filter and keys that cease to be leave it, and the largest document of a key is found anew among those left.
After a deletion the index equals one built without the documents.

Which lines go is decided by the counts alone: the filters say which references need not be looked up, since most lines are not common. Shards
hold at most about ``SHARD`` keys and double in number when they would hold more, so a filter is about 2 * SHARD / 0.8 bytes at any
size. Filters reach the tasks in rounds of at most ``ROUND`` shards, the bound of what is collected and broadcast.

Keys are counted with partial aggregation, so a line that a third of all documents hold is one row a task. The join of the references that pass the filters
with the counts is by key; its hot keys are on one side only, and adaptive execution splits them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; only keys of at least ``LENGTH`` code points count. A NULL text
is one empty line. Rows of the same ``doc_id`` are one document; rows with a NULL ``doc_id`` are one document as well, smaller than all others. Texts
of any length are processed whole, in one task, at some ten bytes a text byte. An empty table gives an empty report. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.llm.tables import Scratch
from cubemerge.llm.words import mix

LENGTH = 20
LEAST = 3
SHARD = 1 << 16
ROUND = 256
SLOTS = 4
FULL = 0.8
_BLANKS = b" \t\n\x0b\x0c\r"
_KICKS = 500


# --- lines ---------------------------------------------------------------------------------------------


def line_keys(text: str | None, length: int = LENGTH) -> list[bytes | None]:
    """The 16-byte key of each line, None for lines that are too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        line = line.strip(_BLANKS)
        # code points are the bytes that do not go on with one
        if len(line) < length or len(line) < 4 * length and len(line.decode()) < length:
            out.append(None)
        else:
            out.append(hashlib.blake2b(line.lower(), digest_size=16).digest())  # bytes.lower() changes A-Z only
    return out


def _references(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                keys = {k for k in line_keys(text.as_py(), length) if k is not None}
                rows.extend([i] * len(keys))
                found.extend(keys)
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["h1", "h2", "doc_id"])

    return run


def references(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``h1, h2, doc_id``: each key once for each document row that holds it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_references(length), f"h1 long, h2 long, doc_id {kind}")


# --- filters -------------------------------------------------------------------------------------------


class CuckooFilter:
    """Set of 64-bit hashes as 16-bit fingerprints in buckets of four; every hash has two buckets, each known from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FULL)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(hashes.astype(np.int64).view(np.uint64))
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1  # zero marks a free slot
        return prints, (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return buckets ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, near = self._places(hashes)
        far = self._other(near, prints)
        return ((self.table[near] == prints[:, None]) | (self.table[far] == prints[:, None])).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Add each hash once more; False if no room was found, with the filter then unfit for use."""
        rng = np.random.default_rng(len(hashes))
        prints, buckets = self._places(hashes)
        for kick in range(_KICKS):
            if not len(prints):
                return True
            # one print a bucket and pass, the others wait
            first = np.unique(buckets, return_index=True)[1]
            turn = np.zeros(len(prints), bool)
            turn[first] = True
            at, what = buckets[first], prints[first]
            free = self.table[at] == 0
            fits = free.any(1)
            self.table[at[fits], free[fits].argmax(1)] = what[fits]
            at, what = at[~fits], what[~fits]
            if kick:
                # a full bucket gives up a random print, which goes to its other bucket
                slots = rng.integers(0, SLOTS, len(at))
                out = self.table[at, slots]
                self.table[at, slots] = what
                what = out
            prints = np.concatenate([prints[~turn], what])
            buckets = np.concatenate([buckets[~turn], self._other(at, what)])
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one print for each hash; all of them must have been inserted."""
        prints, buckets = self._places(hashes)
        moved = np.zeros(len(prints), bool)
        while len(prints):
            first = np.unique(buckets, return_index=True)[1]
            turn = np.zeros(len(prints), bool)
            turn[first] = True
            at, what = buckets[first], prints[first]
            same = self.table[at] == what[:, None]
            here = same.any(1)
            self.table[at[here], same[here].argmax(1)] = 0
            lost = ~here & ~moved[first]
            prints = np.concatenate([prints[~turn], what[lost]])
            buckets = np.concatenate([buckets[~turn], self._other(at[lost], what[lost])])
            moved = np.concatenate([moved[~turn], np.ones(lost.sum(), bool)])


def _built(hashes: np.ndarray) -> CuckooFilter:
    room = len(hashes)
    while True:
        made = CuckooFilter.sized(room)
        if made.insert(hashes):
            return made
        room *= 2


def _build(table: pa.Table) -> pa.Table:
    return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([_built(table.column("h1").to_numpy()).write()], pa.binary())})


def _update(changed: pa.Table, kept: pa.Table) -> pa.Table:
    """A shard's filter after keys became common (``common`` true) or ceased to be (false). ``keys``: all its common keys, in the rows with ``common`` NULL."""
    if not changed.num_rows:
        return kept
    became = changed.column("common").to_numpy(zero_copy_only=False).astype(bool)
    hashes = changed.column("h1").to_numpy()
    if kept.num_rows:
        made = CuckooFilter.read(kept.column("data")[0].as_py())
    else:
        made = CuckooFilter.sized(int(became.sum()))
    made.delete(hashes[~became])
    before = made.write()
    done = made.insert(hashes[became])
    # no room: the caller builds the shard anew from the counts
    return pa.table({"shard": changed.column("shard").slice(0, 1), "data": pa.array([made.write() if done else before], pa.binary()), "full": pa.array([not done])})


def _shard(shards: int) -> Column:
    # h1 chooses the shard by its remainder and the place within the filter after mixing
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


# --- index ---------------------------------------------------------------------------------------------


@dataclass
class LineIndex:
    """``references`` (h1, h2, doc_id), ``counts`` (h1, h2, n, last), ``filters`` (shard, data); ``shards`` filters in all, shards without common keys left out."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int = LEAST
    length: int = LENGTH


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def _filters(counts: DataFrame, least: int, shards: int) -> DataFrame:
    common = counts.where(F.col("n") >= least).select(_shard(shards).alias("shard"), "h1")
    return common.groupBy("shard").applyInArrow(_build, "shard int, data binary")


def _wanted(counts: DataFrame, least: int, size: int, shards: int = 1) -> int:
    common = counts.where(F.col("n") >= least).count()
    while shards * size < common:
        shards *= 2
    return shards


def build(docs: DataFrame, scratch: Scratch, least: int = LEAST, length: int = LENGTH, size: int = SHARD) -> LineIndex:
    """Index of ``docs``."""
    refs = references(docs, length)
    clash = docs.groupBy("doc_id").count().where("count > 1")
    refs = scratch.table(refs if clash.isEmpty() else refs.distinct())
    counts = scratch.table(_counted(refs))
    shards = _wanted(counts, least, size)
    return LineIndex(refs, counts, scratch.table(_filters(counts, least, shards)), shards, least, length)


def _changed_filters(index: LineIndex, crossing: DataFrame, counts: DataFrame, scratch: Scratch, size: int) -> tuple[DataFrame, int]:
    """Filters after the keys of ``crossing`` (h1, common) became common or ceased to be: only their shards are opened."""
    shards = _wanted(counts, index.least, size, index.shards)
    if shards > index.shards:
        return scratch.table(_filters(counts, index.least, shards)), shards
    moved = crossing.select(_shard(shards).alias("shard"), "h1", "common")
    old = index.filters.select("shard", "data", F.lit(False).alias("full"))
    schema = "shard int, data binary, full boolean"
    new = scratch.table(moved.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_update, schema))
    over = new.where("full").select("shard")
    again = _filters(counts.join(F.broadcast(over), _shard(shards) == over["shard"], "left_semi"), index.least, shards)
    return scratch.table(new.where("NOT full").select("shard", "data").unionByName(again)), shards


def insert(index: LineIndex, docs: DataFrame, scratch: Scratch, size: int = SHARD) -> LineIndex:
    """The index with ``docs`` as well. Documents whose id it knows already, and hold lines that count, add what is new in them."""
    new = references(docs, index.length).distinct()
    new = scratch.table(_without(new, index.references, ["h1", "h2", "doc_id"]))
    both = index.counts.select("*", F.col("n").alias("before")).unionByName(_counted(new).withColumn("before", F.lit(0).cast("long")))
    counts = scratch.table(both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("before").alias("before")))
    crossing = counts.where((F.col("before") < index.least) & (F.col("n") >= index.least)).select("h1", F.lit(True).alias("common"))
    counts = counts.drop("before")
    filters, shards = _changed_filters(index, crossing, counts, scratch, size)
    return LineIndex(scratch.table(index.references.unionByName(new)), counts, filters, shards, index.least, index.length)


def delete(index: LineIndex, ids: DataFrame, scratch: Scratch, size: int = SHARD) -> LineIndex:
    """The index without the documents of ``ids`` (``doc_id``); unknown ids change nothing."""
    ids = ids.select("doc_id").distinct()
    left = scratch.table(_without(index.references, ids, ["doc_id"]))
    gone = index.references.join(ids.withColumnRenamed("doc_id", "_gone"), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
    touched = scratch.table(gone.select("h1", "h2").distinct())
    # the largest holder may be gone: it is found anew for the keys of the deleted documents only
    recounted = _counted(left.join(touched, ["h1", "h2"], "left_semi"))
    before = index.counts.join(touched, ["h1", "h2"]).select("h1", "h2", F.col("n").alias("before"))
    now = scratch.table(before.join(recounted, ["h1", "h2"], "left"))
    crossing = now.where((F.col("before") >= index.least) & (F.coalesce("n", F.lit(0)) < index.least)).select("h1", F.lit(False).alias("common"))
    counts = scratch.table(index.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(now.where("n IS NOT NULL").select("h1", "h2", "n", "last")))
    filters, shards = _changed_filters(index, crossing, counts, scratch, size)
    return LineIndex(left, counts, filters, shards, index.least, index.length)


def _without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Anti-join in which NULL equals NULL."""
    renamed = others.select(*[F.col(c).alias(f"_on_{c}") for c in on])
    return rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], "left_anti")


def save(index: LineIndex, path: str) -> None:
    """Write the index below ``path``, a folder all executors reach; the settings come last and make it whole."""
    for name in ("references", "counts", "filters"):
        getattr(index, name).write.parquet(f"{path}/{name}")
    spark = index.references.sparkSession
    spark.createDataFrame([(index.shards, index.least, index.length)], "shards int, least int, length int").coalesce(1).write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> LineIndex:
    shards, least, length = spark.read.parquet(f"{path}/settings").first()
    return LineIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("references", "counts", "filters")), shards, least, length)


# --- dropping lines ------------------------------------------------------------------------------------


def _passing(shared, shards: int):
    """Task step: references that the filters of this round may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: CuckooFilter.read(data) for shard, data in shared.value}
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            shard = hashes % shards
            keep = np.zeros(len(hashes), bool)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1)) if shards <= len(hashes) else None
            for s in np.unique(shard):
                if int(s) in filters:
                    at = order[ends[s] : ends[s + 1]] if ends is not None else np.flatnonzero(shard == s)
                    keep[at] = filters[int(s)].contains(hashes[at])
            yield batch.filter(pa.array(keep))

    return run


def maybe_common(index: LineIndex, refs: DataFrame, at_once: int = ROUND) -> DataFrame:
    """References whose keys the filters hold: all those with common keys, and a few others."""
    spark = refs.sparkSession
    schema = T.StructType(refs.schema.fields)
    found = None
    for start in range(0, index.shards, at_once):
        some = [(r["shard"], bytes(r["data"])) for r in index.filters.where(F.col("shard").between(start, start + at_once - 1)).collect()]
        part = refs.where(_shard(index.shards).between(start, start + at_once - 1)) if index.shards > at_once else refs
        part = part.mapInArrow(_passing(spark.sparkContext.broadcast(some), index.shards), schema)
        found = part if found is None else found.unionByName(part)
    return found


def dropped_keys(index: LineIndex, refs: DataFrame, at_once: int = ROUND) -> DataFrame:
    """``h1, h2, doc_id`` of the common keys each document loses: those with a larger document that holds them."""
    common = index.counts.where(F.col("n") >= index.least).select("h1", "h2", "last")
    hits = maybe_common(index, refs, at_once).join(common, ["h1", "h2"])
    return hits.where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("h1", "h2", "doc_id")


def _kept_lines(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, digests, texts = [], [], [], []
            for text, keys in zip(batch.column(1), batch.column(2), strict=True):
                text, keys = text.as_py() or "", keys.as_py()
                n, gone = text.count("\n") + 1, 0
                if keys:
                    keys = {int(k["h1"]).to_bytes(8, "little", signed=True) + int(k["h2"]).to_bytes(8, "little", signed=True) for k in keys}
                    kept = [line for line, key in zip(text.split("\n"), line_keys(text, length), strict=True) if key not in keys]
                    text, gone = "\n".join(kept), n - len(kept)
                lines.append(n)
                dropped.append(gone)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                texts.append(text)
            out = [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string())] if with_text else out, names=[*names, "text"] if with_text else names)

    return run


def report(index: LineIndex, docs: DataFrame, scratch: Scratch, refs: DataFrame | None = None, with_text: bool = False, at_once: int = ROUND) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row of ``docs`` against the index, and the kept ``text`` if asked for.

    ``refs``: the references of ``docs`` where they are known. A document that the index does not hold loses all its common lines.
    """
    refs = references(docs, index.length).distinct() if refs is None else refs
    gone = scratch.table(dropped_keys(index, refs, at_once))
    keys = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))
    joined = docs.select("doc_id", "text").join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "keys")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string"
    return joined.mapInArrow(_kept_lines(index.length, with_text), schema + (", text string" if with_text else ""))


def line_dedup(docs: DataFrame, scratch: Scratch, with_text: bool = False, **settings: int) -> DataFrame:
    """The report of ``docs`` against an index of their own."""
    index = build(docs, scratch, **settings)
    return report(index, docs, scratch, refs=index.references, with_text=with_text)
