"""Document fingerprints from SpotSigs.

A signature is a common word (an anchor) with the chain of the next ``CHAIN`` content words after it. A fingerprint lists a document's distinct
signature hashes in ascending order. Two fingerprints are compared by Jaccard similarity, pruned by their lengths: the shorter over the
longer is the most it can be.

``near_pairs`` joins a whole collection: documents are partitioned by the length of their signature sets, so that only neighbouring
partitions can reach the limit, and within those only documents that share one of their rarest signatures are compared. ``fingerprints`` compares
each document with an edited copy and with the next one in ``doc_id`` order. For that, texts are shuffled once, into ranges of
``doc_id``; the first document of each range is sent along to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.llm.tables import ROW, Scratch, keyed, packed, unpack
from cubemerge.llm.words import LETTERS_DIGITS, Rolling, Words, signed

CHAIN = 2
# fixed values: common words of the four languages
COMMON = """
the of and to a in is it that was for on with as at by be this are or from an he his not but they
der die das und in zu den mit von für auf ist im dem des ein eine sich nicht auch es an werden aus er
le la les de des et un une du que qui en dans pour est il elle sur au pas ce se par plus
el los las y en un una del que por con para es se lo al su como más
""".split()


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct signature hashes of every text. Near the end chains are shorter; a text without anchors is signed by the chains at each
    of its words."""
    words = Words(texts, LETTERS_DIGITS, lower=True)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes, row = words.hashes(), words.row()
    common = np.unique(Words(pa.array(COMMON, pa.string()), LETTERS_DIGITS, lower=True).hashes())
    place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    anchor = common[place] == hashes
    content = np.flatnonzero(~anchor)
    spots = anchor.copy()
    bare = np.bincount(row[anchor], minlength=len(texts)) == 0
    spots |= bare[row]
    at = np.flatnonzero(spots)
    # chain: the next content words of the same text
    end = np.searchsorted(content, words.first[1:])
    first = np.searchsorted(content, at, side="right")
    stop = np.minimum(first + chain, end[row[at]])
    rolling = Rolling(hashes[content])
    own = hashes[at]
    chains = rolling.span(first, np.maximum(first, stop)) if len(content) else np.zeros(len(at), np.uint64)
    both = Rolling(np.stack([own, chains], axis=1).ravel()).grams(2)[::2]
    kept = np.flatnonzero((stop > first) | bare[row[at]])
    group = row[at][kept]
    bounds = np.searchsorted(group, np.arange(len(texts) + 1))
    return [np.unique(both[kept[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def written(found: np.ndarray) -> str:
    """A fingerprint as text: the top 40 bits of each signature hash."""
    return base64.b64encode(np.unique(found >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 without a comparison where their lengths cannot reach ``least``. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bool, str]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 32):
            chunk = batch.slice(start, 32)
            for part, doc, guest, text in zip(
                chunk.column("part").to_pylist(), chunk.column("doc_id").to_pylist(), chunk.column("guest").to_pylist(),
                unpack(chunk.column("packed")).to_pylist(), strict=True,
            ):
                yield part, doc, guest, text or ""


def _compared(block: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Digests of consecutive documents, given as id, text and next text."""
    texts = [b[1] for b in block]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for _, t, after in block]
    # rows of a block follow each other, so the next document of each is the next row
    own = signatures(pa.array([*texts, block[-1][2]], pa.string()))
    own, after = own[:-1], own[1:]
    changed = signatures(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b[0] for b in block], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written(s) for s in own], pa.string()), pa.array([written(s) for s in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, block, size = None, [], 0
    for row in _rows(batches):
        if held is not None and row[0] == held[0]:
            block.append((held[1], held[3], row[3]))
            size += len(held[3])
        if block and (size > 100_000 or row[0] != held[0]):
            yield _compared(block)
            block, size = [], 0
        # a guest only ends the range before its own
        held = None if row[2] else row
        if held is None and block:
            yield _compared(block)
            block, size = [], 0
    if block:
        yield _compared(block)


def fingerprints(docs: DataFrame, scratch: Scratch, ranges: int | None = None) -> DataFrame:
    """The digest of every document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    NULL and empty texts have no characters and an empty fingerprint, as have texts without words; two empty fingerprints are alike (1). Repeated and NULL
    ids are ordered by row (NULL first). The only document of a table is followed by itself.
    """
    rows = keyed(docs.select("doc_id", "text"), scratch)
    spark = docs.sparkSession
    count = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # borders of the ranges: one row for each range reaches the driver
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), ROW)
    firsts = [
        tuple(r[0]) for r in rows.select(key.alias("key")).repartitionByRange(count, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).orderBy("key").select("key").collect()
    ]
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    table = spark.sparkContext.broadcast(firsts)
    placed = packed(rows, "doc_id", ROW).mapInArrow(_place(table), f"part int, doc_id long, {ROW} long, guest boolean, packed binary")
    return (
        placed.repartition(count, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), ROW)
        .select("part", "doc_id", "guest", "packed")
        .mapInArrow(_ordered, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def _place(table):
    """The range of every row; the first row of a range also goes, as a guest, to the range before it, that of the first range to the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        firsts = table.value
        for batch in batches:
            keys = [(d is not None, d or 0, r) for d, r in zip(batch.column("doc_id").to_pylist(), batch.column(ROW).to_pylist(), strict=True)]
            own = [bisect_right(firsts, k) - 1 for k in keys]
            start = [i for i, (k, p) in enumerate(zip(keys, own, strict=True)) if firsts[p] == k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), batch.column("doc_id").cast(pa.int64()), batch.column(ROW), pa.array([False] * len(own)), batch.column("packed")],
                names=["part", "doc_id", ROW, "guest", "packed"],
            )
            if start:
                guests = batch.take(pa.array(start))
                before = [(own[i] - 1) % len(firsts) for i in start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before, pa.int32()), guests.column("doc_id").cast(pa.int64()), guests.column(ROW), pa.array([True] * len(start)), guests.column("packed")],
                    names=["part", "doc_id", ROW, "guest", "packed"],
                )

    return run


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            found = [signed(s) for s in signatures(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(found, pa.list_(pa.int64()))], names=[ROW, "signatures"])


def near_pairs(docs: DataFrame, scratch: Scratch, least: float = 0.75) -> DataFrame:
    """``a, b, likeness``: pairs of different signature sets of keyed ``docs`` with a likeness of ``least`` or more; of equal sets the
    smallest row stands for all. Documents without signatures have no partner.
    """
    sets = docs.select(ROW, "text").mapInArrow(_signed_rows, f"{ROW} long, signatures array<long>").where("size(signatures) > 0")
    distinct = scratch.table(sets.groupBy("signatures").agg(F.min(ROW).alias("id")).withColumn("n", F.size("signatures")))
    each = distinct.select("id", "n", F.explode("signatures").alias("s"))
    rare = each.groupBy("s").agg(F.count("*").alias("held")).where("held > 1")
    ranked = each.join(rare, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "s"))).alias("shared"))
    # signatures nobody else has come first in the prefix; the length partition is the size class in steps of the limit
    prefix = F.expr(f"n - cast(ceil({least} * n) as int) + 1 - (n - size(shared))")
    step = F.floor(F.log("n") / -np.log(least)).cast("int")
    probes = scratch.table(
        ranked.where(prefix > 0).withColumn("s", F.explode(F.slice("shared", F.lit(1), prefix))).select("id", "n", step.alias("step"), F.col("s.s").alias("s"))
    )
    other = probes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("step").alias("other"), "s")
    pairs = (
        probes.join(other, "s").where(f"id < b AND abs(step - other) <= 1 AND least(n, m) >= {least} * greatest(n, m)").select(F.col("id").alias("a"), "b").distinct()
    )
    x, y = distinct.select(F.col("id").alias("a"), F.col("signatures").alias("x")), distinct.select(F.col("id").alias("b"), F.col("signatures").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("likeness")).where(F.col("likeness") >= least)
