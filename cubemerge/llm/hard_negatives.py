"""Hard negatives by Four-Russians scoring: exact integer inner products from tables of subset sums.

The index holds the candidates in blocks of packed bytes. Components are cut into groups of ``GROUP`` dimensions and into bit planes (two's
complement); a byte holds one plane of the eight components of a group. For the anchors each group has a table with the sums of all 256
subsets of their eight components. An inner product is then, for every plane and group, a lookup of the candidate's byte, added with the
plane's shift; the highest plane counts negative. That is the full score, exact modulo 2**64.

Anchors are taken ``ANCHORS`` at a time: their vectors (that many times the dimension times 8 bytes) are what is collected and broadcast at any
size of the input. Each such round reads the whole index twice: for the nearest rows of the anchors' own labels (the positives), and for the
rows of other labels within the score range of each positive. A task keeps only the best rows it has seen for each anchor and positive, so
what is shuffled grows with tasks and anchors, not with pairs, and no label or score gathers rows in one task. A lost task is run again from
the index's Parquet files.

Rows with a NULL label, a NULL vector, a NULL or non-finite component, or a NULL ``vec_id`` (they could not be named) take no part. Rows equal in
``vec_id``, label and vector count once; other rows of one ``vec_id`` are rows of their own, and none of them is a positive or negative of
an anchor of that id. Vectors of different lengths are compared as if the shorter one went on with zeros. Components beyond 2**62 count as
2**62. Labels and ids are integers. An empty table, or one without anchors, has no negatives. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.llm.tables import Scratch

GROUP = 8
ANCHORS = 2048
TOP = 5
SCALE = 256
_LIMIT = float(1 << 62)
_NONE = np.iinfo(np.int64).min
# scores of one block held at once: candidates times anchors
_CELLS = 1 << 19

INDEX = "size int, planes int, groups int, ids binary, labels binary, packed binary"


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers, floor(scale * x) in doubles."""
    return F.transform(embedding, lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("long"))


def candidates(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id long, label long, vector array<long>`` of the rows that take part, equal rows once."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return sound.select("vec_id", "label", whole_numbers(F.col("embedding")).alias("vector")).distinct()


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, filled with zeros to a whole number of groups."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    width = max(GROUP, -(-int(sizes.max(initial=0)) // GROUP) * GROUP)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


def packed_planes(vectors: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes; bit ``i`` of a byte is the plane's bit of component ``i`` of the group."""
    magnitude = np.where(vectors < 0, ~vectors, vectors)
    planes = int(magnitude.max(initial=0)).bit_length() + 1
    grouped = vectors.reshape(len(vectors), -1, GROUP)
    bits = [np.packbits(((grouped >> np.int64(p)) & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T for p in range(planes)]
    return np.stack(bits)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.argsort(ids, kind="stable")  # equal scores go by vec_id: the first of equal ones is the smallest
        packed = packed_planes(_matrix(batch.column(2))[order])
        yield pa.RecordBatch.from_pydict({
            "size": pa.array([len(ids)], pa.int32()), "planes": pa.array([packed.shape[0]], pa.int32()), "groups": pa.array([packed.shape[1]], pa.int32()),
            "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "packed": [packed.tobytes()],
        })


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group the sums of all subsets of the anchors' eight components."""
    grouped = anchors.reshape(len(anchors), -1, GROUP)
    table = np.zeros((grouped.shape[1], 1 << GROUP, len(anchors)), np.int64)
    for i in range(GROUP):
        table[:, 1 << i : 2 << i] = table[:, : 1 << i] + grouped[:, :, i].T[:, None, :]
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products of the packed rows with the anchors of the table."""
    planes, groups, rows = packed.shape
    total = np.zeros((rows, table.shape[2]), np.int64)
    part = np.empty_like(total)
    looked = np.empty_like(total)
    for p in reversed(range(planes)):
        np.left_shift(total, 1, out=total)
        part.fill(0)
        # a side without components in a group adds nothing there
        for g in range(min(groups, len(table))):
            np.take(table[g], packed[p, g], axis=0, out=looked, mode="clip")
            part += looked
        total += -part if p == planes - 1 else part
    return total


def _best(values: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``count`` highest entries of each row of ``values``, first ones first: (rows, places, values) at a time. Changes ``values``."""
    rows = np.arange(len(values))
    for _ in range(min(count, values.shape[1])):
        at = values[rows].argmax(1)
        found = values[rows, at]
        real = found > _NONE
        rows, at, found = rows[real], at[real], found[real]
        if not len(rows):
            return
        yield rows, at, found
        values[rows, at] = _NONE


class _Kept:
    """Best (score, id) for each slot so far, at most ``count`` a slot; equal scores go by the smaller id."""

    def __init__(self, count: int):
        self.count = count
        self.slots, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        slots, scores, ids = (np.concatenate(x) for x in ((self.slots, slots), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, ~scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        first = np.searchsorted(slots, slots)
        keep = np.arange(len(slots)) - first < self.count
        self.slots, self.scores, self.ids = slots[keep], scores[keep], ids[keep]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slot": pa.array(self.slots, pa.int64()), "score": pa.array(self.scores, pa.int64()), "id": pa.array(self.ids, pa.int64())})


def _blocks(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores by anchor, ids, labels) of the index rows, a bounded number of scores at a time."""
    step = max(1, _CELLS // max(1, table.shape[2]))
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            packed = np.frombuffer(row["packed"], np.uint8).reshape(row["planes"], row["groups"], row["size"])
            for start in range(0, row["size"], step):
                some = slice(start, start + step)
                yield np.ascontiguousarray(scores(table, packed[:, :, some]).T), ids[some], labels[some]


def _positives(shared, top: int):
    """Task step: for each anchor (slot) the highest rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = shared.value
        kept = _Kept(top)
        for values, ids, labels in _blocks(batches, subset_sums(vectors)):
            values[(anchor_labels[:, None] != labels) | (anchor_ids[:, None] == ids)] = _NONE
            for slots, at, found in _best(values, top):
                kept.add(slots, found, ids[at])
        yield kept.rows()

    return run


def _negatives(shared, wanted, top: int):
    """Task step: for each positive (slot) the highest rows of other labels than its anchor's, within the positive's score range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = shared.value
        anchors, high = wanted.value
        low = high - high // 5  # 80 * positive <= 100 * negative in whole numbers; a negative positive has no range
        kept = _Kept(top)
        for values, ids, labels in _blocks(batches, subset_sums(vectors)):
            values[(anchor_labels[:, None] == labels) | (anchor_ids[:, None] == ids)] = _NONE
            step = max(1, _CELLS // max(1, len(ids)))
            for start in range(0, len(anchors), step):
                some = slice(start, start + step)
                chosen = values[anchors[some]]
                chosen[(chosen > high[some, None]) | (chosen < low[some, None])] = _NONE
                for slots, at, found in _best(chosen, top):
                    kept.add(slots + start, found, ids[at])
        yield kept.rows()

    return run


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each slot over all tasks, ranked from 1. A task sends at most ``top`` of a slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hard_negatives(embeddings: DataFrame, scratch: Scratch, anchor: Column | None = None, label: Column | None = None,
                   top: int = TOP, anchors_at_once: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors (default: ``vec_id`` divisible by 100), ``label`` gives the label used (default: the column).
    """
    spark = embeddings.sparkSession
    rows = scratch.table(candidates(embeddings, label))
    is_anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    n = rows.where(is_anchor).count()
    rounds = max(1, -(-n // anchors_at_once))
    index = rows.mapInArrow(_index, INDEX)
    index = scratch.table(index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # dealt by a hash of the whole row: rounds of equal size but for chance, whatever the ids
    numbered = rows.where(is_anchor).withColumn("_round", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(rounds)))
    parts = []
    for k in range(rounds):
        table = numbered.where(F.col("_round") == k).select("vec_id", "label", "vector").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        batch = table.to_batches()[0]
        ids = batch.column(0).to_numpy()
        shared = spark.sparkContext.broadcast((ids, batch.column(1).to_numpy(), _matrix(batch.column(2))))
        schema = "slot long, score long, id long"
        best = _merged(index.mapInArrow(_positives(shared, top), schema), top).toArrow()  # at most top rows an anchor
        anchors, high, positive = (best.column(c).to_numpy() for c in ("slot", "score", "id"))
        if len(anchors):
            wanted = spark.sparkContext.broadcast((anchors, high))
            found = _merged(index.mapInArrow(_negatives(shared, wanted, top), schema), top)
            pairs = spark.createDataFrame(pa.table({
                "slot": pa.array(np.arange(len(anchors)), pa.int64()), "anchor_id": pa.array(ids[anchors], pa.int64()),
                "positive_id": pa.array(positive, pa.int64()), "positive_score": pa.array(high, pa.int64()),
            }))
            parts.append(scratch.table(found.join(pairs, "slot").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        for used in (shared, *((wanted,) if len(anchors) else ())):
            used.unpersist()
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

