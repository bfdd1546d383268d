"""Near-duplicate detection with SetSketch registers.

A document's set of ``SHINGLE``-word shingles is summed up in ``REGISTERS`` registers: for each register every shingle gets an
exponential value, the smallest one is kept, and its logarithm to a base of 1.001 is truncated to two bytes. Registers merge by
maximum, and two sets share a register's value with a probability just above their Jaccard similarity (0.0003 for disjoint sets). Bands of
``ROWS`` register values put documents into buckets; the pairs to look at are rated by the joint likelihood of their registers and
exact sizes, and those that may reach the limit are verified on the full shingle sets.

At a similarity of 0.75 a band agrees with a probability of at least 0.75**4; that none of 36 bands agrees is about one in a million.
The likelihood test rejects a pair only when 0.75 is 5 standard deviations off.

Sets that hold too many shingles no other candidate has leave their buckets before any pair is made, and sizes and bitmaps of parities (an upper
bound of what two sets share) are compared while buckets are joined, so hopeless pairs are never rows.
Equal sets are one class from the start, whatever their number. No bucket is expanded into its pairs: each round links the members of a
bucket to one leader, which changes with the round, and members that already belong to the leader's component are left out. Members
that no leader takes in are, at the end, compared with the members of other components in their buckets, so no link
between different texts that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.llm.tables import ROW, Scratch, keyed, packed, unpack
from cubemerge.llm.words import BLANK_SEPARATED, Rolling, Words, mix, pieces, signed

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 36
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65535
# difference of log likelihoods that stands for five standard deviations
TOLERANCE = 12.5
LEADER_ROUNDS = 2
BITS = 1024

_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCHES = f"{ROW} long, n_shingles long, low long, high long, sketch binary, bits array<long>"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; the whole text where it has fewer words."""
    words = Words(texts, BLANK_SEPARATED, lower=True)
    rolling = Rolling(words.hashes())
    grams = rolling.grams(size)
    out = []
    for first, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if stop - first >= size:
            out.append(np.unique(grams[first : stop - size + 1]))
        elif stop > first:
            out.append(rolling.span(np.array([first]), np.array([stop])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of uniform 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[start : start + 1024, None] * _FACTORS).min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` hash values whether an odd number of shingles has it. Two sets' parities differ in at most as many places as
    there are shingles that only one of them holds."""
    odd = np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = shingle_sets(part.column("text"))
            with np.errstate(divide="ignore"):
                drawn = [registers(s).tobytes() if len(s) else None for s in sets]
            bits = [parities(s) if len(s) else None for s in sets]
            low = np.array([mix(s).sum() if len(s) else 0 for s in sets], np.uint64)
            high = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(ROW), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(low)), pa.array(signed(high)), pa.array(drawn, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                names=[ROW, "n_shingles", "low", "high", "sketch", "bits"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, BANDS)
        keys = mix(mix(values) + band).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(keys)), pa.array(np.repeat(batch.column("set_id").to_numpy(), BANDS))], names=["bucket", "set_id"]
        )


def _differing(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set exceeds the other's, for the share ``x`` of elements only the first has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: float) -> np.ndarray:
    """Whether a similarity of ``limit`` or more is likely enough, by the joint likelihood of two rows of registers."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 65)[None, :]

    def best(similarity: np.ndarray) -> np.ndarray:
        p, q = _differing(np.maximum(u - v * similarity, 1e-12)), _differing(np.maximum(v - u * similarity, 1e-12))
        return (above[:, None] * np.log(p) + below[:, None] * np.log(q) + equal[:, None] * np.log(np.maximum(1 - p - q, 1e-12))).max(1)

    most = np.minimum(u / v, v / u)
    possible = most[:, 0] * 100 >= limit * 100 - 1e-9
    return possible & (best(limit + (np.maximum(most, limit) - limit) * grid) >= best(grid * most) - TOLERANCE)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            sets = shingle_sets(unpack(part.column("packed")))
            keys = np.repeat(part.column("set_id").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets))), pa.array(keys)], names=["shingle", "set_id"])


def _likely(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_shingles_a", "n_shingles_b"))
            keep = pa.array(may_reach(a, b, n_a, n_b, limit))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keep = []
                for x, y in zip(shingle_sets(unpack(part.column("packed_a"))), shingle_sets(unpack(part.column("packed_b"))), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``: the smallest node it is connected with. Minima spread along the links, and
    every round also follows the roots found so far, so chains shorten by half."""
    both = scratch.table(
        links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a"))).distinct()
    )
    roots = scratch.table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jumped = lower.alias("x").join(roots.alias("y"), F.col("x.root") == F.col("y.node")).select(
            "x.node", F.least("x.root", "y.root").alias("root"), "x.old"
        )
        new = scratch.table(jumped)
        scratch.drop(roots)
        roots = new.drop("old")
        roots._scratch_path = new._scratch_path
        if new.where("root != old").isEmpty():
            return roots


def components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """``row key, n_shingles, component`` of keyed ``docs``; the component is the smallest row keys reachable over links."""
    sketched = scratch.table(docs.select(ROW, "text").mapInArrow(_sketch, SKETCHES))
    equal = ["n_shingles", "low", "high"]
    sets = sketched.where("n_shingles > 0").groupBy(*equal).agg(F.min(ROW).alias("set_id"))
    member = scratch.table(
        sketched.join(sets, equal, "left")
        .select(ROW, "n_shingles", F.coalesce("set_id", ROW).alias("set_id"), *(F.when(F.col("set_id") == F.col(ROW), F.col(c)).alias(c) for c in ("sketch", "bits")))
    )
    scratch.drop(sketched)
    chosen = member.where("sketch IS NOT NULL").select("set_id", "n_shingles", "sketch", "bits")
    banded = chosen.mapInArrow(_bands, "bucket long, set_id long")
    crowded = banded.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = scratch.table(banded.join(crowded, "bucket", "left_semi"))
    involved = scratch.table(shared.select("set_id").distinct())
    texts = scratch.table(packed(docs, ROW).withColumnRenamed(ROW, "set_id").join(involved, "set_id", "left_semi"))
    # shingles that no other set in any shared bucket has cannot be common to a pair
    alone = (
        texts.mapInArrow(_shingles, "shingle long, set_id long")
        .groupBy("shingle").agg(F.count("*").alias("sets"), F.min("set_id").alias("set_id"))
        .where("sets = 1").groupBy("set_id").agg(F.count("*").alias("alone"))
    )
    sketches = scratch.table(
        chosen.join(involved, "set_id", "left_semi").join(alone, "set_id", "left")
        .withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    )
    sized = shared.join(sketches.select("set_id", "n_shingles", "common"), "set_id")
    smallest = sized.groupBy("bucket").agg(F.min("n_shingles").alias("smallest"))
    # sets that are too small or share too little for any partner in the bucket leave it
    viable = sized.join(smallest, "bucket").where(
        f"{100 + percent} * common >= {percent} * (n_shingles + greatest(smallest, ceil(n_shingles * {percent} / 100)))"
    )
    viable = scratch.table(viable.select("bucket", "set_id", "n_shingles", "common"))
    scratch.drop(shared)
    shared = viable
    part = scratch.table(involved.withColumn("component", F.col("set_id")))
    tested = scratch.table(involved.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).limit(0))

    def possible(x: str, y: str) -> str:
        """Sizes, shingles found elsewhere and differing parities allow the similarity: it needs so many shingles of both."""
        both = f"(n_shingles_{x} + n_shingles_{y})"
        apart = " + ".join(f"bit_count(bits_{x}[{i}] ^ bits_{y}[{i}])" for i in range(BITS // 64))
        return (
            f"{100 + percent} * least(common_{x}, common_{y}) >= {percent} * {both}"
            f" AND {100 + percent} * ({both} - ({apart})) >= {2 * percent} * {both}"
        )

    def side(table: DataFrame, name: str, **columns: str) -> DataFrame:
        return table.select(F.col("set_id").alias(name), *(F.col(c).alias(alias) for c, alias in columns.items()))

    def merge(pairs: DataFrame) -> DataFrame:
        """``part`` after the links among ``pairs`` are verified."""
        likely = scratch.table(
            pairs.join(side(sketches, "a", n_shingles="n_shingles_a", sketch="sketch_a", common="common_a", bits="bits_a"), "a")
            .join(side(sketches, "b", n_shingles="n_shingles_b", sketch="sketch_b", common="common_b", bits="bits_b"), "b")
            .where(possible("a", "b"))
            .select("a", "b", "n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b")
            .mapInArrow(_likely(percent / 100), "a long, b long")
        )
        links = scratch.table(
            likely.join(side(texts, "a", packed="packed_a"), "a").join(side(texts, "b", packed="packed_b"), "b")
            .select("a", "b", "packed_a", "packed_b").mapInArrow(_verify(percent), "a long, b long")
        )
        if links.isEmpty():
            return part
        owner = part.select(F.col("set_id"), F.col("component"))
        edges = (
            links.join(owner.select(F.col("set_id").alias("a"), F.col("component").alias("p")), "a")
            .join(owner.select(F.col("set_id").alias("b"), F.col("component").alias("q")), "b")
            .select(F.col("p").alias("a"), F.col("q").alias("b"))
        )
        roots = connected(edges, scratch)
        return scratch.table(
            part.join(roots.withColumnRenamed("node", "component"), "component", "left")
            .select("set_id", F.coalesce("root", "component").alias("component"))
        )

    for number in range(LEADER_ROUNDS):
        placed = shared.select("bucket", "set_id").join(part, "set_id")
        order = F.xxhash64("set_id", F.lit(number))
        leaders = (
            placed.groupBy("bucket")
            .agg(F.min_by("set_id", order).alias("leader"), F.min_by("component", order).alias("taken"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo < hi").select("bucket", "leader", "taken")
        )
        pairs = (
            placed.join(leaders, "bucket").where("component != taken")
            .select(F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")).distinct()
        )
        pairs = scratch.table(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        part, tested = merge(pairs), scratch.table(tested.union(pairs))
    # what the leaders left apart, against the other components of its buckets
    placed = shared.join(part, "set_id")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_ = scratch.table(placed.join(split, "bucket", "left_semi").join(sketches.select("set_id", "bits"), "set_id"))
    x, y = (open_.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("set_id", "component", "n_shingles", "common", "bits"))) for s in "xy")
    rest = (
        x.join(y, "bucket")
        .where(f"set_id_x < set_id_y AND component_x != component_y AND {possible('x', 'y')}")
        .select(F.col("set_id_x").alias("a"), F.col("set_id_y").alias("b")).distinct()
    )
    rest = scratch.table(rest.join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        part = merge(rest)
    return member.join(part, "set_id", "left").select(ROW, "n_shingles", F.coalesce("component", "set_id").alias("component"))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The digest of every document: ``doc_id, n_shingles, component_id, kept``.

    A document with fewer than five words has its whole word sequence as its only shingle. One without words or with a NULL text
    has none, is linked with nothing and is its own component. Repeated rows are linked with each other; ids that are NULL or
    repeated are told apart by row, and ``component_id`` is the smallest id of the component.
    """
    rows = keyed(docs.select("doc_id", "text"), scratch)
    found = scratch.table(components(rows, scratch, percent).join(rows.select(ROW, "doc_id"), ROW))
    first = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(first, "component").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the first; all columns stay. Of repeated ids each row counts by itself."""
    rows = keyed(docs, scratch, keep=True)
    first = scratch.result(components(rows.select(ROW, "text"), scratch, percent).where(F.col(ROW) == F.col("component")).select(ROW))
    return rows.join(first, ROW, "left_semi").select(*docs.columns)
