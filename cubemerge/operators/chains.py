"""Points a limited-step rule keeps, by jump tables of blocks.

The rule is sequential: the first point of a key is kept, then every point at least ``low`` after the last kept one. Points are sorted into
range blocks of bounded size. A key that begins in a block is followed there to its end. Only the key a block begins with may go on from the block
before; for it one backward pass gives each point at which the chain can enter the exit of the block, its last kept point. These jump tables
are merged to runs of one exit (chains meet soon), so they are short whatever the block holds.

Chains then run over blocks: tables are composed in groups of ``FAN``, groups in groups again, until one group of a key is left; its walk gives every
block the point at which the chain comes in. No task sees more than ``FAN`` tables, a key of any size has its points in many tasks, and most
keys, those within one block, take no part in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.session import materialize

# points of a block
BLOCK_POINTS = 1 << 16
# jump tables composed by one task
FAN = 1024

_KEPT, _HEAD, _TAIL = 0, 1, 2
# a block's number has its partition above these bits
_BLOCK_BITS = 33


def _steps(xs: np.ndarray, low: float, at: np.ndarray) -> np.ndarray:
    """For each value of ``at`` the place of the first of the sorted ``xs`` that is at least ``low`` later, len(xs) if none is."""
    # the sum may round: the difference decides
    found = np.searchsorted(xs, at + low)
    while True:
        down = (found > 0) & (xs[np.maximum(found, 1) - 1] - at >= low)
        up = (found < len(xs)) & (xs[np.minimum(found, len(xs) - 1)] - at < low)
        if not (down.any() or up.any()):
            return found
        found = found - down + up


def _merged(enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the last point of a run with one exit has to be known: a chain enters at the first point far enough."""
    last = np.append(leave[1:] != leave[:-1], True) if len(leave) else np.zeros(0, bool)
    return enter[last], leave[last]


def jump_table(xs: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(points a chain may enter at, exits, whether every chain enters) of one block of a key."""
    far = int(_steps(xs, low, xs[:1])[0])
    after = _steps(xs, low, xs).tolist()
    leave = list(range(len(xs)))
    for i in range(len(xs) - 1, -1, -1):
        if after[i] < len(xs):
            leave[i] = leave[after[i]]
    # the last kept point before the block is not after its first one, so no chain enters later than ``far``
    some = min(far + 1, len(xs))
    enter, out = _merged(xs[:some], xs[np.array(leave[:some], np.int64)])
    return enter, out, far < len(xs)


def jump(enter: np.ndarray, leave: np.ndarray, at: np.ndarray, low: float) -> np.ndarray:
    """Last kept points behind the block(s) of a table, given those before; a chain that does not enter stays where it was."""
    if not len(enter):
        return at
    found = _steps(enter, low, at)
    return np.where(found < len(enter), leave[np.minimum(found, len(enter) - 1)], at)


def _follow(values: list, low: float, last=None) -> tuple[list[int], list]:
    """Places of the kept values and the kept value before each (None at a start)."""
    places, before = [], []
    for i, value in enumerate(values):
        if last is None or value - last >= low:
            places.append(i)
            before.append(last)
            last = value
    return places, before


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Rows whose keys differ from the row before; NULL equals NULL."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for column in columns:
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _packed(xs: np.ndarray) -> bytes:
    return np.ascontiguousarray(xs).tobytes()


def _cut(low: float, kind: type, shape: T.StructType, points: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task step over sorted points: kept points of the keys that begin in a block, the first key's points with their jump table, and where the last key's chain stands."""

    number_type = pa.int64() if kind is np.int64 else pa.float64()

    def rows(keys: list[pa.Array], at: list[int], number: int, what: int, x: list, prev: list | None = None, head: tuple | None = None) -> pa.RecordBatch:
        n = len(at)
        table = [pa.array([b], pa.binary()) if head else pa.nulls(n, pa.binary()) for b in (head or (None,) * 4)[:3]]
        columns = [
            *(k.take(pa.array(at, pa.int64())) for k in keys), pa.array([number] * n, pa.int64()), pa.array([what] * n, pa.int32()), pa.array(x, number_type),
            pa.array([None] * n if prev is None else prev, number_type), *table, pa.array([head[3]] if head else [None] * n, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=shape.names)

    def block(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        keys = [c.combine_chunks() for c in table.columns[:-1]]
        xs = table.column(table.num_columns - 1).to_numpy().astype(kind, copy=False)
        starts = np.flatnonzero(_changes(keys)).tolist()
        head = starts[0] if starts else len(xs)
        enter, leave, whole = jump_table(xs[:head], low)
        # the first run holds the block's first point: where a chain that starts there stands in the end
        yield rows(keys, [0], number, _HEAD, [leave[0].item()], head=(_packed(xs[:head]), _packed(enter), _packed(leave), whole))
        if head == len(xs):
            return
        begins, last, at, prev = set(starts), None, [], []
        values = xs.tolist()
        for i in range(head, len(values)):
            if i in begins:
                last = None
            if last is None or values[i] - last >= low:
                at.append(i)
                prev.append(last)
                last = values[i]
        yield rows(keys, at, number, _KEPT, xs[at], prev)
        yield rows(keys, [len(xs) - 1], number, _TAIL, [last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(0)[0].as_py() << _BLOCK_BITS
            held.append(batch.select(batch.schema.names[1:]))
            size += batch.num_rows
            if size >= points:
                yield from block(pa.Table.from_batches(held), number)
                held, size, number = [], 0, number + 1
        if size:
            yield from block(pa.Table.from_batches(held), number)

    return run


def _read(row: dict, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["enter"], kind), np.frombuffer(row["leave"], kind)


def _compose(low: float, kind: type, keys: list[str], shape: pa.Schema):
    """One table for a run of tables of a key; ``first`` is known where the run holds the key's start."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        first = rows[0]["first"]
        if first is not None:
            at = np.array([first], kind)
            for row in rows[1:]:
                at = jump(*_read(row, kind), at, low)
            enter = leave = np.zeros(0, kind)
            first, whole = at[0].item(), True
        else:
            enter, leave = _read(rows[-1], kind)
            whole = rows[-1]["whole"]
            for row in reversed(rows[:-1]):
                own, out = _read(row, kind)
                out = jump(enter, leave, out, low)
                if not row["whole"]:
                    own, out = np.concatenate([own, enter]), np.concatenate([out, leave])
                whole = whole or row["whole"]
                enter, leave = _merged(own, out)
        keep = table.slice(0, 1).select([*keys, "g"])
        made = {"i": [rows[0]["g"]], "first": [first], "enter": [_packed(enter)], "leave": [_packed(leave)], "whole": [whole]}
        for name, value in made.items():
            keep = keep.append_column(name, pa.array(value, shape.field(name).type))
        return keep.select([*keys, *made]).cast(shape)

    return run


def _walk(low: float, kind: type, keys: list[str]):
    """The last kept point before each item of a run, from the one before the run (``e``) or the key's start."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        rows = table.select(["first", "e", "enter", "leave"]).to_pylist()
        at, came = rows[0]["e"], []
        for row in rows:
            came.append(at)
            at = row["first"] if row["first"] is not None else jump(*_read(row, kind), np.array([at], kind), low)[0].item()
        return table.select([*keys, "i"]).append_column("e", pa.array(came, table.schema.field("first").type))

    return run


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL equals NULL; the columns of ``left``, then those of ``right`` that are no keys."""
    others = [c for c in right.columns if c not in on]
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *others)
    return left.join(renamed, [left[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on], how).select(*left.columns, *others)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _incoming(tables: DataFrame, keys: list[str], low: float, kind: type, fan: int) -> DataFrame:
    """(keys, i, e): the last kept point before item ``i`` of each key, NULL at its start."""
    own = T.StructType([tables.schema[k] for k in keys])
    number = T.LongType() if kind is np.int64 else T.DoubleType()
    walked = T.StructType([*own.fields, T.StructField("i", T.LongType()), T.StructField("e", number)])
    groups = tables.withColumn("g", F.col("i").cast("long") - F.col("i") % fan)
    groups = groups.withColumn("g", (F.col("g") / fan).cast("long"))
    if tables.agg(F.max("i")).first()[0] < fan:
        return tables.withColumn("e", F.lit(None).cast(number)).groupBy(*keys).applyInArrow(_walk(low, kind, keys), walked)
    composed = T.StructType([*own.fields, *(tables.schema[c] for c in ("i", "first", "enter", "leave", "whole"))])
    runs = materialize(groups.groupBy(*keys, "g").applyInArrow(_compose(low, kind, keys, _arrow_schema(composed)), composed), "chains")
    before = _incoming(runs, keys, low, kind, fan).withColumnRenamed("i", "g")
    return same(groups, before, [*keys, "g"]).groupBy(*keys, "g").applyInArrow(_walk(low, kind, keys), walked)


def _enter(low: float, kind: type, shape: T.StructType):
    """Task step: kept points of the first key of a block, whose chain comes in at ``e`` (NULL: it starts here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.int64() if kind is np.int64 else pa.float64()
        for batch in batches:
            owner, found, before = [], [], []
            for i, (data, at) in enumerate(zip(batch.column("xs").to_pylist(), batch.column("e").to_pylist(), strict=True)):
                values = np.frombuffer(data, kind).tolist()
                places, last = _follow(values, low, at)
                owner += [i] * len(places)
                found += [values[p] for p in places]
                before += last
            keys = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found, number), pa.array(before, number)], names=shape.names)

    return run


def kept_points(points: DataFrame, keys: list[str], x: str, low: float, points_a_block: int = BLOCK_POINTS, fan: int = FAN) -> DataFrame:
    """``keys, x, _prev``: the points the rule keeps, with the kept point before (NULL at a start).

    ``points`` are distinct, with ``x`` long or double and not NULL; ``low`` is not negative. A NULL key is a key of its own. Runs three jobs, and four more
    for each power of ``fan`` blocks that one key spans.
    """
    kind = np.int64 if isinstance(points.schema[x].dataType, T.LongType) else np.float64
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    rows = points.select(*(own or [F.lit(0).alias("_k0")]), F.col(x).alias("_x"))
    ordered = rows.repartitionByRange(*names, "_x").sortWithinPartitions(*names, "_x").select(F.spark_partition_id().cast("long").alias("_part"), *names, "_x")
    number = points.schema[x].dataType
    shape = T.StructType([
        *(rows.schema[n] for n in names), T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("x", number), T.StructField("prev", number),
        T.StructField("xs", T.BinaryType()), T.StructField("enter", T.BinaryType()), T.StructField("leave", T.BinaryType()), T.StructField("whole", T.BooleanType()),
    ])
    cut = materialize(ordered.mapInArrow(_cut(low, kind, shape, points_a_block), shape), "chains")
    done = cut.where(F.col("kind") == _KEPT).select(*names, "x", "prev")
    heads = cut.where(F.col("kind") == _HEAD)
    # two rows a block at most; a key's rows are its blocks
    marks = cut.where(F.col("kind") != _KEPT).select(*names, "block", "kind", "x")
    order = Window.partitionBy(*names).orderBy("block", "kind")
    placed = marks.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*names))).where("n > 1")
    placed = materialize(placed.select(*names, "block", "kind", "i", F.col("x")), "chains")
    kept = T.StructType([*(rows.schema[n] for n in names), T.StructField("x", number), T.StructField("prev", number)])
    starts = heads.select(*names, "block", "xs")
    if placed.isEmpty():
        starts = starts.withColumn("e", F.lit(None).cast(number))
    else:
        jumps = placed.join(heads.select("block", F.lit(_HEAD).alias("kind"), "enter", "leave", "whole"), ["block", "kind"], "left")
        # the first item of a key: where its chain stands behind the block it starts in
        first = F.when(F.col("i") == 0, F.col("x"))
        tables = materialize(jumps.select(*names, F.col("i").cast("long").alias("i"), first.alias("first"), "enter", "leave", "whole"), "chains")
        came = _incoming(tables, names, low, kind, fan)
        into = same(placed.where(F.col("kind") == _HEAD).select(*names, "block", F.col("i").cast("long").alias("i")), came, [*names, "i"]).select("block", "e")
        starts = starts.join(into, "block", "left")
    entered = starts.select(*names, "xs", "e").mapInArrow(_enter(low, kind, kept), kept)
    out = done.unionByName(entered)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=False)], F.col("x").alias(x), F.col("prev").alias("_prev"))

