"""Order-dependent work without one-task windows.

A window over one hot key (or over no key at all) runs in one task. Here the rows are range-partitioned on
(keys, order) into blocks of similar size, windows run inside (block, keys), and the few values that have to
cross a block border are carried over from a summary with at most two rows per block border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.session import materialize

BLOCK = "_block"
ROW = "_row"

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits
_ROW_BITS = 33


def range_blocks(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """Sort into range blocks and write them once, adding ``_block`` and ``_row`` (0-based within the block).

    ``order`` must identify a row (add a tie-breaker), so that a block border can fall anywhere.
    Runs a job: the block of a row has to be the same for every later reader.
    """
    # without a number adaptive execution sizes the blocks by bytes, so a short axis stays one block
    parted = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    numbered = (
        parted
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return materialize(
        numbered.withColumn(BLOCK, F.shiftright("_id", _ROW_BITS).cast("int"))
        .withColumn(ROW, F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id"),
        "blocks",
    )


# Rows that one task may number.
FEW_ROWS = 10_000


def with_position(df: DataFrame, order: list[str], name: str = "pos", blocks: int | None = None, rows: int | None = None) -> DataFrame:
    """Dense 0-based position in ``order`` over the whole frame; runs one job, no single-task sort.

    ``rows``: their number where it is known. A few need no blocks and no job.
    """
    if rows is not None and rows <= FEW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    cut = range_blocks(df, order, blocks)
    sizes = cut.groupBy(BLOCK).agg((F.max(ROW) + 1).alias("_n"))
    # one row per block, so the running total is bounded by the number of blocks
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        cut.join(F.broadcast(starts), BLOCK)
        .withColumn(name, F.col("_start") + F.col(ROW))
        .drop(BLOCK, ROW, "_start")
    )


def _same(keys: list[str], left: str, right: str) -> Column:
    conditions = [F.col(f"{left}.{BLOCK}") == F.col(f"{right}.{BLOCK}")]
    conditions += [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, conditions)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    before: str | None = None,
    after: str | None = None,
    include_current: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Nearest non-NULL ``value`` at or before / at or after each row, per ``keys`` in ``order``.

    ``before``/``after`` name the result columns. ``(keys, order)`` must identify a row. Runs one job.
    """
    cut = range_blocks(df.withColumn("_v", value), keys + order, blocks)
    # both directions as growing frames, the second in descending order: a frame that ends at "unbounded
    # following" is evaluated anew for every row
    so_far = (Window.unboundedPreceding, 0 if include_current else -1)
    inside = Window.partitionBy(BLOCK, *keys)
    local = cut
    if before:
        local = local.withColumn("_lp", F.last("_v", ignorenulls=True).over(inside.orderBy(ROW).rowsBetween(*so_far)))
    if after:
        local = local.withColumn("_ln", F.last("_v", ignorenulls=True).over(inside.orderBy(F.desc(ROW)).rowsBetween(*so_far)))
    # first and last valid value of every (block, key); only keys that reach over a border matter below
    ends = cut.groupBy(BLOCK, *keys).agg(
        F.expr("max_by(_v, _row) FILTER (WHERE _v IS NOT NULL)").alias("_last"),
        F.expr("min_by(_v, _row) FILTER (WHERE _v IS NOT NULL)").alias("_first"),
        F.min(ROW).alias("_lo"),
        F.max(ROW).alias("_hi"),
    )
    edges = cut.groupBy(BLOCK).agg(F.max(ROW).alias("_end"))
    # a key crosses a border only if it holds the first or the last row of its block: two keys per block
    border = ends.join(F.broadcast(edges), BLOCK).where((F.col("_lo") == 0) | (F.col("_hi") == F.col("_end")))
    across, earlier = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carry = border.select(
        BLOCK,
        *keys,
        F.last("_last", ignorenulls=True).over(across.orderBy(BLOCK).rowsBetween(*earlier)).alias("_cp"),
        F.last("_first", ignorenulls=True).over(across.orderBy(F.desc(BLOCK)).rowsBetween(*earlier)).alias("_cn"),
    ).where(F.col("_cp").isNotNull() | F.col("_cn").isNotNull())
    # broadcast bound: at most two rows per block
    joined = local.alias("l").join(F.broadcast(carry.alias("c")), _same(keys, "l", "c"), "left")
    columns = [F.col(f"l.{c}") for c in df.columns]
    if before:
        columns.append(F.coalesce(F.col("_lp"), F.col("c._cp")).alias(before))
    if after:
        columns.append(F.coalesce(F.col("_ln"), F.col("c._cn")).alias(after))
    return joined.select(*columns)
