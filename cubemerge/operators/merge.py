"""Upsert of update cells into stored cells, as pure DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators.grid import last_valid, sparse

COALESCE = "coalesce"
OVERWRITE = "overwrite"


def merge_coalesce(stored: DataFrame, update: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Outer merge: per variable the update's value where it has one, else the stored one.

    Both sides go through one hash aggregation on the full coordinate tuple: a single shuffle, no sort, and
    groups of at most two rows whatever the distribution of the coordinates.
    """
    tagged = stored.select(*keys, *variables, F.lit(0).alias("_src")).unionByName(
        update.select(*keys, *variables, F.lit(1).alias("_src"))
    )
    return tagged.groupBy(*keys).agg(*[last_valid(v, "_src").alias(v) for v in variables])


def merge_rows(stored: DataFrame, rows: DataFrame, keys: list[str], variables: list[str], order: str) -> DataFrame:
    """Pivot and coalescing merge in one shuffle, for updates that need no interpolation.

    ``rows`` may hold several rows per cell, in a numeric ``order``; stored cells count as the earliest row.
    """
    # a plain long keeps the aggregation hash-based
    rank, oldest = F.col(order).cast("long"), F.lit(-(2**63))
    tagged = stored.select(*keys, *variables, oldest.alias("_rank")).unionByName(
        rows.select(*keys, *variables, rank.alias("_rank"))
    )
    return sparse(tagged.groupBy(*keys).agg(*[last_valid(v, "_rank").alias(v) for v in variables]), variables)


def merge_overwrite(stored: DataFrame, update: DataFrame, keys: list[str], variables: list[str],
                    box: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """Dense semantics: inside the box spanned by the overlap of every dimension the update replaces stored
    cells even where it has no value; cells outside stay.

    ``box`` gives per dimension its key columns and the overlapping values. The stored side is only marked
    through equi-joins on the axes, the cells of both sides are never joined with each other.
    """
    marked = stored.select(*keys, *variables)
    inside = F.lit(True)
    for i, (dim_keys, values) in enumerate(box):
        flag = f"_in{i}"
        marked = marked.join(values.select(*dim_keys, F.lit(True).alias(flag)).distinct(), dim_keys, "left")
        inside = inside & F.coalesce(F.col(flag), F.lit(False))
    kept = marked.where(~inside).select(*keys, *variables)
    return kept.unionByName(sparse(update.select(*keys, *variables), variables))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key as a whole row; a map-side combinable aggregate instead of a ranked window."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return packed.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def split_complete_days(df: DataFrame, time: str) -> DataFrame:
    """Adds ``day`` and ``complete``: every day before the last one in the data is complete."""
    day = F.to_date(F.col(time))
    last = df.agg(F.max(day)).scalar()
    return df.withColumn("day", day).withColumn("complete", F.col("day") < last)
