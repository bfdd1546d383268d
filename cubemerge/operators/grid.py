"""Cells and axes: pivot, axis extraction, dimension elimination, dense input and output."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubemerge.operators.blocks import with_position
from cubemerge.schema import NodeSchema


def last_valid(column: str, order: str) -> Column:
    """Last non-NULL value in ``order``; combines on the map side."""
    return F.expr(f"max_by(`{column}`, `{order}`) FILTER (WHERE `{column}` IS NOT NULL)")


def first_valid(column: str, order: str) -> Column:
    return F.expr(f"min_by(`{column}`, `{order}`) FILTER (WHERE `{column}` IS NOT NULL)")


def pivot_cells(df: DataFrame, keys: list[str], variables: list[str], order: str) -> DataFrame:
    """One row per coordinate tuple; per variable the last valid value wins, NULL never overwrites."""
    return df.groupBy(*keys).agg(*[last_valid(v, order).alias(v) for v in variables])


def sparse(cells: DataFrame, variables: list[str]) -> DataFrame:
    """Drop cells without any value; they are not stored."""
    return cells.where(reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in variables]))


def axis_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct coordinate values (tuples for a composed coordinate)."""
    return df.select(*keys).distinct()


def axis(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values in ascending order with their position; runs one job."""
    return with_position(axis_values(df, keys), keys)


def eliminate_dims(df: DataFrame, coords: list[str], variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reduce variables to ``coords``: (values, conflicts).

    A variable must be constant along the dropped dimensions (missing values ignored). ``values`` holds the
    maximum; ``conflicts`` the (variable, coords, low, high) where it was not constant.
    """
    stats = df.groupBy(*coords).agg(
        *[F.max(v).alias(v) for v in variables], *[F.min(v).alias(f"_min_{v}") for v in variables]
    )
    entries = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"_min_{v}").cast("string").alias("low"),
                 F.col(v).cast("string").alias("high"))
        for v in variables
    ])
    conflicts = stats.select(*coords, F.inline(entries)).where(F.col("low") != F.col("high"))
    return stats.select(*coords, *variables), conflicts


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_rows(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, position) of every occurrence of a repeated value, in long form."""
    repeated = duplicates(df, keys).select(*keys)
    return df.select(*keys, position).join(repeated, keys, "left_semi")


def axis_length(start: float, stop: float, step: float) -> int:
    """Number of points of the half-open axis start, start+step, ... < stop."""
    return max(0, math.ceil((stop - start) / step))


def grid_points(spark: SparkSession, lon: tuple[float, float, float], lat: tuple[float, float, float]) -> DataFrame:
    """All (lon, lat) of two half-open arithmetic axes given as (start, stop, step).

    The pair is computed from one running index, so there is no join and the rows spread over all tasks.
    """
    n_lon, n_lat = axis_length(*lon), axis_length(*lat)
    index = spark.range(n_lon * n_lat)
    i = F.col("id") % F.lit(max(n_lon, 1))
    j = F.call_function("div", F.col("id"), F.lit(max(n_lon, 1)))
    return index.select(
        (F.lit(float(lon[0])) + i * F.lit(float(lon[2]))).alias("lon"),
        (F.lit(float(lat[0])) + j * F.lit(float(lat[2]))).alias("lat"),
    )


def product(axes: list[DataFrame]) -> DataFrame:
    """All combinations of several axes, each a frame with a dense ``pos`` column.

    The combinations are enumerated by index arithmetic and looked up by position: equi-joins whose keys
    are all equally frequent, instead of a nested-loop product. Runs a count per axis.
    """
    spark = axes[0].sparkSession
    sizes = [a.count() for a in axes]
    total = 1
    for n in sizes:
        total *= n
    out, stride = spark.range(total), 1
    for i, n in enumerate(sizes):
        pos = F.call_function("div", F.col("id"), F.lit(stride)) % F.lit(max(n, 1))
        out = out.withColumn(f"_p{i}", pos)
        stride *= max(n, 1)
    for i, a in enumerate(axes):
        out = out.join(a.withColumnRenamed("pos", f"_p{i}"), f"_p{i}").drop(f"_p{i}")
    return out.drop("id")


# Positions of the last axis in one block of a dense read.
BLOCK_POSITIONS = 64


def reindex(cells: DataFrame, axes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Cells on exactly the product of the axes, NULL where there is no cell. ``cells`` has one row for a coordinate tuple.

    The result is made in blocks of ``BLOCK_POSITIONS`` neighbours on the last axis. The cells are gathered to blocks by one aggregation and the
    blocks, a 64th of the product, are what is joined; a block then opens into its rows, those without a cell included.
    """
    *others, last = axes
    values = [c for c in cells.columns if c not in keys]
    own = [c for c in last.columns if c != "pos"]
    rest = [k for k in keys if k not in own]
    block, at = F.call_function("div", F.col("pos"), F.lit(BLOCK_POSITIONS)), F.col("pos") % BLOCK_POSITIONS
    # the entries of a block in order of position; positions are dense, so entry i of a block is the position i
    entry = F.struct("pos", *own)
    blocks = last.groupBy(block.alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_axis"))
    spine = product([*others, blocks.withColumnRenamed("_block", "pos").withColumn("_block", F.col("pos"))])
    placed = cells.join(last, own).select(*rest, block.alias("_block"), at.cast("int").alias("_at"), F.struct(*values).alias("_value"))
    filled = placed.groupBy(*rest, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_value"))).alias("_cells"))
    joined = spine.join(filled, [*rest, "_block"], "left")
    # the axis of a label selection keeps its own dense positions
    rows = F.transform("_axis", lambda a, i: F.struct(*[a[k].alias(k) for k in own], *[F.try_element_at("_cells", i)[v].alias(v) for v in values]))
    return joined.select(*rest, F.inline(rows)).select(*keys, *values)


def dense_cells(arrays: DataFrame, dims: list[str], value: str, sizes: dict[str, int], order: list[str]) -> DataFrame:
    """Nested array column to long cells: one position column per dimension.

    ``order`` names the array's nesting from the outside in. A length other than ``sizes`` raises on read.
    """
    out, current = arrays, value
    for dim in order:
        wrong = F.raise_error(F.concat(F.lit(f"{value}: wrong length along {dim}: "), F.size(current).cast("string")))
        checked = F.when(F.size(current) == F.lit(sizes[dim]), F.col(current)).otherwise(wrong.cast(out.schema[current].dataType))
        keep = [c for c in out.columns if c != current]
        out = out.select(*keep, F.posexplode(checked).alias(f"_pos_{dim}", "_item"))
        out = out.withColumn(f"_pos_{dim}", F.col(f"_pos_{dim}").cast("long"))
        current = "_item"
    return out.withColumnRenamed("_item", value) if order else out


def attach_axes(cells: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """Replace ``_pos_<dim>`` by the coordinate values of each axis."""
    for dim, table in axes.items():
        cells = cells.join(table.withColumnRenamed("pos", f"_pos_{dim}"), f"_pos_{dim}").drop(f"_pos_{dim}")
    return cells


def cube_cells(harmonized: DataFrame, schema: NodeSchema, coords: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame | None]:
    """(cells, conflicts) of one cube from harmonized rows.

    A cube over all coordinates is a pivot; one over fewer must be constant along the others: the pivot on
    all coordinates decides each cell first, then the dimension is eliminated.
    """
    names = [v.name for v in schema.cubes()[coords]]
    all_keys = schema.keys_of(tuple(schema.coords))
    keys = schema.keys_of(coords)
    if set(keys) == set(all_keys):
        return sparse(pivot_cells(harmonized, keys, names, order), names).select(*keys, *names), None
    values, conflicts = eliminate_dims(pivot_cells(harmonized, all_keys, names, order), keys, names)
    return sparse(values, names), conflicts
