"""Read-side views: map slices, time series, clusters, reports."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions.geo import in_radians
from cubemerge.functions.values import finite_or_null, is_finite
from cubemerge.operators.blocks import with_position
from cubemerge.operators.lookup import Probe, ancestors, nearest_site
from cubemerge.operators.select import viewport


def first_finite(cells: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """First finite value per entity in ``order`` over all remaining dimensions; NULL when there is none."""
    finite = cells.withColumn("_v", finite_or_null(F.col(value))).withColumn("_o", F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return finite.groupBy(entity).agg(F.expr("min_by(_v, _o) FILTER (WHERE _v IS NOT NULL)").alias(value))


def nearest_fill(cells: DataFrame, entity: str, position: str, index: int, columns: list[str]) -> DataFrame:
    """Per entity and column the valid value at the index position nearest to ``index``, earlier on a tie.

    A plain aggregation with map-side combine: no window over an entity's whole history.
    """
    # distance and side in one number: smaller is nearer, an earlier position comes before a later one
    near = (F.abs(F.col(position) - F.lit(index)) * 2 + (F.col(position) > F.lit(index)).cast("int")).cast("long")
    ranked = cells.withColumns({f"_f{c}": finite_or_null(F.col(c)) for c in columns}).withColumn("_near", near)
    return ranked.groupBy(entity).agg(*[
        F.expr(f"min_by(`_f{c}`, _near) FILTER (WHERE `_f{c}` IS NOT NULL)").alias(c) for c in columns
    ])


def map_slice(values: DataFrame, positions: DataFrame, entity: str, value: str, lat: str, lon: str) -> DataFrame:
    """(entity_index, site_id, lat, lon, value, has_value): one row per entity with a valid position.

    ``values`` and ``positions`` hold one row per entity already (see first_finite, nearest_fill). Entities
    keep their row when the value is missing. The index counts the rows kept, in entity order. Runs a job.
    """
    located = positions.where(is_finite(F.col(lat)) & is_finite(F.col(lon))).select(entity, lat, lon)
    joined = located.join(values.select(entity, finite_or_null(F.col(value)).alias(value)), entity, "left")
    return with_position(joined, [entity], "entity_index").select(
        "entity_index",
        F.col(entity).cast("string").alias("site_id"),
        F.col(lat).alias("lat"),
        F.col(lon).alias("lon"),
        F.col(value).alias("value"),
        F.col(value).isNotNull().alias("has_value"),
    )


def slice_counters(values: DataFrame, positions: DataFrame, entity: str, value: str, lat: str, lon: str) -> DataFrame:
    """Totals of a map slice: entities, valid positions, finite values, missing values and positions."""
    joined = positions.join(values.select(entity, value), entity, "left")
    placed = is_finite(F.col(lat)) & is_finite(F.col(lon))
    present = is_finite(F.col(value))
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(placed).alias("valid_coords"),
        F.count_if(placed & present).alias("finite_values"),
        F.count_if(placed & ~present).alias("missing_values"),
        F.count_if(~placed).alias("missing_coords"),
    )


def series_at(cells: DataFrame, sites: DataFrame, entity: str, lat: str, lon: str, at: Probe, time: str,
              value: str, depth: str | None = None, max_distance: float | None = None) -> DataFrame:
    """Time series of the site nearest to a point, one series per depth, in long form.

    The site is a scalar subquery on the site table, so only its cells leave the scan.
    """
    site = nearest_site(sites, entity, lat, lon, [at], max_distance).select(entity).scalar()
    columns = [entity] + ([depth] if depth else []) + [time]
    return cells.where(F.col(entity) == site).select(*columns, finite_or_null(F.col(value)).alias(value))


def depths_with_values(series: DataFrame, depth: str, value: str) -> DataFrame:
    """Depths that have any finite value, with their count."""
    return series.groupBy(depth).agg(F.count(finite_or_null(F.col(value))).alias("n")).where("n > 0")


def cluster_points(df: DataFrame, lon: str, lat: str, label: str, x_range: tuple[float, float] | None = None,
                   y_range: tuple[float, float] | None = None, eps_factor: float = 0.05,
                   buffer_factor: float = 0.1) -> DataFrame:
    """Points of a map view merged per grid cell: mean position, count, first label in label order.

    The cell size is a share of the view's width; coordinates round half to even. Without a view every point
    is its own cluster.
    """
    if x_range is None or y_range is None:
        return df.select(F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.lit(1).cast("long").alias("merged_count"),
                         F.col(label).alias("label"))
    eps = (x_range[1] - x_range[0]) * eps_factor
    cell = lambda c: F.rint(F.col(c) / F.lit(eps)) * F.lit(eps)
    seen = viewport(df, lon, lat, x_range, y_range, buffer_factor)
    return seen.groupBy(cell(lon).alias("grid_lon"), cell(lat).alias("grid_lat")).agg(
        F.avg(lon).alias("lon"),
        F.avg(lat).alias("lat"),
        F.count(F.lit(1)).alias("merged_count"),
        F.min(label).alias("label"),
    )


def repair_positions(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Swap lat and lon of a batch whose means say so, and turn radians into degrees.

    The decision is a one-row aggregate over the valid rows, read back as a scalar subquery.
    """
    valid = df.where(is_finite(F.col(lat)) & is_finite(F.col(lon)) & (F.abs(lat) <= 360))
    stats = valid.agg(
        ((F.avg(lat) < 30) & (F.avg(lon) > 30)).alias("swap"),
        in_radians(F.col(lat)).alias("rad_lat"),
        in_radians(F.col(lon)).alias("rad_lon"),
    )
    swap = F.coalesce(F.col("swap"), F.lit(False))
    radians = F.coalesce(F.when(swap, F.col("rad_lon")).otherwise(F.col("rad_lat")), F.lit(False))
    decision = stats.select(F.struct(swap.alias("swap"), radians.alias("rad"))).scalar()
    marked = df.withColumn("_fix", decision)
    first, second = F.col("_fix.swap"), F.col("_fix.rad")
    new_lat = F.when(first, F.col(lon)).otherwise(F.col(lat))
    new_lon = F.when(first, F.col(lat)).otherwise(F.col(lon))
    scale = lambda c: F.when(second, F.degrees(c)).otherwise(c)
    return marked.withColumns({lat: scale(new_lat), lon: scale(new_lon)}).drop("_fix")


def map_focus(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """(center_lat, center_lon, span, zoom) of the plausible positions; one row."""
    plot = df.where(is_finite(F.col(lat)) & (F.abs(lat) <= 90))
    stats = plot.agg(
        F.avg(lat).alias("center_lat"),
        F.avg(lon).alias("center_lon"),
        F.greatest(F.max(lat) - F.min(lat), F.max(lon) - F.min(lon)).alias("span"),
    )
    span = F.col("span")
    zoom = F.when(span < 1, 9).when(span < 5, 7).when(span < 15, 5).otherwise(3)
    return stats.withColumn("zoom", zoom)


def zoom_windows(df: DataFrame, time: str, center: datetime | None, spans: dict[str, timedelta]) -> DataFrame:
    """(view, start, end): a window of each span around the centre, moved inside the data's range.

    Without a centre the middle of the data is used; a span longer than the data gives the whole range.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    stats = df.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    as_micros = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    middle = F.lit(as_micros(center)) if center else F.col("lo") + F.call_function("div", F.col("hi") - F.col("lo"), F.lit(2))
    views = F.array(*[
        F.struct(F.lit(name).alias("view"), F.lit(span // timedelta(microseconds=1)).cast("long").alias("span"))
        for name, span in spans.items()
    ])
    rows = stats.select("lo", "hi", middle.alias("mid"), F.inline(views))
    lo, hi, span = F.col("lo"), F.col("hi"), F.col("span")
    start = F.col("mid") - F.call_function("div", span, F.lit(2))
    start = F.greatest(lo, F.least(start, hi - span))
    whole = span >= hi - lo
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return rows.select(
        "view",
        stamp(F.when(whole, lo).otherwise(start)).alias("start"),
        stamp(F.when(whole, hi).otherwise(start + span)).alias("end"),
    )


def variable_report(df: DataFrame, variables: list[str], dims: dict[str, list[str]] | None = None) -> DataFrame:
    """(variable, dtype, dims, size, valid_count, missing_count): one aggregate, unpivoted."""
    counts = {v: F.count(finite_missing(df, v)).alias(v) for v in variables}
    row = df.agg(F.count(F.lit(1)).alias("_size"), *counts.values())
    entries = F.array(*[
        F.struct(
            F.lit(v).alias("variable"),
            F.lit(df.schema[v].dataType.simpleString()).alias("dtype"),
            F.lit(",".join((dims or {}).get(v, []))).alias("dims"),
            F.col("_size").alias("size"),
            F.col(v).alias("valid_count"),
            (F.col("_size") - F.col(v)).alias("missing_count"),
        )
        for v in variables
    ])
    return row.select(F.inline(entries))


def finite_missing(df: DataFrame, column: str) -> Column:
    """Column with NaN counted as missing."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), F.col(column))
    return F.col(column)


def sample_stats(df: DataFrame, order: list[str], variables: list[str], first: int = 100) -> DataFrame:
    """(variable, n, min, max) over the first rows in ``order``; the sort keeps only ``first`` rows per task."""
    head = df.orderBy(*order).limit(first)
    row = head.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")).alias(v)
        for v in variables
    ])
    entries = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}.n").alias("n"), F.col(f"{v}.lo").alias("min"),
                 F.col(f"{v}.hi").alias("max"))
        for v in variables
    ])
    return row.select(F.inline(entries))


def first_values(df: DataFrame, order: list[str], columns: list[str], first: int = 10) -> DataFrame:
    """The first rows in ``order``."""
    return df.select(*dict.fromkeys(order + columns)).orderBy(*order).limit(first).select(*columns)


def coord_overview(axes: DataFrame) -> DataFrame:
    """(path, coord, n, low, high) per node over the union of its own and its subtree's coordinate values.

    ``axes`` has (path, coord, value); each row is repeated once per ancestor, duplicates are removed before
    counting.
    """
    up = axes.select("coord", "value", F.inline(ancestors(F.col("path"))))
    distinct = up.select(F.col("prefix").alias("path"), "coord", "value").distinct()
    return distinct.groupBy("path", "coord").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def median_value(axis: DataFrame) -> DataFrame:
    """The axis value nearest to the median: the middle one, the lower of two middle ones."""
    last = axis.agg(F.max("pos")).scalar()
    return axis.where(F.col("pos") == F.call_function("div", last, F.lit(2))).drop("pos")


def column_extent(df: DataFrame, column: str) -> DataFrame:
    """(n_distinct, low, high) of a column."""
    return df.agg(
        F.count_distinct(column).alias("n_distinct"), F.min(column).alias("low"), F.max(column).alias("high")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)


def flag_union(grid: DataFrame, sites: DataFrame, flag: str = "grid") -> DataFrame:
    """Grid points and sites in one frame, flagged by origin."""
    return grid.withColumn(flag, F.lit(True)).unionByName(sites.withColumn(flag, F.lit(False)))
