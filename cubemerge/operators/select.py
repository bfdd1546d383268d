"""Row selection on cells, tables and node catalogs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.functions.text import glob_to_regex


def sel(cells: DataFrame, axes: dict[str, DataFrame] | None = None, **labels: Any) -> DataFrame:
    """Label selection: scalar, list, or slice with both ends included.

    Plain comparisons on key columns, so they reach the parquet scan. With ``axes``, a scalar that is not on
    its axis raises KeyError.
    """
    for name, label in labels.items():
        column = F.col(name)
        dtype = cells.schema[name].dataType
        lit = lambda v: F.lit(v).cast(dtype)
        if isinstance(label, slice):
            if label.start is not None:
                cells = cells.where(column >= lit(label.start))
            if label.stop is not None:
                cells = cells.where(column <= lit(label.stop))
        elif isinstance(label, (list, tuple, set)):
            cells = cells.where(column.isin([lit(v) for v in label]))
        else:
            if axes and name in axes and axes[name].where(F.col(name) == lit(label)).isEmpty():
                raise KeyError(f"{name}={label!r}")
            cells = cells.where(column == lit(label))
    return cells


def isel(cells: DataFrame, axis: DataFrame, keys: list[str], index: int | slice) -> DataFrame:
    """Index selection by axis position (slice end excluded, negatives from the end)."""
    if isinstance(index, slice) or index < 0:
        count = axis.count()
        if not isinstance(index, slice):
            wanted = F.col("pos") == F.lit(index + count)
        else:
            start, stop, step = index.indices(count)
            if step != 1:
                raise ValueError("slices have step 1")
            wanted = (F.col("pos") >= F.lit(start)) & (F.col("pos") < F.lit(stop))
    else:
        wanted = F.col("pos") == F.lit(index)
    return cells.join(axis.where(wanted).select(*keys), keys, "left_semi")


def box_match(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, epsilon: float = 0.001) -> DataFrame:
    """Rows within ``epsilon`` of a point; if there are none, rows that match with lat and lon swapped.

    One scan: both conditions are pushed down together, and whether the straight match exists is a scalar
    subquery over it.
    """
    def near(column: str, value: float):
        return F.col(column).between(F.lit(value - epsilon), F.lit(value + epsilon))

    straight = near(lat, at_lat) & near(lon, at_lon)
    swapped = near(lon, at_lat) & near(lat, at_lon)
    found = df.where(straight).agg(F.count(F.lit(1)) > 0).scalar()
    return df.where(straight | swapped).where(straight | ~found)


def viewport(df: DataFrame, lon: str, lat: str, x_range: tuple[float, float], y_range: tuple[float, float],
             buffer_factor: float = 0.1) -> DataFrame:
    """Points in a map view widened by a share of its width on every side."""
    margin = (x_range[1] - x_range[0]) * buffer_factor
    return df.where(
        F.col(lon).between(F.lit(x_range[0] - margin), F.lit(x_range[1] + margin))
        & F.col(lat).between(F.lit(y_range[0] - margin), F.lit(y_range[1] + margin))
    )


def clean_sites(df: DataFrame, site: str, lat: str, lon: str) -> DataFrame:
    """Rows with a non-empty id and numeric positions, positions as doubles."""
    named = df.where(F.col(site).isNotNull() & (F.col(site) != ""))
    typed = named.withColumns({c: F.col(c).try_cast("double") for c in (lat, lon)})
    return typed.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def required_columns(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete, rejected): rows whose required columns are all present and not blank, and the others with
    the list of missing columns."""
    blanks = F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), F.lit(c)) for c in required
    ]))
    marked = df.withColumn("missing", F.array_join(blanks, ","))
    return marked.where("missing = ''").drop("missing"), marked.where("missing <> ''")


def match_nodes(catalog: DataFrame, pattern: str, path: str = "path", store: str | None = None) -> DataFrame:
    """Catalog rows whose node path, alone or after the store's name, matches a glob."""
    regex = glob_to_regex(pattern)
    matched = F.col(path).rlike(regex)
    if store:
        full = F.when(F.col(path) == "", F.lit(store)).otherwise(F.concat(F.lit(store + "/"), F.col(path)))
        matched = matched | full.rlike(regex)
    return catalog.where(matched)


def corner(cells: DataFrame, axes: dict[str, DataFrame], first: dict[str, int]) -> DataFrame:
    """Cells within the first n positions of each given dimension."""
    for name, n in first.items():
        keys = [c for c in axes[name].columns if c != "pos"]
        cells = cells.join(axes[name].where(F.col("pos") < F.lit(n)).select(*keys), keys, "left_semi")
    return cells


def recent_events(events: DataFrame, time: str, level: str, last: int, levels: Iterable[str] = ("error", "warning")) -> DataFrame:
    """The newest ``last`` events, then only the given levels: the limit comes before the filter."""
    order = [F.col(time).desc()] + [F.col(c).desc() for c in events.columns if c not in (time, level)]
    return events.orderBy(*order).limit(last).where(F.lower(level).isin(list(levels)))
