"""Nearest site for a table of probes, by a grid of cells that is refined where sites are dense.

Level ``l`` cuts the extent of the sites into 8^l x 8^l cells. A cell with more than ``LEAF`` sites lists its (at most 64) children with the box around
their sites, others hold the sites themselves; only cells with sites exist. A probe starts at the root. In every round it looks its cells up by an
equi-join, takes the nearest site of those that are leaves, and keeps of the children only those that may hold a site as near as the nearest one found or
bound to exist, by the boxes. It is done when no cell is left: the bound is proven, whatever lies where. The number of rounds is the depth of the grid, about log64 of
the number of sites, more where sites are crowded; the last level takes what is left there.

The top three levels have at most 1, 64 and 4096 cells and are broadcast; deeper ones are joined by cell, with skewed cells split by adaptive
execution. Probes at one position are one probe, sites at one position one site, so neither side has a hot key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubemerge.session import materialize

LEAF = 64
LEVELS = 10
_BITS = 3
_FINEST = LEVELS * _BITS
_CELLS = 1 << _FINEST
# levels whose number of cells is small whatever the input: 64^2 at most
_BROADCAST = 2


def _finite(column: str) -> Column:
    return F.abs(F.col(column)) < F.lit(float("inf"))


def _cell(level: Column | int, y: str = "iy", x: str = "ix") -> Column:
    """Number of the cell of a finest-level place at a level."""
    shift = F.lit(_FINEST) - F.lit(_BITS) * (F.lit(level) if isinstance(level, int) else level)
    down = lambda c: F.call_function("shiftright", F.col(c), shift.cast("int"))
    return F.call_function("shiftleft", down(y), F.lit(_FINEST)) + down(x)


def _placed(sites: DataFrame, site: str, lat: str, lon: str) -> DataFrame | None:
    """``y, x, site, iy, ix`` of the distinct positions, the smallest site of each; None without any."""
    own = sites.select(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), F.col(site).alias("site"))
    own = own.where(_finite("y") & _finite("x") & F.col("site").isNotNull()).groupBy("y", "x").agg(F.min("site").alias("site"))
    y0, y1, x0, x1 = own.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        return None

    def place(column: str, low: float, high: float) -> Column:
        # halves, so that the extent of the largest doubles is one
        share = (F.col(column) / 2 - F.lit(low / 2)) / F.lit((high / 2 - low / 2) or 1.0)
        return F.least(F.floor(share * _CELLS), F.lit(_CELLS - 1)).cast("long")

    return own.withColumn("iy", place("y", y0, y1)).withColumn("ix", place("x", x0, x1))


def _box() -> list[Column]:
    return [F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]


def site_index(sites: DataFrame, site: str, lat: str, lon: str, leaf: int = LEAF) -> DataFrame | None:
    """``level, cell, children, places``: one row a cell; inner cells have children, leaves have places. A job or three for each level."""
    rest = _placed(sites, site, lat, lon)
    if rest is None:
        return None
    rest = materialize(rest, "nearest")
    rows = None
    for level in range(LEVELS + 1):
        cells = rest.groupBy(_cell(level).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        dense = F.col("n") > leaf if level < LEVELS else F.lit(False)
        cells = materialize(cells.withColumn("dense", dense), "nearest")
        held = rest.withColumn("cell", _cell(level)).join(cells.select("cell", "dense"), "cell")
        # no more than ``leaf`` places, but for the last level
        leaves = held.where("NOT dense").groupBy("cell").agg(F.collect_list(F.struct("y", "x", "site")).alias("places"))
        none = "array<struct<level: int, cell: bigint, y0: double, y1: double, x0: double, x1: double>>"
        part = leaves.select(F.lit(level).alias("level"), "cell", F.lit(None).cast(none).alias("children"), "places")
        if not cells.where("dense").isEmpty():
            rest = materialize(held.where("dense").select("y", "x", "site", "iy", "ix"), "nearest")
            boxes = rest.groupBy(_cell(level).alias("parent"), _cell(level + 1).alias("cell")).agg(*_box())
            child = F.struct(F.lit(level + 1).alias("level"), "cell", "y0", "y1", "x0", "x1")
            inner = boxes.groupBy("parent").agg(F.collect_list(child).alias("children"))
            part = part.unionByName(inner.select(F.lit(level).alias("level"), F.col("parent").alias("cell"), "children", F.lit(None).cast(part.schema["places"].dataType).alias("places")))
            more = True
        else:
            more = False
        rows = part if rows is None else rows.unionByName(part)
        if not more:
            return materialize(rows, "nearest")
    return materialize(rows, "nearest")


def _square(value: Column) -> Column:
    return value * value


def nearest_sites(sites: DataFrame, site: str, lat: str, lon: str, probes: DataFrame, probe: str, max_distance: float | None = None, leaf: int = LEAF) -> DataFrame:
    """(probe, distance2, site, lat, lon): the nearest site to each probe by squared degree distance.

    ``probes`` has the column ``probe`` and positions in ``lat`` and ``lon``. Sites and probes without a finite position are ignored, as are sites without
    a key; ties go to the smaller site key. A probe that repeats is answered as often. Runs jobs.
    """
    out = [probe, "distance2", site, lat, lon]
    index = site_index(sites, site, lat, lon, leaf)
    asked = probes.select(F.col(probe).alias("_probe"), F.col(lat).cast("double").alias("py"), F.col(lon).cast("double").alias("px")).where(_finite("py") & _finite("px"))
    if index is None:
        kind = sites.schema[site].dataType
        return asked.select(F.col("_probe").alias(probe), F.lit(0.0).alias("distance2"), F.lit(None).cast(kind).alias(site), F.col("py").alias(lat), F.col("px").alias(lon)).limit(0).select(*out)
    farthest = F.lit(float("inf") if max_distance is None else max_distance * max_distance)
    best = F.struct(F.lit(None).cast("double").alias("d2"), F.lit(None).cast(sites.schema[site].dataType).alias("site"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("x"))
    front = asked.select("py", "px").distinct().select("py", "px", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell"))
    none = front.select(best.alias("best")).schema["best"].dataType
    front = front.withColumn("best", F.lit(None).cast(none))
    done, depth = None, 0
    while True:
        cells = index.where(F.col("level") == depth)
        joined = front.join(F.broadcast(cells) if depth <= _BROADCAST else cells, ["level", "cell"])
        near = F.transform("places", lambda s: F.struct((_square(s["y"] - F.col("py")) + _square(s["x"] - F.col("px"))).alias("d2"), s["site"].alias("site"), s["y"].alias("y"), s["x"].alias("x")))
        found = F.array_min(F.filter(near, lambda s: s["d2"] <= farthest))
        # distances to the box are rounded as those to the sites in it, so a bound never cuts off a tie
        gap = lambda low, high, at: F.greatest(low - at, F.lit(0.0), at - high)
        reach = lambda low, high, at: F.greatest(F.abs(low - at), F.abs(high - at))
        kids = F.transform("children", lambda c: F.struct(
            (_square(gap(c["y0"], c["y1"], F.col("py"))) + _square(gap(c["x0"], c["x1"], F.col("px")))).alias("least"),
            (_square(reach(c["y0"], c["y1"], F.col("py"))) + _square(reach(c["x0"], c["x1"], F.col("px")))).alias("most"),
            c["cell"].alias("cell"),
        ))
        # what the cell's own children prove is dropped before the rows of a probe meet
        own = joined.select("py", "px", F.array_min(F.array_compact(F.array("best", found))).alias("best"), F.coalesce(kids, F.array().cast("array<struct<least: double, most: double, cell: bigint>>")).alias("kids"))
        limit = F.least(farthest, F.array_min(F.transform("kids", lambda k: k["most"])), F.col("best.d2"))
        own = own.withColumn("limit", limit).withColumn("kids", F.filter("kids", lambda k: k["least"] <= F.col("limit")))
        met = own.groupBy("py", "px").agg(F.min("best").alias("best"), F.min("limit").alias("limit"), F.flatten(F.collect_list("kids")).alias("kids"))
        met = materialize(met.withColumn("kids", F.filter("kids", lambda k: k["least"] <= F.col("limit"))), "nearest")
        over = met.where(F.size("kids") == 0).select("py", "px", "best")
        done = over if done is None else done.unionByName(over)
        depth += 1
        front = met.where(F.size("kids") > 0).select("py", "px", "best", F.explode("kids").alias("k")).select("py", "px", F.lit(depth).alias("level"), F.col("k.cell").alias("cell"), "best")
        if front.isEmpty():
            break
    matched = asked.join(done.where("best IS NOT NULL"), ["py", "px"])
    return matched.select(F.col("_probe").alias(probe), F.col("best.d2").alias("distance2"), F.col("best.site").alias(site), F.col("best.y").alias(lat), F.col("best.x").alias(lon))
