"""View queries: map slices, nearest sites, series, clusters, repairs, reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators import grid, lookup, nearest, views
from cubemerge.operators.lookup import Probe
from cubemerge.plans.gridding import DAYS, VALID, cells
from cubemerge.plans.harmonizing import SUPPLIER_SITE, sites
from cubemerge.plans.registry import Tables, query

# Positions of event sites per day, missing where the reading is small or large.
POSITIONED = f"""(SELECT date_trunc('day', ts) AS "time", user_id AS site, event_type AS kind, {VALID} AS value, event_id,
  CASE WHEN value >= 20 THEN 49e0 + (user_id % 20) * 1e-2 + day(ts) * 1e-3 END AS lat,
  CASE WHEN value <= 90 THEN 14e0 + (user_id % 30) * 1e-2 + day(ts) * 1e-3 END AS lon FROM events)"""
TIME_INDEX = 12
KIND_INDEX = 1


def positioned(t: Tables) -> DataFrame:
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("time")
    return t.events.select(
        day, F.col("user_id").alias("site"), F.col("event_type").alias("kind"), F.expr(VALID).alias("value"), "event_id",
        F.expr("CASE WHEN value >= 20 THEN 49e0 + (user_id % 20) * 1e-2 + day(ts) * 1e-3 END").alias("lat"),
        F.expr("CASE WHEN value <= 90 THEN 14e0 + (user_id % 30) * 1e-2 + day(ts) * 1e-3 END").alias("lon"),
    )


def _at_index(axis: DataFrame, key: str, index: int):
    """Axis value at a position as a scalar subquery."""
    return axis.where(F.col("pos") == F.lit(index)).select(key).scalar()


def slice_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(values, positions): one row per site at the chosen day and kind, positions filled from near days."""
    rows = positioned(t)
    days, kinds = grid.axis(rows, ["time"]), grid.axis(rows, ["kind"])
    chosen = rows.where((F.col("time") == _at_index(days, "time", TIME_INDEX)) & (F.col("kind") == _at_index(kinds, "kind", KIND_INDEX)))
    values = grid.pivot_cells(chosen, ["site"], ["value"], "event_id")
    placed = grid.pivot_cells(rows, ["time", "site"], ["lat", "lon"], "event_id").join(days, "time")
    return values, views.nearest_fill(placed, "site", "pos", TIME_INDEX, ["lat", "lon"])


_SLICE = f"""
WITH r AS (FROM {POSITIONED}),
d AS (SELECT "time", row_number() OVER (ORDER BY "time") - 1 AS pos FROM (SELECT DISTINCT "time" FROM r)),
k AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS pos FROM (SELECT DISTINCT kind FROM r)),
v AS (SELECT site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM r
  WHERE "time" = (SELECT "time" FROM d WHERE pos = {TIME_INDEX}) AND kind = (SELECT kind FROM k WHERE pos = {KIND_INDEX}) GROUP BY site),
p AS (SELECT "time", site, arg_max(lat, event_id) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lon, event_id) FILTER (WHERE lon IS NOT NULL) AS lon
  FROM r GROUP BY "time", site),
f AS (SELECT site, arg_min(lat, (abs(pos - {TIME_INDEX}), pos)) FILTER (WHERE lat IS NOT NULL) AS lat,
  arg_min(lon, (abs(pos - {TIME_INDEX}), pos)) FILTER (WHERE lon IS NOT NULL) AS lon FROM p JOIN d USING ("time") GROUP BY site)"""


@query("nearest_fill", _SLICE + " SELECT site, lat, lon FROM f")
def nearest_fill(t: Tables) -> DataFrame:
    return slice_parts(t)[1]


@query("map_slice", _SLICE + """
SELECT row_number() OVER (ORDER BY site) - 1 AS entity_index, CAST(site AS VARCHAR) AS site_id, lat, lon, value, value IS NOT NULL AS has_value
FROM f LEFT JOIN v USING (site) WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def map_slice(t: Tables) -> DataFrame:
    values, positions = slice_parts(t)
    return views.map_slice(values, positions, "site", "value", "lat", "lon")


@query("slice_counters", _SLICE + """
SELECT count(*) AS total, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS valid_coords,
 count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND value IS NOT NULL) AS finite_values,
 count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND value IS NULL) AS missing_values,
 count(*) FILTER (WHERE lat IS NULL OR lon IS NULL) AS missing_coords
FROM f LEFT JOIN v USING (site)""")
def slice_counters(t: Tables) -> DataFrame:
    values, positions = slice_parts(t)
    return views.slice_counters(values, positions, "site", "value", "lat", "lon")


@query("first_finite", f"""
SELECT site, arg_min(value, ("time", kind, event_id)) FILTER (WHERE value IS NOT NULL) AS value FROM {DAYS} GROUP BY site""")
def first_finite(t: Tables) -> DataFrame:
    return views.first_finite(cells(t, "DAY"), "site", "value", ["time", "kind", "event_id"])


PROBES = [Probe(49.047, 14.121), Probe(49.123, 14.052), Probe(50.0, 15.0)]
_PROBES = "(VALUES (0, 49.047e0, 14.121e0), (1, 49.123e0, 14.052e0), (2, 50.0e0, 15.0e0)) AS q(probe, plat, plon)"
_NEAREST = f"""(SELECT probe, s_suppkey, lat, lon, (lat - plat) * (lat - plat) + (lon - plon) * (lon - plon) AS d2
FROM (SELECT {SUPPLIER_SITE} FROM supplier), {_PROBES})"""


@query("nearest_site", f"""
SELECT probe, round(d2, 9) AS distance2, s_suppkey, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, s_suppkey) AS rn FROM {_NEAREST}) WHERE rn = 1""")
def nearest_site(t: Tables) -> DataFrame:
    found = lookup.nearest_site(sites(t), "s_suppkey", "lat", "lon", PROBES)
    return found.withColumn("distance2", F.round("distance2", 9))


@query("nearest_site_within", f"""
SELECT probe, round(d2, 9) AS distance2, s_suppkey, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY d2, s_suppkey) AS rn FROM {_NEAREST} WHERE d2 <= 5e-2 * 5e-2) WHERE rn = 1""")
def nearest_site_within(t: Tables) -> DataFrame:
    found = lookup.nearest_site(sites(t), "s_suppkey", "lat", "lon", PROBES, max_distance=0.05)
    return found.withColumn("distance2", F.round("distance2", 9))


# Customers as probes: most lie between the sites, every eleventh far off, many at one place, some nowhere.
CUSTOMER_PLACE = """CASE WHEN c_custkey % 11 = 0 THEN 40e0 + c_custkey * 1e-4 WHEN c_custkey % 3 = 0 THEN 49.05e0 ELSE 49e0 + (c_custkey * 7 % 211) * 1e-3 END AS lat,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 14.1e0 ELSE 14e0 + (c_custkey * 13 % 307) * 1e-3 END AS lon"""


@query("nearest_site_table", f"""
WITH s AS (SELECT {SUPPLIER_SITE} FROM supplier), p AS (SELECT c_custkey, {CUSTOMER_PLACE} FROM customer),
d AS (SELECT c_custkey, s_suppkey, s.lat, s.lon, (s.lat - p.lat) * (s.lat - p.lat) + (s.lon - p.lon) * (s.lon - p.lon) AS d2 FROM p, s WHERE p.lat IS NOT NULL AND p.lon IS NOT NULL)
SELECT c_custkey, round(d2, 9) AS distance2, s_suppkey, lat, lon FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) = 1""")
def nearest_site_table(t: Tables) -> DataFrame:
    """The nearest supplier of every customer that has a place."""
    probes = t.customer.selectExpr("c_custkey", *CUSTOMER_PLACE.split(",\n  "))
    found = nearest.nearest_sites(sites(t), "s_suppkey", "lat", "lon", probes, "c_custkey")
    return found.withColumn("distance2", F.round("distance2", 9))


@query("site_series", f"""
SELECT l_suppkey, l_linenumber, l_shipdate AS "time", max(l_quantity) AS value FROM lineitem
WHERE l_suppkey = (SELECT s_suppkey FROM {_NEAREST} WHERE probe = 0 ORDER BY d2, s_suppkey LIMIT 1) GROUP BY ALL""")
def site_series(t: Tables) -> DataFrame:
    """Shipments of the supplier nearest to a point, one series per line number."""
    stored = t.lineitem.groupBy("l_suppkey", "l_linenumber", F.col("l_shipdate").alias("time")).agg(F.max("l_quantity").alias("value"))
    places = sites(t).withColumnRenamed("s_suppkey", "l_suppkey")
    return views.series_at(stored, places, "l_suppkey", "lat", "lon", PROBES[0], "time", "value", "l_linenumber")


@query("depths_with_values", f"SELECT kind, count(value) AS n FROM {DAYS} GROUP BY kind HAVING count(value) > 0")
def depths_with_values(t: Tables) -> DataFrame:
    return views.depths_with_values(cells(t, "DAY"), "kind", "value")


@query("cluster_points", f"""
SELECT round(round_even(lon / 7.5e-3, 0) * 7.5e-3, 6) AS grid_lon, round(round_even(lat / 7.5e-3, 0) * 7.5e-3, 6) AS grid_lat,
 round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS merged_count, min(s_name) AS label
FROM (SELECT s_name, {SUPPLIER_SITE} FROM supplier)
WHERE lon BETWEEN 14.05e0 - 0.015e0 AND 14.2e0 + 0.015e0 AND lat BETWEEN 49e0 - 0.015e0 AND 49.1e0 + 0.015e0 GROUP BY 1, 2""")
def cluster_points(t: Tables) -> DataFrame:
    view = ((14.05, 14.2), (49.0, 49.1))
    out = views.cluster_points(sites(t, "s_name"), "lon", "lat", "s_name", *view)
    return out.select(*[F.round(c, 6).alias(c) for c in ("grid_lon", "grid_lat", "lon", "lat")], "merged_count", "label")


@query("points_without_view", f"SELECT lon, lat, CAST(1 AS BIGINT) AS merged_count, s_name AS label FROM (SELECT s_name, {SUPPLIER_SITE} FROM supplier)")
def points_without_view(t: Tables) -> DataFrame:
    return views.cluster_points(sites(t, "s_name"), "lon", "lat", "s_name")


@query("latlon_repair", f"SELECT s_suppkey, round(lat, 9) AS lat, round(lon, 9) AS lon FROM (SELECT {SUPPLIER_SITE} FROM supplier)")
def latlon_repair(t: Tables) -> DataFrame:
    """Positions given swapped: the means reveal it."""
    swapped = sites(t).select("s_suppkey", F.col("lon").alias("lat"), F.col("lat").alias("lon"))
    fixed = views.repair_positions(swapped, "lat", "lon")
    return fixed.select("s_suppkey", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("radians_repair", f"SELECT s_suppkey, round(lat, 9) AS lat, round(lon, 9) AS lon FROM (SELECT {SUPPLIER_SITE} FROM supplier)")
def radians_repair(t: Tables) -> DataFrame:
    angles = sites(t).select("s_suppkey", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"))
    fixed = views.repair_positions(angles, "lat", "lon")
    return fixed.select("s_suppkey", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("map_focus", f"""
SELECT round(avg(lat), 9) AS center_lat, round(avg(lon), 9) AS center_lon, round(greatest(max(lat) - min(lat), max(lon) - min(lon)), 9) AS span,
 CASE WHEN span < 1 THEN 9 WHEN span < 5 THEN 7 WHEN span < 15 THEN 5 ELSE 3 END AS zoom
FROM (SELECT {SUPPLIER_SITE} FROM supplier) WHERE abs(lat) <= 90""")
def map_focus(t: Tables) -> DataFrame:
    out = views.map_focus(sites(t), "lat", "lon")
    return out.select(*[F.round(c, 9).alias(c) for c in ("center_lat", "center_lon", "span")], "zoom")


@query("zoom_windows", """
WITH s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), w(view, n) AS (VALUES ('year', 360), ('month', 30), ('day', 4)),
x AS (SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS mid, to_days(n) AS span FROM s, w)
SELECT view, CASE WHEN span >= hi - lo THEN lo WHEN mid + span / 2 > hi THEN hi - span WHEN mid - span / 2 < lo THEN lo ELSE mid - span / 2 END AS start,
 CASE WHEN span >= hi - lo THEN hi WHEN mid + span / 2 > hi THEN hi WHEN mid - span / 2 < lo THEN lo + span ELSE mid + span / 2 END AS "end"
FROM x""")
def zoom_windows(t: Tables) -> DataFrame:
    spans = {"year": timedelta(days=360), "month": timedelta(days=30), "day": timedelta(days=4)}
    return views.zoom_windows(t.events, "ts", datetime(2024, 1, 29, 12), spans)


@query("variable_report", f"""
SELECT 'value' AS variable, 'double' AS dtype, 'time,site' AS dims, count(*) AS size, count({VALID}) AS valid_count, count(*) - count({VALID}) AS missing_count FROM events
UNION ALL SELECT 'event_type', 'string', '', count(*), count(event_type), count(*) - count(event_type) FROM events
UNION ALL SELECT 'event_id', 'bigint', '', count(*), count(event_id), 0 FROM events""")
def variable_report(t: Tables) -> DataFrame:
    frame = t.events.select("event_type", "event_id", F.coalesce(F.expr(VALID), F.lit(float("nan"))).alias("value"))
    return views.variable_report(frame, ["value", "event_type", "event_id"], {"value": ["time", "site"]})


@query("sample_stats", """
WITH h AS (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100)
SELECT 'l_quantity' AS variable, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max FROM h
UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax), max(l_tax) FROM h""")
def sample_stats(t: Tables) -> DataFrame:
    return views.sample_stats(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_tax"])


@query("first_values", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def first_values(t: Tables) -> DataFrame:
    return views.first_values(t.orders, ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


_NODES = "(SELECT '' AS path UNION SELECT r_name FROM region UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def node_paths(t: Tables) -> DataFrame:
    """Regions and nations as a node tree."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("/", "r_name", "n_name").alias("path"), "n_nationkey"
    )


@query("coord_overview", """
WITH leaf AS (SELECT r_name, n_name, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path, 'balance' AS coord, count(DISTINCT value) AS n, min(value) AS low, max(value) AS high FROM (
  SELECT r_name || '/' || n_name AS path, value FROM leaf UNION ALL SELECT r_name, value FROM leaf UNION ALL SELECT '', value FROM leaf) GROUP BY path""")
def coord_overview(t: Tables) -> DataFrame:
    axes = t.customer.join(node_paths(t), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "path", F.lit("balance").alias("coord"), F.col("c_acctbal").alias("value")
    )
    return views.coord_overview(axes)


@query("inherited_config", f"""
SELECT path, coalesce(CASE WHEN path LIKE '%NATION_1%' THEN 'own' END, CASE WHEN path LIKE 'A%' THEN 'region' END, 'root') AS config FROM {_NODES}""")
def inherited_config(t: Tables) -> DataFrame:
    """Some nations and some regions have a config of their own; the rest inherit it or the default."""
    paths = node_paths(t).select("path")
    regions = t.region.select(F.col("r_name").alias("path"))
    root = t.region.agg(F.lit("").alias("path"))
    own = paths.where(F.col("path").contains("NATION_1")).withColumn("config", F.lit("own"))
    inherited = regions.where(F.col("path").startswith("A")).withColumn("config", F.lit("region"))
    nodes = views.union_all([paths, regions, root])
    return lookup.inherited_config(nodes, own.unionByName(inherited), "path", "config", "root")


@query("median_time", """
SELECT "time" FROM (SELECT "time", row_number() OVER (ORDER BY "time") - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts AS "time" FROM events)) WHERE pos = (n - 1) // 2""")
def median_time(t: Tables) -> DataFrame:
    return views.median_value(grid.axis(t.events.select(F.col("ts").alias("time")), ["time"]))


@query("column_extent", "SELECT count(DISTINCT l_partkey) AS n_distinct, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem")
def column_extent(t: Tables) -> DataFrame:
    return views.column_extent(t.lineitem, "l_partkey")


@query("attribute_lookup", """
SELECT l_orderkey, l_linenumber, l_suppkey AS site, s_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def attribute_lookup(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("site"))
    return lookup.attribute_lookup(rows, t.supplier.withColumnRenamed("s_suppkey", "site"), "site", ["s_name", "s_nationkey"])
