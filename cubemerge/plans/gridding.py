"""Grid queries: pivot, axes, elimination, duplicates, dense input and output, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators import grid, merge, select, views
from cubemerge.operators import harmonize as hz
from cubemerge.operators.blocks import with_position
from cubemerge.plans.harmonizing import READINGS, SUPPLIER_SITE, sites
from cubemerge.plans.registry import Tables, query

# Readings below 5 count as missing, so cells with gaps come from the data itself.
VALID = "CASE WHEN value >= 5 THEN value END"


def cells(t: Tables, time: str = "HOUR", events: DataFrame | None = None) -> DataFrame:
    """Events as rows (time, site, kind, value, event_id) with missing values."""
    return (t.events if events is None else events).select(
        F.date_trunc(time, "ts").cast("timestamp_ntz").alias("time"), F.col("user_id").alias("site"),
        F.col("event_type").alias("kind"), F.expr(VALID).alias("value"), "event_id",
    )


CELLS = f"""(SELECT date_trunc('hour', ts) AS "time", user_id AS site, event_type AS kind, {VALID} AS value, event_id FROM events)"""
DAYS = CELLS.replace("'hour'", "'day'")


@query("harmonize_pivot", f"""
SELECT date_trunc('hour', ts - INTERVAL 1 HOUR) AS "time", user_id AS site,
       round(arg_max(value + 273.15e0, event_id) FILTER (WHERE value + 273.15e0 BETWEEN 273.15e0 AND 573.15e0), 6) AS temperature
FROM events GROUP BY ALL HAVING temperature IS NOT NULL""")
def harmonize_pivot(t: Tables) -> DataFrame:
    rows = hz.harmonize(t.events, READINGS, "event_id").cells
    out, _ = grid.cube_cells(rows, READINGS, ("time", "site"), hz.SEQ)
    return out.withColumn("temperature", F.round("temperature", 6))


@query("pivot_last_valid", f"""
SELECT "time", site, kind, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {CELLS} GROUP BY ALL""")
def pivot_last_valid(t: Tables) -> DataFrame:
    return grid.pivot_cells(cells(t), ["time", "site", "kind"], ["value"], "event_id")


@query("axis_positions", """
SELECT "time", row_number() OVER (ORDER BY "time") - 1 AS pos FROM (SELECT DISTINCT date_trunc('hour', ts) AS "time" FROM events)""")
def axis_positions(t: Tables) -> DataFrame:
    return grid.axis(cells(t), ["time"])


@query("composed_axis", """
SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS pos
FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)""")
def composed_axis(t: Tables) -> DataFrame:
    return grid.axis(t.customer, ["c_nationkey", "c_mktsegment"])


@query("eliminate_dims", """
SELECT l_suppkey AS site, max(s_nationkey) AS nation, max(s_acctbal) AS balance
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey""")
def eliminate_dims(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("site"), "l_partkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    values, _ = grid.eliminate_dims(rows, ["site"], ["nation", "balance"])
    return values


@query("dim_conflicts", """
SELECT o_custkey, 'status' AS variable, min(o_orderstatus) AS low, max(o_orderstatus) AS high
FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus)""")
def dim_conflicts(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderstatus").alias("status"))
    _, conflicts = grid.eliminate_dims(rows, ["o_custkey"], ["status"])
    return conflicts


@query("duplicate_coords", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_coords(t: Tables) -> DataFrame:
    return grid.duplicates(t.lineitem, ["l_orderkey"])


@query("duplicate_rows", """
SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS pos FROM lineitem
WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)""")
def duplicate_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_suppkey", F.expr("l_orderkey * 10 + l_linenumber").alias("pos"))
    return grid.duplicate_rows(rows, ["l_partkey", "l_suppkey"], "pos")


@query("isel_first", f"""
SELECT "time", site, kind, value FROM {CELLS} WHERE "time" = (SELECT min("time") FROM {CELLS})""")
def isel_first(t: Tables) -> DataFrame:
    rows = cells(t)
    return select.isel(rows.select("time", "site", "kind", "value"), grid.axis(rows, ["time"]), ["time"], 0)


@query("isel_slice", f"""
WITH ax AS (SELECT "time", row_number() OVER (ORDER BY "time") - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT "time" FROM {DAYS}))
SELECT "time", site, kind, value FROM {DAYS} WHERE "time" IN (SELECT "time" FROM ax WHERE pos >= n - 3)""")
def isel_slice(t: Tables) -> DataFrame:
    rows = cells(t, "DAY")
    return select.isel(rows.select("time", "site", "kind", "value"), grid.axis(rows, ["time"]), ["time"], slice(-3, None))


@query("dense_read", f"""
WITH c AS (SELECT "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {DAYS} GROUP BY ALL)
SELECT d."time", s.site, c.value FROM (SELECT DISTINCT "time" FROM c) d CROSS JOIN (SELECT DISTINCT site FROM c) s
LEFT JOIN c ON c."time" = d."time" AND c.site = s.site""")
def dense_read(t: Tables) -> DataFrame:
    rows = cells(t, "DAY")
    stored = grid.pivot_cells(rows, ["time", "site"], ["value"], "event_id")
    axes = [grid.axis(rows, ["time"]), grid.axis(rows, ["site"])]
    return grid.reindex(stored, axes, ["time", "site"]).select("time", "site", "value")


@query("grid_points", f"""
SELECT 14e0 + i * 1e-2 AS lon, 49e0 + j * 2e-2 AS lat, TRUE AS grid
FROM generate_series(0, (SELECT CAST(max(s_suppkey) AS BIGINT) FROM supplier)) a(i), generate_series(0, (SELECT CAST(max(n_nationkey) AS BIGINT) FROM nation)) b(j)
UNION ALL SELECT lon, lat, FALSE FROM (SELECT {SUPPLIER_SITE} FROM supplier)""")
def grid_points(t: Tables) -> DataFrame:
    """A grid with one column per supplier and one row per nation, plus the supplier sites."""
    width, height = t.supplier.agg(F.max("s_suppkey")).first()[0], t.nation.agg(F.max("n_nationkey")).first()[0]
    lon = (14.0, 14.0 + (width + 0.5) * 0.01, 0.01)
    lat = (49.0, 49.0 + (height + 0.5) * 0.02, 0.02)
    points = grid.grid_points(t.spark, lon, lat)
    return views.flag_union(points, sites(t).select("lon", "lat"))


@query("dense_input", """
SELECT vec_id, (i - 1) * 10 AS channel, e AS value
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def dense_input(t: Tables) -> DataFrame:
    """Embedding arrays as a dense variable over (vec_id, channel)."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("value"))
    width = vectors.agg(F.max(F.size("value"))).first()[0]
    long = grid.dense_cells(vectors, ["channel"], "value", {"channel": width}, ["channel"])
    channels = t.spark.range(width).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("channel"))
    return grid.attach_axes(long, {"channel": channels}).select("vec_id", "channel", "value")


@query("corner_sample", f"""
WITH c AS (SELECT "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {DAYS} GROUP BY ALL),
 d AS (SELECT DISTINCT "time" FROM c ORDER BY 1 LIMIT 5), s AS (SELECT DISTINCT site FROM c ORDER BY 1 LIMIT 5)
SELECT * FROM c WHERE "time" IN (FROM d) AND site IN (FROM s)""")
def corner_sample(t: Tables) -> DataFrame:
    rows = cells(t, "DAY")
    stored = grid.pivot_cells(rows, ["time", "site"], ["value"], "event_id")
    axes = {"time": grid.axis(rows, ["time"]), "site": grid.axis(rows, ["site"])}
    return select.corner(stored, axes, {"time": 5, "site": 5})


@query("concat_frames", """
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer""")
def concat_frames(t: Tables) -> DataFrame:
    return views.union_all([
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        t.customer.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
    ])


@query("keep_last_daily", """
SELECT * EXCLUDE rn, day < (SELECT max(CAST(ts AS DATE)) FROM events) AS complete FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC) AS rn FROM events)
WHERE rn = 1""")
def keep_last_daily(t: Tables) -> DataFrame:
    dated = merge.split_complete_days(t.events.select("user_id", "ts", "event_type", "value"), "ts")
    return merge.keep_last(dated, ["user_id", "day"], "ts")


@query("sort_by_time", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events""")
def sort_by_time(t: Tables) -> DataFrame:
    return with_position(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "pos")
