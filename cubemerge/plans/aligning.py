"""Alignment and merge queries: split, extension, grids with limited steps, interpolation, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubemerge.functions.datetimes import to_epoch_ticks
from cubemerge.operators import align, grid, merge
from cubemerge.operators.blocks import neighbours, with_position
from cubemerge.plans.gridding import CELLS, DAYS, VALID, cells
from cubemerge.plans.registry import Tables, query
from cubemerge.schema import NodeSchema

# Stored part: the first 20 days; update: from day 19 on. Together the whole table, two days in both.
STORED_UNTIL = "2024-01-21"
UPDATE_FROM = "2024-01-19"
STORED_SQL = f"ts < TIMESTAMP '{STORED_UNTIL}'"
UPDATE_SQL = f"ts >= TIMESTAMP '{UPDATE_FROM}'"


def part(frame: DataFrame, which: str, column: str = "ts") -> DataFrame:
    """One part of the events; the cut is on the raw time, so it reaches the scan."""
    if which == "stored":
        return frame.where(F.col(column) < F.lit(STORED_UNTIL).cast("timestamp_ntz"))
    return frame.where(F.col(column) >= F.lit(UPDATE_FROM).cast("timestamp_ntz"))


def part_cells(t: Tables, tick: str, which: str) -> DataFrame:
    return cells(t, tick, part(t.events, which))


@query("overlap_extension", f"""
WITH s AS (SELECT DISTINCT "time", site FROM {DAYS} WHERE "time" < TIMESTAMP '{STORED_UNTIL}'),
     u AS (SELECT DISTINCT "time", site FROM {DAYS} WHERE "time" >= TIMESTAMP '{UPDATE_FROM}')
SELECT "time", site, (("time", site) IN (SELECT ("time", site) FROM s)) AS in_stored FROM u""")
def overlap_extension(t: Tables) -> DataFrame:
    keys = ["time", "site"]
    stored, update = (grid.axis_values(part_cells(t, "DAY", w), keys) for w in ("stored", "update"))
    both = align.overlap(update, stored, keys).withColumn("in_stored", F.lit(True))
    return both.unionByName(align.extension(update, stored, keys).withColumn("in_stored", F.lit(False)))


@query("axis_union", f"""
SELECT DISTINCT "time", site FROM {DAYS}""")
def axis_union(t: Tables) -> DataFrame:
    return align.axis_union(part_cells(t, "DAY", "stored"), part_cells(t, "DAY", "update"), ["time", "site"])


@query("split_sorted", f"""
WITH u AS (SELECT DISTINCT "time" FROM {CELLS} WHERE "time" >= TIMESTAMP '{UPDATE_FROM}')
SELECT "time", "time" > (SELECT max("time") FROM {CELLS} WHERE "time" < TIMESTAMP '{STORED_UNTIL}') AS is_extension FROM u""")
def split_sorted(t: Tables) -> DataFrame:
    update = grid.axis_values(part_cells(t, "HOUR", "update"), ["time"])
    return align.split_sorted(update, part_cells(t, "HOUR", "stored"), "time")


# A quarter of the sites have another number in the update.
_NEW_SITE = "CASE WHEN user_id % 4 = 0 THEN user_id + 1000000 ELSE user_id END"


@query("unsorted_order", f"""
WITH s AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS stored_pos FROM (SELECT DISTINCT user_id AS site FROM events WHERE {STORED_SQL})),
 u AS (SELECT {_NEW_SITE} AS site, min(event_id) AS arrival FROM events WHERE {UPDATE_SQL} GROUP BY 1)
SELECT u.site, arrival, stored_pos, row_number() OVER (ORDER BY stored_pos IS NULL, stored_pos, arrival) - 1 AS pos
FROM u LEFT JOIN s USING (site)""")
def unsorted_order(t: Tables) -> DataFrame:
    """The update's sites: stored ones in stored order, then new ones in arrival order."""
    ev = t.events.select("ts", F.col("user_id").alias("site"), "event_id")
    stored = grid.axis(part(ev, "stored"), ["site"])
    update = part(ev, "update").withColumn("site", F.expr(_NEW_SITE.replace("user_id", "site"))).groupBy("site").agg(F.min("event_id").alias("arrival"))
    return align.unsorted_order(update, stored, ["site"], "arrival")


@query("axis_append", f"""
WITH s AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS pos FROM (SELECT DISTINCT user_id AS site FROM events WHERE {STORED_SQL})),
 n AS (SELECT DISTINCT {_NEW_SITE} AS site FROM events WHERE {UPDATE_SQL} AND {_NEW_SITE} NOT IN (SELECT site FROM s))
SELECT site, pos FROM s UNION ALL SELECT site, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY site) - 1 FROM n""")
def axis_append(t: Tables) -> DataFrame:
    """Stored positions stay, new sites follow."""
    ev = t.events.select("ts", F.col("user_id").alias("site"))
    stored = grid.axis(part(ev, "stored"), ["site"])
    update = part(ev, "update").withColumn("site", F.expr(_NEW_SITE.replace("user_id", "site")))
    new = align.extension(grid.axis_values(update, ["site"]), stored, ["site"])
    return align.append_axis(stored, new, ["site"], ["site"])


@query("unsorted_pairs", """
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderdate AS value FROM orders)
SELECT a.pos, b.pos AS next_pos, a.value, b.value AS next_value FROM o a JOIN o b ON b.pos = a.pos + 1 WHERE a.value > b.value""")
def unsorted_pairs(t: Tables) -> DataFrame:
    axis = with_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"])
    return align.unsorted_pairs(axis, "o_orderdate")


@query("first_unsorted", """
WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderdate AS value FROM orders)
SELECT a.pos, b.pos AS next_pos, a.value, b.value AS next_value FROM o a JOIN o b ON b.pos = a.pos + 1 WHERE a.value > b.value
ORDER BY a.pos LIMIT 1""")
def first_unsorted(t: Tables) -> DataFrame:
    axis = with_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"])
    return align.first_unsorted(axis, "o_orderdate")


@query("not_increasing", """
WITH e AS (SELECT event_id AS pos, date_trunc('hour', ts) AS value FROM events)
SELECT a.pos, b.pos AS next_pos, a.value, b.value AS next_value FROM e a JOIN e b ON b.pos = a.pos + 1 WHERE a.value >= b.value""")
def not_increasing(t: Tables) -> DataFrame:
    axis = t.events.select(F.col("event_id").alias("pos"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("value"))
    return align.unsorted_pairs(axis, "value", strict=True)


_GRID_TAIL = """
gaps AS (SELECT *, lag(x) OVER (PARTITION BY site ORDER BY x) AS p FROM kept),
filled AS (SELECT site, x, p, CAST(ceil((x - p) / {high}e0) AS BIGINT) AS n FROM gaps)
SELECT site, x FROM kept
UNION ALL SELECT site, p + k * ((x - p) // n) AS x FROM (SELECT *, unnest(range(1, n)) AS k FROM filled WHERE x - p > {high})"""


@query("adjust_grid", """
WITH RECURSIVE pts AS (SELECT DISTINCT user_id AS site, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS x FROM events),
nxt AS (SELECT a.site, a.x, min(b.x) AS nx FROM pts a JOIN pts b ON a.site = b.site AND b.x >= a.x + 3 GROUP BY 1, 2),
kept AS (SELECT site, min(x) AS x FROM pts GROUP BY 1 UNION ALL SELECT n.site, n.nx FROM kept k JOIN nxt n ON n.site = k.site AND n.x = k.x),
""" + _GRID_TAIL.format(high=8))
def adjust_grid(t: Tables) -> DataFrame:
    """Event hours per site, steps limited to 3..8 hours."""
    hours = t.events.select(F.col("user_id").alias("site"), to_epoch_ticks(F.col("ts"), "h").alias("x"))
    return align.adjust_grid(hours, "x", 3, 8, ["site"])


@query("adjust_grid_joins", """
WITH RECURSIVE pts AS (SELECT DISTINCT event_type AS site, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS x FROM events),
nxt AS (SELECT a.site, a.x, min(b.x) AS nx FROM pts a JOIN pts b ON a.site = b.site AND b.x >= a.x + 2 GROUP BY 1, 2),
kept AS (SELECT site, min(x) AS x FROM pts GROUP BY 1 UNION ALL SELECT n.site, n.nx FROM kept k JOIN nxt n ON n.site = k.site AND n.x = k.x),
""" + _GRID_TAIL.format(high=5))
def adjust_grid_joins(t: Tables) -> DataFrame:
    """The same rule with every group treated as too large for one task."""
    hours = t.events.select(F.col("event_type").alias("site"), to_epoch_ticks(F.col("ts"), "h").alias("x"))
    return align.adjust_grid(hours, "x", 2, 5, ["site"])


LIMITED = NodeSchema.from_dict({
    "COORDS": {"time": {"unit": {"tick": "h"}, "step_limits": [2, 12, "h"]}},
    "VARS": {"value": {"type": "float64", "coords": ["time"]}},
}).coords["time"]

# Every event on a coarse axis: 01, 06, 11, 16 and 21 o'clock.
COARSE_SQL = "(date_trunc('hour', ts) - to_hours(hour(ts) % 5) + INTERVAL 1 HOUR)"
_COARSE = f"""(SELECT DISTINCT {COARSE_SQL} AS "time" FROM events)"""


def coarse_hour(column: str = "ts") -> Column:
    hour = F.date_trunc("HOUR", column).cast("timestamp_ntz")
    return hour + F.make_dt_interval(hours=F.lit(1) - F.hour(column) % 5)


@query("extension_limits", f"""
WITH RECURSIVE o AS (SELECT DISTINCT date_trunc('hour', ts) AS "time" FROM events WHERE {STORED_SQL}),
n AS (SELECT DISTINCT {COARSE_SQL} AS "time" FROM events WHERE {UPDATE_SQL}),
pts AS (SELECT 0 AS site, CAST(floor(epoch_us("time") / 3600000000) AS BIGINT) AS x FROM (SELECT max("time") AS "time" FROM o UNION SELECT "time" FROM n WHERE "time" > (SELECT max("time") FROM o))),
nxt AS (SELECT a.site, a.x, min(b.x) AS nx FROM pts a JOIN pts b ON b.x >= a.x + 2 GROUP BY 1, 2),
kept AS (SELECT site, min(x) AS x FROM pts GROUP BY 1 UNION ALL SELECT n.site, n.nx FROM kept k JOIN nxt n ON n.x = k.x),
grid AS (WITH {_GRID_TAIL.format(high=12).strip()})
SELECT "time", 'overlap' AS part FROM o WHERE "time" BETWEEN (SELECT min("time") FROM n) AND (SELECT max("time") FROM n)
UNION ALL SELECT make_timestamp(x * 3600000000), 'extension' FROM grid WHERE x > (SELECT min(x) FROM pts)""")
def extension_limits(t: Tables) -> DataFrame:
    """Coarse hours update the stored hours; the extension keeps steps of 2..12 hours."""
    stored = grid.axis_values(part(t.events, "stored").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time")), ["time"])
    update = grid.axis_values(part(t.events, "update").select(coarse_hour().alias("time")), ["time"])
    found = align.sorted_targets(update, stored, LIMITED)
    return found.overlap.withColumn("part", F.lit("overlap")).unionByName(found.extension.withColumn("part", F.lit("extension")))


_PEAKS = """(SELECT date_trunc('hour', ts) AS "time", event_type AS kind, max(value) AS value FROM events GROUP BY ALL)"""
_BRACKET = f"""
WITH c AS (FROM {_PEAKS}), src AS (SELECT DISTINCT "time" FROM c),
tg AS (SELECT unnest(generate_series((SELECT min("time") FROM src), (SELECT max("time") FROM src), INTERVAL 45 MINUTE)) AS "time"),
br AS (SELECT tg."time", lo."time" AS lo, hi."time" AS hi FROM tg ASOF JOIN src lo ON lo."time" <= tg."time"
       ASOF JOIN src hi ON hi."time" >= tg."time"),
w AS (SELECT *, CASE WHEN lo = hi THEN 0e0 ELSE (epoch_us("time") - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)) END AS w FROM br)"""


def hourly_peaks(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"), F.col("event_type").alias("kind")).agg(
        F.max("value").alias("value")
    )


def every_45_minutes(t: Tables) -> DataFrame:
    """Targets over the range of the event hours."""
    low, high = t.events.select(to_epoch_ticks(F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "us").alias("x")).agg(F.min("x"), F.max("x")).first()
    step = 45 * 60_000_000
    steps = t.spark.range((high - low) // step + 1)
    return steps.select(F.timestamp_micros(F.lit(low) + F.col("id") * F.lit(step)).cast("timestamp_ntz").alias("time"))


@query("bracket_axis", _BRACKET + """ SELECT "time" AS target, lo, hi, round(w, 9) AS w FROM w""")
def bracket_axis(t: Tables) -> DataFrame:
    source = grid.axis_values(cells(t), ["time"])
    return align.bracket(every_45_minutes(t), source, "time").withColumn("w", F.round("w", 9))


@query("interp_linear", _BRACKET + """
SELECT w."time", a.kind, round(CASE WHEN w = 0 THEN a.value ELSE a.value + (b.value - a.value) * w END, 9) AS value
FROM w JOIN c a ON a."time" = lo JOIN c b ON b."time" = hi AND b.kind = a.kind""")
def interp_linear(t: Tables) -> DataFrame:
    peaks = hourly_peaks(t)
    pairs = align.bracket(every_45_minutes(t), grid.axis_values(cells(t), ["time"]), "time")
    return align.interpolate(peaks, pairs, "time", ["kind"], ["value"]).withColumn("value", F.round("value", 9))


@query("interp_nearest", _BRACKET + """
SELECT w."time", a.kind, a.value AS value FROM w JOIN c a ON a."time" = CASE WHEN w <= 0.5 THEN lo ELSE hi END""")
def interp_nearest(t: Tables) -> DataFrame:
    peaks = hourly_peaks(t)
    pairs = align.bracket(every_45_minutes(t), grid.axis_values(cells(t), ["time"]), "time")
    return align.interpolate(peaks, pairs, "time", ["kind"], ["value"], nearest=True)


@query("interp_per_site", """
WITH c AS (SELECT user_id AS site, date_trunc('day', ts) AS "time", max(value) AS value FROM events GROUP BY ALL),
tg AS (SELECT site, unnest(generate_series(min("time"), max("time"), INTERVAL 12 HOUR)) AS "time" FROM c GROUP BY site),
br AS (SELECT tg.site, tg."time", lo."time" AS lo, lo.value AS v0, hi."time" AS hi, hi.value AS v1
  FROM tg ASOF JOIN c lo ON lo.site = tg.site AND lo."time" <= tg."time" ASOF JOIN c hi ON hi.site = tg.site AND hi."time" >= tg."time")
SELECT site, "time", round(CASE WHEN lo = hi THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us("time") - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo))) END, 9) AS value
FROM br""")
def interp_per_site(t: Tables) -> DataFrame:
    """Each site's own axis: daily peaks interpolated to half days within the site's range."""
    peaks = t.events.groupBy(F.col("user_id").alias("site"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("time")).agg(F.max("value").alias("value"))
    span = peaks.groupBy("site").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    targets = span.select("site", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 12 HOUR"))).alias("time"))
    pairs = align.bracket(targets, peaks.select("site", "time"), "time", ["site"])
    out = align.interpolate(peaks, pairs, "time", ["site"], ["value"], keys=["site"])
    return out.select("site", "time", F.round("value", 9).alias("value"))


@query("nearest_time", f"""
WITH src AS (SELECT "time" FROM {_COARSE})
SELECT o."time", arg_min(src."time", (abs(epoch_us(o."time") - epoch_us(src."time")), src."time")) AS nearest
FROM (SELECT DISTINCT date_trunc('hour', ts) AS "time" FROM events) o, src GROUP BY 1""")
def nearest_time(t: Tables) -> DataFrame:
    """For every event hour the nearest coarse hour."""
    hours = t.events.select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"))
    return align.nearest_join(hours, grid.axis_values(t.events.select(coarse_hour().alias("time")), ["time"]), "time")


@query("nearest_to_one", """
SELECT date_trunc('hour', ts) AS "time" FROM events ORDER BY abs(epoch_us(date_trunc('hour', ts)) - epoch_us(TIMESTAMP '2024-01-15 12:25:00')), 1 LIMIT 1""")
def nearest_to_one(t: Tables) -> DataFrame:
    return align.nearest_value(cells(t), "time", "2024-01-15 12:25:00")


@query("previous_value", f"""
SELECT event_id, user_id, last_value({VALID} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
       first_value({VALID} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM events""")
def previous_value(t: Tables) -> DataFrame:
    """Valid neighbour on both sides per user; the primitive behind brackets and grids."""
    ev = t.events.select("event_id", "user_id", "value")
    return neighbours(ev, ["user_id"], ["event_id"], F.expr(VALID), "before", "after").drop("value")


# --- merge ---------------------------------------------------------------------------------------------


def _pivot(where: str, source: str = CELLS) -> str:
    return f"""(SELECT "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {source} WHERE {where} GROUP BY ALL)"""


_S, _U = (f"\"time\" < TIMESTAMP '{STORED_UNTIL}'", f"\"time\" >= TIMESTAMP '{UPDATE_FROM}'")


def _halves(t: Tables, tick: str) -> tuple[DataFrame, DataFrame]:
    keys, stored = ["time", "site"], part_cells(t, tick, "stored")
    # the update's readings are raised by 1000 so that the two sides differ where they overlap
    update = part_cells(t, tick, "update").withColumn("value", F.col("value") + 1000)
    return grid.pivot_cells(stored, keys, ["value"], "event_id"), grid.pivot_cells(update, keys, ["value"], "event_id")


@query("merge_coalesce", f"""
SELECT "time", site, coalesce(u.value + 1000, s.value) AS value FROM {_pivot(_S)} s FULL JOIN {_pivot(_U)} u USING ("time", site)""")
def merge_coalesce(t: Tables) -> DataFrame:
    stored, update = _halves(t, "HOUR")
    return merge.merge_coalesce(stored, update, ["time", "site"], ["value"])


@query("merge_rows", f"""
SELECT "time", site, coalesce(u.value, s.value) AS value FROM {_pivot(_S)} s FULL JOIN {_pivot(_U)} u USING ("time", site)
WHERE coalesce(u.value, s.value) IS NOT NULL""")
def merge_rows(t: Tables) -> DataFrame:
    """Pivot and merge in one shuffle."""
    stored = grid.pivot_cells(part_cells(t, "HOUR", "stored"), ["time", "site"], ["value"], "event_id")
    return merge.merge_rows(stored, part_cells(t, "HOUR", "update"), ["time", "site"], ["value"], "event_id")


@query("merge_overwrite", f"""
WITH s AS (FROM {_pivot(_S, DAYS)}), u AS (FROM {_pivot(_U, DAYS)}),
 d AS (SELECT DISTINCT "time" FROM s WHERE "time" BETWEEN (SELECT min("time") FROM u) AND (SELECT max("time") FROM u)),
 e AS (SELECT DISTINCT site FROM s WHERE site IN (SELECT site FROM u))
SELECT * FROM s WHERE NOT ("time" IN (FROM d) AND site IN (FROM e))
UNION ALL SELECT "time", site, value + 1000 FROM u WHERE value IS NOT NULL""")
def merge_overwrite(t: Tables) -> DataFrame:
    stored, update = _halves(t, "DAY")
    low, high = update.agg(F.min("time"), F.max("time")).first()
    days = grid.axis_values(stored, ["time"]).where(F.col("time").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    same = align.overlap(grid.axis_values(update, ["site"]), stored, ["site"])
    return merge.merge_overwrite(stored, update, ["time", "site"], ["value"], [(["time"], days), (["site"], same)])
