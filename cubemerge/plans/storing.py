"""Store queries: updates, alignment, dense reads, catalog and copies through a real store in the scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators.views import coord_overview
from cubemerge.plans.aligning import COARSE_SQL, STORED_UNTIL, UPDATE_FROM, _pivot, coarse_hour, part
from cubemerge.plans.gridding import CELLS, DAYS, VALID
from cubemerge.plans.registry import Tables, query
from cubemerge.schema import NodeSchema
from cubemerge.session import scratch_root
from cubemerge.sources.store import Store, copy_tree, validate_cells

HOURS = {
    "COORDS": {
        "time": {"unit": {"tick": "h", "tz": "UTC"}, "df_col": "ts", "bucket_span": 48},
        "site": {"type": "int64", "df_col": "user_id", "sorted": False},
    },
    "VARS": {"value": {"type": "float64", "coords": ["time", "site"]}},
}
DAILY = {**HOURS, "COORDS": {**HOURS["COORDS"], "time": {"unit": {"tick": "D", "tz": "UTC"}, "df_col": "ts"}}}


def new_store(t: Tables, schema: dict) -> Store:
    return Store.open(t.spark, f"{scratch_root(t.spark)}/store-{uuid.uuid4().hex}", schema)


def readings(t: Tables) -> DataFrame:
    return t.events.select("ts", "user_id", "event_id", F.expr(VALID).alias("value"))


_S, _U = f"\"time\" < TIMESTAMP '{STORED_UNTIL}'", f"\"time\" >= TIMESTAMP '{UPDATE_FROM}'"


@query("store_update", f"""
SELECT "time", site, coalesce(u.value + 1000, s.value) AS value FROM {_pivot(_S)} s FULL JOIN {_pivot(_U)} u USING ("time", site)
WHERE coalesce(u.value, s.value) IS NOT NULL""")
def store_update(t: Tables) -> DataFrame:
    """Two updates whose hours overlap, then all cells."""
    node, ev = new_store(t, HOURS).node(""), readings(t)
    node.update(part(ev, "stored"), "event_id")
    node.update(part(ev, "update").withColumn("value", F.col("value") + 1000), "event_id")
    return node.read_df("value")


_UPDATED = f"(SELECT {COARSE_SQL} AS \"time\", user_id AS site, {VALID} AS value, event_id FROM events WHERE ts >= TIMESTAMP '{UPDATE_FROM}')"


@query("store_align", f"""
WITH s AS (FROM {_pivot(_S)}), u AS (FROM {_pivot('true', _UPDATED)}),
o AS (SELECT DISTINCT "time" FROM {CELLS} WHERE {_S}), n AS (SELECT DISTINCT "time" FROM {_UPDATED}),
tg AS (SELECT "time" FROM o WHERE "time" BETWEEN (SELECT min("time") FROM n) AND (SELECT max("time") FROM n)
  UNION SELECT "time" FROM n WHERE "time" > (SELECT max("time") FROM o)),
br AS (SELECT tg."time", lo."time" AS lo, hi."time" AS hi FROM tg ASOF JOIN n lo ON lo."time" <= tg."time" ASOF JOIN n hi ON hi."time" >= tg."time"),
al AS (SELECT br."time", a.site, CASE WHEN lo = hi THEN a.value ELSE a.value + (b.value - a.value) *
  ((epoch_us(br."time") - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo))) END AS value
  FROM br JOIN u a ON a."time" = lo JOIN u b ON b."time" = hi AND b.site = a.site)
SELECT "time", site, round(coalesce(al.value, s.value), 9) AS value FROM s FULL JOIN al USING ("time", site) WHERE coalesce(al.value, s.value) IS NOT NULL""")
def store_align(t: Tables) -> DataFrame:
    """An update on a coarse axis: inside the stored range it is interpolated to the stored hours."""
    node, ev = new_store(t, HOURS).node(""), readings(t)
    node.update(part(ev, "stored"), "event_id")
    node.update(part(ev, "update").withColumn("ts", coarse_hour()), "event_id")
    return node.read_df("value").withColumn("value", F.round("value", 9))


@query("store_slice", f"""
SELECT "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {CELLS}
WHERE "time" BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-08' GROUP BY ALL HAVING count(value) > 0""")
def store_slice(t: Tables) -> DataFrame:
    """A label slice that opens only the buckets it touches."""
    node = new_store(t, HOURS).node("")
    node.update(readings(t), "event_id")
    return node.read_df("value", time=slice("2024-01-05 06:00:00", "2024-01-08"))


@query("store_dense", f"""
WITH c AS (SELECT "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM {DAYS} GROUP BY ALL)
SELECT d."time", s.site, c.value FROM (SELECT DISTINCT "time" FROM c WHERE "time" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09') d
CROSS JOIN (SELECT DISTINCT site FROM c) s LEFT JOIN c ON c."time" = d."time" AND c.site = s.site""")
def store_dense(t: Tables) -> DataFrame:
    node = new_store(t, DAILY).node("")
    node.update(readings(t), "event_id")
    return node.read_df("value", dense=True, time=slice("2024-01-05", "2024-01-09"))


def tree_store(t: Tables) -> Store:
    """A store with all events in its root and one child node for each of three event types."""
    schema = {**DAILY, "clicks": DAILY, "views": {**DAILY, "deep": DAILY}}
    store, ev = new_store(t, schema), t.events.select("ts", "user_id", "event_id", "event_type", F.expr(VALID).alias("value"))
    frames = {path: ev.where(F.col("event_type") == kind) for path, kind in (("clicks", "click"), ("views", "view"), ("views/deep", "error"))}
    store.update_tree({"": ev, **frames}, "event_id")
    return store


def _count(kind: str | None = None) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT \"time\", site FROM {DAYS} WHERE {'true' if kind is None else f"kind = '{kind}'"} AND value IS NOT NULL))"


@query("store_catalog", f"""
SELECT path, 'value' AS variable, 'time,site' AS dims, NULL::VARCHAR AS unit, cells, CAST(0 AS BIGINT) AS missing
FROM (VALUES ('', {_count()}), ('clicks', {_count('click')}), ('views', {_count('view')}), ('views/deep', {_count('error')})) AS v(path, cells)""")
def store_catalog(t: Tables) -> DataFrame:
    return tree_store(t).variables()


@query("store_overview", f"""
WITH a AS (SELECT CASE kind WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' WHEN 'error' THEN 'views/deep' END AS path, site FROM {DAYS} WHERE kind IN ('click', 'view', 'error')),
up AS (SELECT path, site FROM a UNION ALL SELECT 'views', site FROM a WHERE path = 'views/deep' UNION ALL SELECT '', site FROM {DAYS})
SELECT path, count(DISTINCT site) AS n FROM up GROUP BY path""")
def store_overview(t: Tables) -> DataFrame:
    """Distinct sites of every node over its subtree."""
    return coord_overview(tree_store(t).axes_table()).where("coord = 'site'").select("path", "n")


@query("store_copy", f"""
WITH c AS (SELECT '' AS path, * FROM {DAYS} UNION ALL SELECT CASE kind WHEN 'view' THEN 'views' ELSE 'views/deep' END, * FROM {DAYS} WHERE kind IN ('view', 'error'))
SELECT path, "time", site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM c GROUP BY ALL HAVING count(value) > 0""")
def store_copy(t: Tables) -> DataFrame:
    """A tree copied into another store that lacks one of its nodes: all cells of the copy."""
    source = tree_store(t)
    target = new_store(t, {**DAILY, "views": {**DAILY, "deep": DAILY}})
    copy_tree(source, target)
    parts = [node.read_df("value").withColumn("path", F.lit(path)) for path, node in target.nodes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Stored days, then coarse hours from day 19 on: hours between the last stored days have no target unless a day takes its value from them.
_LOST = f"""
o AS (SELECT DISTINCT date_trunc('day', ts) AS "time" FROM events WHERE ts < TIMESTAMP '{STORED_UNTIL}'),
u AS (SELECT "time", site FROM {_UPDATED} GROUP BY ALL HAVING count(value) > 0), n AS (SELECT DISTINCT "time" FROM {_UPDATED}),
tg AS (SELECT "time" FROM o WHERE "time" BETWEEN (SELECT min("time") FROM n) AND (SELECT max("time") FROM n)
  UNION SELECT "time" FROM n WHERE "time" > (SELECT max("time") FROM o)),
br AS (SELECT lo."time" AS lo, hi."time" AS hi FROM tg ASOF JOIN n lo ON lo."time" <= tg."time" ASOF JOIN n hi ON hi."time" >= tg."time"),
lost AS (SELECT count(*) AS rows FROM u WHERE "time" NOT IN (SELECT lo FROM br) AND "time" NOT IN (SELECT hi FROM br))"""


def lossy_update(t: Tables):
    """(store, result) of days of readings and an update on coarse hours."""
    store = new_store(t, HOURS)
    node, ev = store.node(""), readings(t)
    node.update(part(ev, "stored").withColumn("ts", F.date_trunc("DAY", "ts").cast("timestamp_ntz")), "event_id")
    return store, node.update(part(ev, "update").withColumn("ts", coarse_hour()), "event_id")


@query("store_lost", f"WITH {_LOST.strip()} SELECT 'value' AS variable, 'no_target' AS problem, rows FROM lost WHERE rows > 0")
def store_lost(t: Tables) -> DataFrame:
    """Report of an update some of whose values reach no stored coordinate."""
    return lossy_update(t)[1].problems.where("rows > 0")


@query("store_events", f"WITH {_LOST.strip()} SELECT '' AS node, 'ERROR' AS level, 'value no_target ' || rows AS message, CAST(1 AS BIGINT) AS n FROM lost WHERE rows > 0")
def store_events(t: Tables) -> DataFrame:
    """The event log after that update."""
    return lossy_update(t)[0].events().groupBy("node", "level", "message").agg(F.count(F.lit(1)).alias("n"))


ACCOUNTS = {
    "COORDS": {"customer": {"type": "int64", "df_col": "c_custkey", "sorted": False}},
    "VARS": {"balance": {"type": "float64", "df_col": "c_acctbal", "coords": ["customer"]}},
}


@query("store_growth", """
SELECT c_custkey AS customer, c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 5 ELSE 0 END AS balance FROM customer""")
def store_growth(t: Tables) -> DataFrame:
    """A cube without a sorted coordinate that grows tenfold, then has a few cells changed; its buckets are split as they outgrow 8 kB."""
    store = Store.open(t.spark, f"{scratch_root(t.spark)}/store-{uuid.uuid4().hex}", ACCOUNTS, bucket_bytes=8 << 10)
    node, rows = store.node(""), t.customer.select("c_custkey", "c_acctbal")
    node.update(rows.where("c_custkey % 10 = 1"), "c_custkey")
    node.update(rows.where("c_custkey % 10 <> 1"), "c_custkey")
    node.update(rows.where("c_custkey % 50 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 5), "c_custkey")
    return node.read_df("balance")


NAMED = {
    "COORDS": {"part": {"type": "int64", "df_col": "p_partkey", "sorted": False}},
    "VARS": {"name": {"df_col": "label", "range": {"discrete": "part names"}, "coords": ["part"]}},
}


@query("dictionary_codes", """
WITH p AS (SELECT p_partkey, p_name || ' ' || p_partkey % 7 AS label FROM part),
a AS (SELECT label, dense_rank() OVER (ORDER BY label) AS code FROM (SELECT DISTINCT label FROM p WHERE p_partkey % 2 = 0)),
b AS (SELECT label, (SELECT count(*) FROM a) + dense_rank() OVER (ORDER BY label) AS code FROM (SELECT DISTINCT label FROM p WHERE label NOT IN (SELECT label FROM a)))
SELECT p_partkey AS part, code, label AS name FROM p JOIN (FROM a UNION ALL FROM b) USING (label)""")
def dictionary_codes(t: Tables) -> DataFrame:
    """Part names as codes of a stored label table: those of even parts first, the others appended."""
    node = new_store(t, NAMED).node("")
    parts = t.part.select("p_partkey", F.concat_ws(" ", "p_name", (F.col("p_partkey") % 7).cast("string")).alias("label"))
    for rest in (0, 1):
        node.add_labels("name", parts.where(F.col("p_partkey") % 2 == rest), "label")
    node.update(parts, "p_partkey")
    coded = node.read_df("name")
    return node.decode(coded.withColumn("code", F.col("name"))).select("part", "code", "name")


@query("validated_cells", "SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 3")
def validated_cells(t: Tables) -> DataFrame:
    """Cells checked against a schema: rows without a key go, a column the schema lacks is not stored."""
    schema = NodeSchema.from_dict({
        "COORDS": {"l_shipdate": {"unit": {"tick": "D"}}, "l_orderkey": {"type": "int64", "sorted": False}, "l_linenumber": {"type": "int32", "sorted": False}},
        "VARS": {"l_quantity": {"type": "float64", "coords": ["l_shipdate", "l_orderkey", "l_linenumber"]}},
    })
    cells = t.lineitem.select("l_shipdate", "l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("l_linenumber"), "l_quantity", "l_tax")
    return validate_cells(cells, schema, ("l_shipdate", "l_orderkey", "l_linenumber"))
