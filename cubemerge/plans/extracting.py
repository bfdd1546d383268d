"""Extraction queries: JSON paths, payloads, message checks, request contexts. Documents are built per row
from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators.lookup import with_sidecar
from cubemerge.plans.registry import Tables, query
from cubemerge.sources import extract
from cubemerge.sources.files import newest_per_key as newest
from cubemerge.streaming import contexts, messages


def event_documents(t: Tables) -> DataFrame:
    """One nested document per event: a list with two objects, keyed by event type and by "total"."""
    reading = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("value").alias("v"))
    first = F.create_map(F.col("event_type"), reading, F.lit("total"), reading)
    second = F.create_map(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string"), F.lit("_x")), reading)
    doc = F.struct(F.array(first, second).alias("the-key"), F.col("user_id").alias("user"), F.from_json("props", "k int").alias("props"))
    return t.events.select("event_id", F.to_json(doc).alias("doc"))


@query("json_paths", """
SELECT event_id, '0' AS idx, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "time", value, user_id AS "user" FROM events
UNION ALL SELECT event_id, '0', 'total', strftime(ts, '%Y-%m-%d %H:%M:%S'), value, user_id FROM events
UNION ALL SELECT event_id, '1', 'run' || (user_id % 3) || '_x', strftime(ts, '%Y-%m-%d %H:%M:%S'), value, user_id FROM events""")
def json_paths(t: Tables) -> DataFrame:
    columns = {
        "idx": "{idx}", "kind": "{kind}", "time": "/the-key/{idx}/{kind}/t",
        "value": ("/the-key/{idx}/{kind}/v", "double"), "user": ("/user", "bigint"),
    }
    return extract.json_extract(event_documents(t), "doc", "/the-key/{idx}/{kind}", columns, ["event_id"])


@query("json_path_parts", """
SELECT event_id, CAST(user_id % 3 AS VARCHAR) AS run, 'x' AS tag, value, CAST(NULL AS VARCHAR) AS absent,
       try_cast(substring(props, 7, length(props) - 7) AS BIGINT) AS k FROM events""")
def json_path_parts(t: Tables) -> DataFrame:
    columns = {
        "run": "{run}", "tag": "{tag}", "value": ("/the-key/1/run{run}_{tag}/v", "double"),
        "absent": "/the-key/0/{tag}/v", "k": ("/props/k", "bigint"),
    }
    return extract.json_extract(event_documents(t), "doc", "/the-key/1/run{run}_{tag}", columns, ["event_id"])


@query("wildcard_paths", "SELECT event_id, value FROM events, range(3)")
def wildcard_paths(t: Tables) -> DataFrame:
    return extract.wildcard_extract(event_documents(t), "doc", "the-key.*.*.v", "value", ["event_id"], "double")


@query("forecast_rows", """
SELECT o_orderkey, 14e0 + (o_custkey % 30) * 1e-2 AS longitude, 49e0 AS latitude, o_orderstatus = 'O' AS grid_domain,
       strftime(o_orderdate + to_hours(h), '%Y-%m-%dT%H:%M:%SZ') AS date_time, o_totalprice + h AS air,
       CASE WHEN h = 0 THEN o_totalprice * 2 ELSE 1e0 END AS rain
FROM orders, (VALUES (0), (1)) AS x(h)""")
def forecast_rows(t: Tables) -> DataFrame:
    """Per order a forecast of two times; the next-hour block replaces the rain of the first."""
    details = lambda **kw: F.struct(F.struct(*[c.alias(n) for n, c in kw.items()]).alias("details"))
    price = F.col("o_totalprice")
    entry = lambda h, data: F.struct(
        F.date_format(F.col("o_orderdate") + F.expr(f"INTERVAL {h} HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), data.alias("data")
    )
    one = F.lit(1.0)
    first = F.struct(details(air=price, rain=one).alias("instant"), details(rain=price * 2).alias("next_1_hours"))
    second = F.struct(details(air=price + 1, rain=one).alias("instant"), F.lit(None).cast("struct<details:struct<rain:double>>").alias("next_1_hours"))
    doc = F.struct(F.struct(F.array(entry(0, first), entry(1, second)).alias("timeseries")).alias("properties"))
    documents = t.orders.select(
        "o_orderkey", F.to_json(doc).alias("doc"), F.lit("49.0").alias("lat"),
        F.expr("14e0 + (o_custkey % 30) * 1e-2").cast("string").alias("lon"), (F.col("o_orderstatus") == "O").alias("grid"),
    )
    return extract.forecast_rows(documents, "doc", ["air", "rain"], "lat", "lon", "grid", ["o_orderkey"])


def sensor_documents(t: Tables) -> DataFrame:
    """Per event a payload of three sensors with two readings each, an hour apart; the last one has no number."""
    millis = F.unix_millis(F.date_trunc("SECOND", "ts"))
    point = lambda offset, v: F.struct((millis + offset).alias("t"), v.cast("string").alias("v"))
    series = lambda label, a, b: F.struct(
        F.struct(F.lit(label).alias("label")).alias("metadata"), F.array(point(0, a), point(3_600_000, b)).alias("data")
    )
    value = F.col("value")
    sensors = F.array(
        series("0.05m", value, value + 1), series("15mA", value * 2, value * 2), series("air_temp", F.lit("7.5"), F.lit("-")),
    )
    site = F.struct(F.struct(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("label")).alias("metadata"), sensors.alias("data"))
    return t.events.select("event_id", F.to_json(F.struct(F.array(site).alias("data"))).alias("doc"))


@query("sensor_series", """
SELECT event_id, 'S' || user_id AS site, date_trunc('second', ts) + to_hours(h) AS date_time, label,
 round(CASE label WHEN '0.05m' THEN value + h WHEN '15mA' THEN value * 2 WHEN 'air_temp' THEN CASE WHEN h = 0 THEN 7.5e0 END END, 6) AS value
FROM events, (VALUES (0), (1)) AS x(h), (VALUES ('0.05m'), ('15mA'), ('air_temp')) AS y(label)""")
def sensor_series(t: Tables) -> DataFrame:
    records = extract.sensor_records(sensor_documents(t), "doc", ["event_id"])
    return records.withColumn("value", F.round(F.col("value").try_cast("double"), 6))


@query("unpivot_depths", """
WITH b AS (SELECT event_id, value, date_trunc('second', ts) + to_hours(h) AS date_time, h FROM events, (VALUES (0), (1)) AS x(h))
SELECT event_id, date_time, '0' AS depth, NULL::DOUBLE AS rock_temp, CASE WHEN h = 0 THEN 7.5e0 END AS air_temp, NULL::DOUBLE AS air_humidity FROM b
UNION ALL SELECT event_id, date_time, '0.01', NULL, NULL, NULL FROM b
UNION ALL SELECT event_id, date_time, '0.05', round(value + h, 6), NULL, NULL FROM b
UNION ALL SELECT event_id, date_time, '15.1', round(value * 2, 6), NULL, NULL FROM b""")
def unpivot_depths(t: Tables) -> DataFrame:
    """Sensor payloads to a wide table and on to one row per depth."""
    records = extract.sensor_records(sensor_documents(t), "doc", ["event_id"])
    wide = extract.series_table(records, ["event_id", "date_time"], ["0.05m", "15mA", "air_temp"])
    rows = extract.profile_rows(wide, ["event_id", "date_time"])
    return rows.withColumn("rock_temp", F.round("rock_temp", 6))


@query("location_fanout", """
SELECT s_suppkey AS site, CAST(s_nationkey AS DOUBLE) AS lat, s_acctbal AS lon, l_shipdate AS date_time, max(l_quantity) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def location_fanout(t: Tables) -> DataFrame:
    """Every location's payload rows with the location's columns: a join instead of a loop over locations."""
    payload = t.lineitem.groupBy(F.col("l_suppkey").alias("site"), F.col("l_shipdate").alias("date_time")).agg(F.max("l_quantity").alias("value"))
    places = t.supplier.select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").cast("double").alias("lat"), F.col("s_acctbal").alias("lon"))
    return contexts.per_location(places, payload, "site")


# --- messages ------------------------------------------------------------------------------------------


def page_messages(t: Tables) -> DataFrame:
    """Pages and event properties as incoming payloads of several kinds."""
    lang = F.regexp_extract("url", r"/(\w\w)/", 1)
    return t.pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.encode("html", "UTF-8").alias("content"),
        F.when(lang == "en", "application/json").when(lang == "fr", "text/csv").otherwise("text/html").alias("content_type"),
    ).unionByName(t.events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.encode(F.when(F.col("value") < 5, "").when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).otherwise(F.col("props")), "UTF-8").alias("content"),
        F.lit("application/json").alias("content_type"),
    ))


@query("validate_payload", """
SELECT 'p' || page_id AS id, CASE WHEN regexp_extract(url, '/([a-z][a-z])/', 1) = 'en' THEN 'invalid JSON'
  WHEN regexp_extract(url, '/([a-z][a-z])/', 1) = 'fr' THEN '' ELSE 'unsupported content type' END AS reason FROM pages
UNION ALL SELECT 'e' || event_id, CASE WHEN value < 5 THEN 'empty payload' WHEN event_type = 'error' THEN 'invalid JSON' ELSE '' END FROM events""")
def validate_payload(t: Tables) -> DataFrame:
    checked = page_messages(t).select("id", messages.reject_reason(F.col("content"), F.col("content_type")).alias("reason"))
    return checked.select("id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("failure_summary", """
WITH m AS (SELECT CASE WHEN value < 5 THEN 'empty payload' WHEN event_type = 'error' THEN 'invalid JSON' END AS reason, 'e' || event_id AS id FROM events
UNION ALL SELECT CASE WHEN regexp_extract(url, '/([a-z][a-z])/', 1) = 'en' THEN 'invalid JSON'
  WHEN regexp_extract(url, '/([a-z][a-z])/', 1) = 'fr' THEN NULL ELSE 'unsupported content type' END, 'p' || page_id FROM pages)
SELECT reason AS type, count(*) AS n, min(id) AS first, max(id) AS last FROM m WHERE reason IS NOT NULL GROUP BY reason""")
def failure_summary(t: Tables) -> DataFrame:
    failed = page_messages(t).withColumn("reason", messages.reject_reason(F.col("content"), F.col("content_type"))).where("reason IS NOT NULL")
    return messages.failure_summary(failed, "reason", "id")


@query("request_contexts", """
SELECT n_name AS site, k.kind, 'demo' AS network, 'https://example.org/' || k.kind || '/' || n_name || '?region=' || r_name || '&net=demo' AS url
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('hourly'), ('daily')) AS k(kind) WHERE r_name <> 'ASIA'""")
def request_contexts(t: Tables) -> DataFrame:
    """Constants x schema values x table rows; rows with a blank required column are skipped."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_name", F.when(F.col("r_name") != "ASIA", F.col("r_name")).otherwise(" ").alias("r_name")
    )
    table = contexts.parameter_contexts(
        rows, constants={"network": "demo"}, schema_values={"kind": ["hourly", "daily", "hourly"]},
        outputs={"site": "n_name", "area": "r_name"}, unique=True,
    )
    url = contexts.render(table, "https://example.org/{kind}/{site}?region={area}&net={network}")
    return table.select("site", "kind", "network", url.alias("url"))


@query("route_messages", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN r_name || '/../x' WHEN o_orderpriority = '5-LOW' THEN r_name || '/nowhere' ELSE r_name || '/' || n_name END AS node,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'invalid node path' WHEN o_orderpriority = '5-LOW' THEN 'unknown node' ELSE '' END AS error
FROM orders JOIN nation ON o_custkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def route_messages(t: Tables) -> DataFrame:
    """Orders as messages addressed to the nodes of a region/nation tree."""
    tree = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    path = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("../x")).when(F.col("o_orderpriority") == "5-LOW", F.lit("nowhere"))
        .otherwise(F.concat(F.lit(" /"), F.col("n_name")))
    )
    sent = t.orders.join(tree, F.col("o_custkey") % 25 == F.col("n_nationkey")).select(
        "o_orderkey", F.struct(F.col("r_name").alias("target_node"), path.alias("node_path")).alias("metadata")
    )
    catalog = tree.select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    routed = messages.route(sent, catalog)
    return routed.select("o_orderkey", "node", F.coalesce("route_error", F.lit("")).alias("error"))


@query("newest_per_key", """
SELECT o_custkey AS logger_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS label, max(o_orderdate) AS modified FROM orders GROUP BY o_custkey""")
def newest_per_key(t: Tables) -> DataFrame:
    """Logger lists of several files merged: the newest entry of each logger wins."""
    listed = t.orders.groupBy(F.col("o_custkey").alias("logger_id"), F.col("o_orderdate").alias("modified")).agg(F.max("o_orderkey").alias("label"))
    return newest(
        [listed.where("modified < DATE'1997-01-01'"), listed.where("modified >= DATE'1997-01-01'")], "logger_id"
    )


@query("sidecar_join", """
SELECT 'in/' || o_orderkey || '.csv' AS path, o_totalprice AS size, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS endpoint FROM orders""")
def sidecar_join(t: Tables) -> DataFrame:
    """Messages with the metadata file of the same name; some have none."""
    path = F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    data = t.orders.select(path.alias("path"), F.col("o_totalprice").alias("size"))
    side = t.orders.where("o_orderstatus <> 'P'").select(F.concat(path, F.lit(".meta.json")).alias("path"), F.col("o_orderpriority").alias("endpoint"))
    return with_sidecar(data, side)
