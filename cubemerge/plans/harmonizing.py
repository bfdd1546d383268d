"""Harmonize queries: rename, types, units, date-times, ranges, labels, row filters, scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.functions import datetimes, geo, text, values
from cubemerge.operators import harmonize as hz
from cubemerge.operators import select
from cubemerge.plans.registry import Tables, query
from cubemerge.schema import DateTimeUnit, NodeSchema
from cubemerge.sources.files import normalize_loggers

# Events as sensor readings: local CET times to UTC hours, degC to K, values above 300 degC out of range.
READINGS = NodeSchema.from_dict({
    "COORDS": {
        "time": {"unit": {"tick": "h", "tz": "UTC"}, "source_unit": {"tick": "us", "tz": "CET"}, "df_col": "ts"},
        "site": {"type": "int64", "df_col": "user_id", "sorted": False},
    },
    "VARS": {
        "temperature": {
            "unit": "K", "source_unit": "degC", "df_col": "value", "coords": ["time", "site"],
            "range": {"interval": [273.15, 573.15]},
        },
    },
})


@query("harmonize_units", """
SELECT date_trunc('hour', ts - INTERVAL 1 HOUR) AS "time", user_id AS site,
       CASE WHEN value + 273.15e0 BETWEEN 273.15e0 AND 573.15e0 THEN round(value + 273.15e0, 6) END AS temperature,
       event_id
FROM events""")
def harmonize_units(t: Tables) -> DataFrame:
    cells = hz.harmonize(t.events, READINGS, "event_id").cells
    return cells.select("time", "site", F.round("temperature", 6).alias("temperature"), F.col(hz.SEQ).alias("event_id"))


@query("reject_out_of_range", """
SELECT event_id,
       CASE WHEN (SELECT count(*) FROM events WHERE NOT value BETWEEN 0 AND 400) = 0 THEN value END AS strict_value,
       CASE WHEN (SELECT count(*) FROM events WHERE NOT value BETWEEN 0 AND 1000000) = 0 THEN value END AS loose_value
FROM events""")
def reject_out_of_range(t: Tables) -> DataFrame:
    rng = lambda high: {"type": "float64", "df_col": "value", "coords": ["event_id"], "range": {"interval": [0, high]}}
    schema = NodeSchema.from_dict({
        "COORDS": {"event_id": {"type": "int64"}},
        "VARS": {"strict_value": rng(400), "loose_value": rng(1000000)},
    })
    return hz.harmonize(t.events, schema, out_of_range="reject_column").cells


@query("quality_report", """
SELECT 'temperature' AS variable, 'out_of_range' AS problem, count(*) FILTER (WHERE value + 273.15e0 > 573.15e0) AS "rows" FROM events
UNION ALL SELECT 'humidity', 'missing_column', count(*) FROM events
UNION ALL SELECT 'kind', 'unknown_label', count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) FROM events
UNION ALL SELECT 'whole', 'trimmed', count(*) FILTER (WHERE value <> trunc(value)) FROM events""")
def quality_report(t: Tables) -> DataFrame:
    schema = NodeSchema.from_dict({
        "COORDS": READINGS.source["COORDS"],
        "VARS": {
            **READINGS.source["VARS"],
            "humidity": {"unit": "percent", "coords": ["time", "site"]},
            "kind": {"df_col": "event_type", "coords": ["time", "site"], "range": {"discrete": ["click", "view"]}},
            "whole": {"type": "int32", "df_col": "value", "coords": ["time", "site"]},
        },
    })
    return hz.harmonize(t.events, schema, "event_id").report


@query("type_trim_report", """
SELECT p_partkey, substring(p_name, 1, 8) AS short_name, length(p_name) > 8 AS name_trimmed,
       CAST(trunc(p_retailprice) AS INTEGER) AS whole_price, p_retailprice <> trunc(p_retailprice) AS price_trimmed,
       CASE WHEN p_size * 4 <= 127 THEN CAST(p_size * 4 AS TINYINT) END AS small_size
FROM part""")
def type_trim_report(t: Tables) -> DataFrame:
    p = t.part
    kind = lambda c: p.schema[c].dataType
    name, name_trimmed = values.cast_typed(F.col("p_name"), kind("p_name"), "str[8]")
    price, price_trimmed = values.cast_typed(F.col("p_retailprice"), kind("p_retailprice"), "int32")
    small, _ = values.cast_typed(F.col("p_size") * 4, kind("p_size"), "int8")
    return p.select(
        "p_partkey", name.alias("short_name"), name_trimmed.alias("name_trimmed"), price.alias("whole_price"),
        price_trimmed.alias("price_trimmed"), small.alias("small_size"),
    )


@query("na_normalize", """
SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 50e0) AS quantity, NULLIF(l_tax, 0e0) AS tax FROM lineitem""")
def na_normalize(t: Tables) -> DataFrame:
    li = t.lineitem
    dtype = li.schema["l_quantity"].dataType
    nan = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return li.select(
        "l_orderkey", "l_linenumber",
        values.na_normalize(F.col("l_quantity"), dtype, 50.0, "float64").alias("quantity"),
        values.na_normalize(nan, dtype).alias("tax"),
    )


@query("tz_tick", """
SELECT event_id, date_trunc('hour', ts - INTERVAL 1 HOUR) AS utc_hour,
       ts + INTERVAL 330 MINUTE AS shifted, date_trunc('day', ts - INTERVAL 1 HOUR) AS utc_day
FROM events""")
def tz_tick(t: Tables) -> DataFrame:
    ts, cet = F.col("ts"), DateTimeUnit("us", "CET")
    return t.events.select(
        "event_id",
        datetimes.convert_datetime(ts, cet, DateTimeUnit("h", "UTC")).alias("utc_hour"),
        datetimes.convert_timezone(ts, "UTC", "+05:30").alias("shifted"),
        datetimes.convert_datetime(ts, cet, DateTimeUnit("D", "UTC")).alias("utc_day"),
    )


@query("parse_mixed_dates", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def parse_mixed_dates(t: Tables) -> DataFrame:
    """Times written in a different form per event type, one of them with an explicit offset."""
    ts = F.date_trunc("SECOND", "ts").cast("timestamp_ntz")
    form = lambda pattern: F.date_format(ts, pattern)
    written = (
        F.when(F.col("event_type") == "click", F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(F.col("event_type") == "view", F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOUR"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
        .when(F.col("event_type") == "error", form("dd.MM.yyyy HH:mm:ss"))
        .when(F.col("event_type") == "signup", form("d MMM yyyy HH:mm:ss"))
        .otherwise(form("yyyy/MM/dd HH:mm:ss"))
    )
    unit = DateTimeUnit("s", "UTC", dayfirst=True)
    return t.events.select("event_id", written.alias("w")).select(
        "event_id", datetimes.parse_datetime(F.col("w"), unit).alias("parsed")
    )


@query("parse_logger_dates", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def parse_logger_dates(t: Tables) -> DataFrame:
    ts = F.date_trunc("SECOND", "ts").cast("timestamp_ntz")
    written = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "dd-MM-yyyy HH:mm:ss"))
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(datetimes.to_epoch_ticks(ts, "ms").cast("string"))
    )
    return t.events.select("event_id", written.alias("w")).select(
        "event_id", datetimes.parse_logger_time(F.col("w")).alias("parsed")
    )


@query("epoch_ticks", """
SELECT event_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hours, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS millis,
       date_trunc('millisecond', ts) AS back
FROM events""")
def epoch_ticks(t: Tables) -> DataFrame:
    ts = F.col("ts")
    millis = datetimes.to_epoch_ticks(ts, "ms")
    return t.events.select(
        "event_id", datetimes.to_epoch_ticks(ts, "h").alias("hours"), millis.alias("millis"),
        datetimes.from_epoch_ticks(millis, "ms").alias("back"),
    )


@query("add_duration", """
SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL 90 MINUTE AS later, l_shipdate - INTERVAL 36 HOUR AS earlier FROM lineitem""")
def add_duration(t: Tables) -> DataFrame:
    ship = F.col("l_shipdate")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", datetimes.add_duration(ship, 5400, "s").alias("later"),
        datetimes.add_duration(ship, -36 * 3600.0, "s").alias("earlier"),
    )


@query("discrete_codes", """
SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END::BIGINT AS code,
       CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS label
FROM events""")
def discrete_codes(t: Tables) -> DataFrame:
    labels = ("view", "click", "purchase")
    coded = t.events.select("event_id", values.encode_labels(F.col("event_type"), labels).alias("code"))
    return coded.withColumn("label", values.decode_labels(F.col("code"), labels))


@query("label_table_codes", """
WITH labels AS (SELECT p_type AS label, row_number() OVER (ORDER BY p_type) AS code FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, coalesce(code, 0)::BIGINT AS code, label FROM part LEFT JOIN labels ON p_type = label""")
def label_table_codes(t: Tables) -> DataFrame:
    labels = hz.label_table(t.part, "p_type")
    coded = hz.encode_with_table(t.part.select("p_partkey", "p_type"), "p_type", labels, "code")
    return hz.decode_with_table(coded.select("p_partkey", "code"), "code", labels, "label")


@query("drop_missing_keys", """
SELECT user_id, NULLIF(event_type, 'error') AS kind, value FROM events WHERE event_type <> 'error' AND value >= 5""")
def drop_missing_keys(t: Tables) -> DataFrame:
    marked = t.events.select(
        "user_id", F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") >= 5, F.col("value")).alias("value")
    )
    return hz.drop_missing_keys(marked, ["user_id", "kind", "value"])


@query("missing_key_counts", """
SELECT count(*) FILTER (WHERE event_type = 'error') AS missing_kind, count(*) FILTER (WHERE value < 5) AS missing_value FROM events""")
def missing_key_counts(t: Tables) -> DataFrame:
    """The quality report's counts of rows without a key."""
    marked = t.events.select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") >= 5, F.col("value")).alias("value")
    )
    schema = NodeSchema.from_dict({
        "COORDS": {"kind": {"type": "str[16]", "sorted": False}, "value": {"type": "float64"}}, "VARS": {"event_id": {"type": "int64", "coords": ["kind", "value"]}},
    })
    report = hz.harmonize(marked, schema).report.where("problem = 'missing_key'")
    rows = lambda name: F.coalesce(F.max(F.when(F.col("variable") == name, F.col("rows"))), F.lit(0).cast("long")).alias(f"missing_{name}")
    return report.agg(rows("kind"), rows("value"))


@query("select_roles", 'SELECT ts AS "time", user_id AS site, value AS temperature FROM events')
def select_roles(t: Tables) -> DataFrame:
    renamed = t.events.select(F.col("ts").alias("time"), F.col("user_id").alias("site"), F.col("value").alias("temperature"), "props")
    keys = hz.select_role(renamed, READINGS, "coords").columns
    return renamed.select(*keys, *hz.select_role(renamed, READINGS, "quantities").columns)


@query("numeric_coercion", """
SELECT event_id, value, try_cast(substring(props, 7, length(props) - 7) AS DOUBLE) AS k FROM events""")
def numeric_coercion(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.col("value").cast("string").alias("value"),
                          F.expr("substring(props, 7, length(props) - 7)").alias("k"))
    return hz.numeric_columns(raw, ["event_id"])


@query("finite_export", """
SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier""")
def finite_export(t: Tables) -> DataFrame:
    odd = F.when(F.col("s_acctbal") < -500, F.lit(float("nan"))).when(F.col("s_acctbal") < 0, F.lit(float("-inf")))
    return hz.finite_export(t.supplier.select("s_suppkey", odd.otherwise(F.col("s_acctbal")).alias("balance")))


# --- filters -------------------------------------------------------------------------------------------

SUPPLIER_SITE = "s_suppkey, 49e0 + (s_suppkey % 20) * 1e-2 AS lat, 14e0 + (s_suppkey % 30) * 1e-2 AS lon"


def sites(t: Tables, *more: str) -> DataFrame:
    """Suppliers as sites; positions computed from the key."""
    return t.supplier.selectExpr(*[c.strip() for c in SUPPLIER_SITE.split(", ")], *more)


@query("sel_slice", """
SELECT ts, user_id, event_type, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00' AND event_type IN ('click', 'view')""")
def sel_slice(t: Tables) -> DataFrame:
    cells = t.events.select("ts", "user_id", "event_type", "value")
    return select.sel(cells, ts=slice("2024-01-10", "2024-01-12 12:00:00"), event_type=["click", "view"])


@query("box_match", f"""
SELECT * FROM (SELECT {SUPPLIER_SITE} FROM supplier) WHERE lat BETWEEN 49.05e0 - 1e-3 AND 49.05e0 + 1e-3 AND lon BETWEEN 14.15e0 - 1e-3 AND 14.15e0 + 1e-3""")
def box_match(t: Tables) -> DataFrame:
    return select.box_match(sites(t), "lat", "lon", 49.05, 14.15)


@query("box_match_swapped", f"""
SELECT * FROM (SELECT {SUPPLIER_SITE} FROM supplier) WHERE lat BETWEEN 49.05e0 - 1e-3 AND 49.05e0 + 1e-3 AND lon BETWEEN 14.15e0 - 1e-3 AND 14.15e0 + 1e-3""")
def box_match_swapped(t: Tables) -> DataFrame:
    return select.box_match(sites(t), "lat", "lon", 14.15, 49.05)


@query("viewport_filter", f"""
SELECT * FROM (SELECT {SUPPLIER_SITE} FROM supplier)
WHERE lon BETWEEN 14.05e0 - 1e-2 AND 14.15e0 + 1e-2 AND lat BETWEEN 49.0e0 - 1e-2 AND 49.1e0 + 1e-2""")
def viewport_filter(t: Tables) -> DataFrame:
    # a view of 0.1 degree with a margin of a tenth of its width
    return select.viewport(sites(t), "lon", "lat", (14.05, 14.15), (49.0, 49.1), 0.1)


@query("clean_sites", """
SELECT s_name AS site, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lon FROM supplier WHERE s_acctbal > 1000 AND s_nationkey > 4""")
def clean_sites(t: Tables) -> DataFrame:
    raw = t.supplier.select(
        F.when(F.col("s_nationkey") > 4, F.col("s_name")).otherwise(F.lit("")).alias("site"),
        F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal").cast("string")).otherwise(F.lit("n/a")).alias("lat"),
        F.col("s_nationkey").cast("string").alias("lon"),
    )
    return select.clean_sites(raw, "site", "lat", "lon")


@query("required_columns", """
SELECT c_custkey, '' AS missing FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0
UNION ALL SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_acctbal < 0 THEN 'balance' END)
FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""")
def required_columns(t: Tables) -> DataFrame:
    raw = t.customer.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
    )
    complete, rejected = select.required_columns(raw, ["segment", "balance"])
    return complete.select("c_custkey", F.lit("").alias("missing")).unionByName(rejected.select("c_custkey", "missing"))


@query("node_glob", """
SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' AND n_name LIKE '%1_'""")
def node_glob(t: Tables) -> DataFrame:
    catalog = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    return select.match_nodes(catalog, "A*/*1?")


@query("recent_errors", """
SELECT event_id, ts, event_type AS level FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 200) WHERE event_type IN ('error', 'signup')""")
def recent_errors(t: Tables) -> DataFrame:
    log = t.events.select("event_id", "ts", F.col("event_type").alias("level"))
    return select.recent_events(log, "ts", "level", 200, ("error", "signup"))


# --- scalar rules --------------------------------------------------------------------------------------


@query("depth_labels", """
SELECT p_partkey, CASE WHEN p_size = 15 THEN '15.1' WHEN p_size = 16 THEN '15.2' ELSE CAST(p_size AS VARCHAR) END AS depth,
       p_size <= 40 AS is_depth
FROM part""")
def depth_labels(t: Tables) -> DataFrame:
    size = F.col("p_size")
    key = (
        F.when(size == 15, F.lit("15mA")).when(size == 16, F.lit("15mB"))
        .when(size <= 40, F.concat(size.cast("string"), F.lit("m"))).otherwise(size.cast("string"))
    )
    keyed = t.part.select("p_partkey", key.alias("k"))
    return keyed.select("p_partkey", text.depth_label(F.col("k")).alias("depth"), text.is_depth_key(F.col("k")).alias("is_depth"))


@query("first_numbers", """
SELECT page_id, CASE WHEN regexp_extract(url, '[-+]?[0-9]*[.][0-9]+|[0-9]+') = '' THEN '0'
       ELSE regexp_extract(url, '[-+]?[0-9]*[.][0-9]+|[0-9]+') END AS number FROM pages""")
def first_numbers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.first_number(F.col("url")).alias("number"))


@query("split_lat_lon", "SELECT s_suppkey, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lon FROM supplier")
def split_lat_lon(t: Tables) -> DataFrame:
    gps = t.supplier.select("s_suppkey", F.concat_ws(", ", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string")).alias("gps"))
    lat, lon = text.split_lat_lon(F.col("gps"))
    return gps.select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


@query("web_mercator", f"""
SELECT s_suppkey, round(radians(lon) * 6378137e0, 4) AS x,
       round(ln(tan(radians(greatest(least(lat, 85.05112878e0), -85.05112878e0)) / 2 + pi() / 4)) * 6378137e0, 4) AS y
FROM (SELECT s_suppkey, -100e0 + (s_suppkey % 20) * 1e1 AS lat, 14e0 + (s_suppkey % 30) * 1e-2 AS lon FROM supplier)""")
def web_mercator(t: Tables) -> DataFrame:
    placed = t.supplier.selectExpr("s_suppkey", "-100e0 + (s_suppkey % 20) * 1e1 AS lat", "14e0 + (s_suppkey % 30) * 1e-2 AS lon")
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return placed.select("s_suppkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("zoom_spans", "SELECT p_partkey, round(40075016.68557849e0 / pow(2, p_size % 19), 6) AS span FROM part")
def zoom_spans(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(geo.zoom_span(F.expr("p_size % 19")), 6).alias("span"))


@query("probe_units", f"""
SELECT CASE WHEN max(abs(lat)) < 1.6e0 THEN round(radians(49.05e0), 9) ELSE 49.05e0 END AS in_degrees,
       CASE WHEN max(abs(radians(lat))) < 1.6e0 THEN round(radians(49.05e0), 9) ELSE 49.05e0 END AS in_radians
FROM (SELECT {SUPPLIER_SITE} FROM supplier)""")
def probe_units(t: Tables) -> DataFrame:
    stats = sites(t).agg(geo.in_radians(F.col("lat")).alias("a"), geo.in_radians(F.radians("lat")).alias("b"))
    return stats.select(*[
        F.round(geo.probe_angle(49.05, 49.05, F.col(c)), 9).alias(n) for c, n in (("a", "in_degrees"), ("b", "in_radians"))
    ])


@query("classify_content", """
SELECT page_id, CASE WHEN regexp_matches(lower(url), '/en/') THEN 'json' WHEN regexp_matches(lower(url), '/fr/') THEN 'csv'
       WHEN regexp_matches(lower(url), '/de/') THEN 'grib_bz2' ELSE 'octet-stream' END AS kind
FROM pages""")
def classify_content(t: Tables) -> DataFrame:
    url = F.lower("url")
    declared = (
        F.when(url.contains("/en/"), "Application/JSON; charset=utf-8").when(url.contains("/fr/"), "text/csv")
        .when(url.contains("/de/"), "application/x-GRIB+bzip2").otherwise("application/octet-stream")
    )
    return t.pages.select("page_id", text.content_kind(text.content_type_of(F.col("url"), declared)).alias("kind"))


@query("clean_paths", """
SELECT page_id, NULLIF(regexp_replace(trim(regexp_replace(url, '^https?:', '')), '^/+', ''), '') AS path,
       NOT regexp_matches(url, '(^|/)[.][.](/|$)') AS valid
FROM pages""")
def clean_paths(t: Tables) -> DataFrame:
    raw = t.pages.select("page_id", F.concat(F.lit("  "), F.regexp_replace("url", "^https?:", "")).alias("p"))
    path, valid = text.clean_node_path(F.col("p"))
    return raw.select("page_id", path.alias("path"), valid.alias("valid"))


@query("parse_log_lines", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
       'user ' || user_id || ' did ' || event_type AS message
FROM events""")
def parse_log_lines(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "signup", "WARN").otherwise(F.upper("event_type"))
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" level="), level, F.lit(" message=user "),
        F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"),
    )
    lines = t.events.select("event_id", line.alias("line"))
    return lines.select("event_id", *[c.alias(n) for n, c in text.parse_log_line(F.col("line")).items()])


@query("logger_table", """
SELECT date_trunc('second', o_orderdate) AS date_time, 'U' || (o_custkey % 25) AS "loggerUid", o_orderkey AS "orderRef",
       round((o_totalprice) / 100, 6) AS s1, CAST(o_custkey AS DOUBLE) AS t1, CAST(o_orderkey AS DOUBLE) AS t0,
       round(49 + n_nationkey * 1e-1, 6) AS latitude, round(14 + n_regionkey * 1e-1, 6) AS longitude
FROM orders JOIN nation ON o_custkey % 25 = n_nationkey""")
def logger_table(t: Tables) -> DataFrame:
    """Orders as logger exports: a text time, percent and temperature columns, sites from the nations."""
    raw = t.orders.select(
        F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss").alias("dateTime"),
        F.concat(F.lit("U"), (F.col("o_custkey") % 25).cast("string")).alias("stem"),
        F.col("o_orderkey").cast("string").alias("loggerUid"),
        F.col("o_totalprice").cast("string").alias("s1"),
        F.col("o_custkey").cast("string").alias("s1t"),
        F.col("o_orderkey").cast("string").alias("s11t"),
        F.col("o_orderdate").cast("string").alias("ttlDate"),
    )
    places = t.nation.select(
        F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("logger_id"),
        F.round(F.expr("49 + n_nationkey * 1e-1"), 6).alias("latitude"),
        F.round(F.expr("14 + n_regionkey * 1e-1"), 6).alias("longitude"),
    )
    table = normalize_loggers(raw, places)
    return table.select(
        "date_time", "loggerUid", F.col("fullLoggerUid").cast("long").alias("orderRef"), F.round("s1", 6).alias("s1"),
        "t1", "t0", "latitude", "longitude",
    )
