"""Source queries: files written from the tables and read back, and message queues that feed a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.plans.gridding import VALID
from cubemerge.plans.registry import Tables, query
from cubemerge.plans.storing import HOURS, new_store
from cubemerge.session import scratch_root
from cubemerge.sources import files
from cubemerge.streaming.ingest import Extractors, Ingest, append_messages, write_messages


def folder(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# Column orders of the files; the last one lacks a column.
HEADERS = [["s_suppkey", "s_name", "s_acctbal"], ["s_acctbal", "s_suppkey", "s_name"], ["s_name", "s_suppkey"]]
FILES = 9


def write_supplier_files(t: Tables, path: str) -> None:
    """Nine files with two title lines, a header of their own each, and an empty line."""
    number = F.col("s_suppkey") % FILES
    quoted = {"s_suppkey": F.col("s_suppkey").cast("string"), "s_acctbal": F.col("s_acctbal").cast("string"), "s_name": F.concat(F.lit('"'), "s_name", F.lit(', Ltd."'))}
    body = F.lit(None).cast("string")
    for i, names in enumerate(HEADERS):
        body = F.when(number % len(HEADERS) == i, F.concat_ws(",", *[quoted[n] for n in names])).otherwise(body)
    rows = t.supplier.select(number.alias("file"), F.col("s_suppkey").alias("at"), body.alias("value"))
    top = [(k, at - 4, text) for k in range(FILES) for at, text in enumerate([f"list of suppliers {k}", "s_name,s_suppkey", ",".join(HEADERS[k % len(HEADERS)]), " "])]
    lines = rows.unionByName(t.spark.createDataFrame(top, "file long, at long, value string").join(rows.select("file").distinct(), "file", "left_semi"))
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)


_SUPPLIERS = f"""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name || ', Ltd.' AS s_name, CASE WHEN s_suppkey % {FILES} % {len(HEADERS)} < 2 THEN s_acctbal END AS s_acctbal FROM supplier"""


@query("delimited_files", _SUPPLIERS)
def delimited_files(t: Tables) -> DataFrame:
    """Files whose headers differ in order and columns, below title lines."""
    path = folder(t, "suppliers")
    write_supplier_files(t, path)
    table = files.read_csv(t.spark, path, skip_rows=2)
    return table.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_acctbal").cast("double"))


@query("glob_union", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment END AS c_mktsegment, c_custkey % 4 AS part FROM customer""")
def glob_union(t: Tables) -> DataFrame:
    """Files of four folders with columns in another order, united by name, the folder's number taken from the path."""
    path = folder(t, "customers")
    for k, names in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_name", "c_custkey"], ["c_name", "c_custkey", "c_mktsegment"], ["c_name", "c_custkey"])):
        t.customer.where(F.col("c_custkey") % 4 == k).select(*names).write.option("header", True).csv(f"{path}/{k}")
    table = files.read_delimited(t.spark, f"{path}/*/*.csv", line="line")
    number = F.regexp_extract(F.col("line.path"), r"/(\d)/[^/]*$", 1).cast("long")
    return table.select(F.col("c_custkey").cast("long"), "c_name", "c_mktsegment", number.alias("part"))


ORDERS_A_FILE = 1000


def write_order_documents(t: Tables, path: str) -> None:
    """JSON files, each an array of the orders of a thousand keys."""
    block = F.call_function("div", F.col("o_orderkey"), F.lit(ORDERS_A_FILE))
    record = F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    arrays = t.orders.groupBy(block.alias("block")).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("value"))
    arrays.repartition("block").write.partitionBy("block").text(path)


@query("json_table", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def json_table(t: Tables) -> DataFrame:
    path = folder(t, "orders")
    write_order_documents(t, path)
    return files.read_json(t.spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").drop("block")


@query("json_documents", f"""
SELECT o_orderkey // {ORDERS_A_FILE} AS block, min(o_orderkey) AS first_key, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1""")
def json_documents(t: Tables) -> DataFrame:
    """One document a file: its number from the path, the first record's key and priority from the document."""
    path = folder(t, "orders")
    write_order_documents(t, path)
    docs = files.read_json_documents(t.spark, f"{path}/*")
    return docs.select(
        F.regexp_extract("path", r"block=(\d+)", 1).cast("long").alias("block"),
        F.try_variant_get("doc", "$[0].o_orderkey", "bigint").alias("first_key"), F.try_variant_get("doc", "$[0].o_orderpriority", "string").alias("priority"),
    )


# --- messages ------------------------------------------------------------------------------------------

EVENTS_A_MESSAGE = 50
# of a hundred messages one has a header that lacks a column, one names an unknown node, one is no text
BAD_HEADER, BAD_NODE, BAD_TEXT = 7, 31, 68


def messages(t: Tables) -> DataFrame:
    """(name, content, metadata): CSV payloads of fifty events each, in event order by name."""
    number = F.call_function("div", F.col("event_id"), F.lit(EVENTS_A_MESSAGE))
    line = F.concat_ws(",", F.col("ts").cast("string"), F.col("user_id").cast("string"), F.expr(VALID).cast("string"), F.col("event_id").cast("string"))
    # a missing value is an empty field
    line = F.when(F.expr(VALID).isNull(), F.concat_ws(",", F.col("ts").cast("string"), F.col("user_id").cast("string"), F.lit(""), F.col("event_id").cast("string"))).otherwise(line)
    lines = F.sort_array(F.collect_list(F.struct("event_id", line.alias("line"))))
    body = t.events.groupBy(number.alias("number")).agg(F.array_join(lines["line"], "\n").alias("body"))
    kind = F.col("number") % 100
    header = F.when(kind == BAD_HEADER, F.lit("ts,user_id,other,event_id\n")).otherwise(F.lit("ts,user_id,value,event_id\n"))
    text = F.concat(header, "body").cast("binary")
    node = F.when(kind == BAD_NODE, F.lit("nowhere")).otherwise(F.lit(""))
    return body.select(
        F.format_string("m%010d.csv", F.col("number")).alias("name"), F.when(kind == BAD_TEXT, F.concat(F.lit(b"\xff\xfe"), text)).otherwise(text).alias("content"),
        F.to_json(F.struct(F.lit("text/csv").alias("content_type"), node.alias("target_node"))).alias("metadata"),
    )


def ingest(t: Tables, queue: str) -> Ingest:
    extractors = Extractors()
    extractors.csv("events", "ts string, user_id long, value double, event_id long")
    return Ingest(new_store(t, HOURS), queue, extractors, {"csv": "events"})


_MESSAGE = f"event_id // {EVENTS_A_MESSAGE} % 100"
_GOOD = f"""SELECT date_trunc('hour', ts) AS "time", user_id AS site, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value
FROM (SELECT ts, user_id, event_id, {VALID} AS value FROM events WHERE {_MESSAGE} NOT IN ({BAD_HEADER}, {BAD_NODE}, {BAD_TEXT})) GROUP BY ALL HAVING count(value) > 0"""


@query("ingest_late_sidecars", _GOOD)
def ingest_late_sidecars(t: Tables) -> DataFrame:
    """Data files in one batch, their sidecars in the next: cells of the store afterwards."""
    queue, checkpoint = folder(t, "queue"), folder(t, "stream")
    feed, rows = ingest(t, queue), messages(t)
    write_messages(rows.withColumn("metadata", F.lit(None).cast("string")), queue)
    feed.start(checkpoint, once=True, files_per_batch=1_000_000).awaitTermination()
    write_messages(rows.withColumn("content", F.lit(None).cast("binary")), queue)
    feed.start(checkpoint, once=True, files_per_batch=1_000_000).awaitTermination()
    return feed.store.node("").read_df("value")


@query("ingest_failures", f"""
SELECT 'm' || lpad(CAST(number AS VARCHAR), 10, '0') || '.csv' AS name, CASE number % 100 WHEN {BAD_HEADER} THEN 'columns not in the header: [''value'']'
  WHEN {BAD_NODE} THEN 'unknown node' ELSE 'invalid CSV' END AS reason, CAST(2 AS BIGINT) AS tries
FROM (SELECT DISTINCT event_id // {EVENTS_A_MESSAGE} AS number FROM events) WHERE number % 100 IN ({BAD_HEADER}, {BAD_NODE}, {BAD_TEXT})""")
def ingest_failures(t: Tables) -> DataFrame:
    """A queue of message rows, and the messages that fail in it and once more in a replay."""
    queue = folder(t, "queue")
    append_messages(messages(t), queue)
    feed = ingest(t, queue)
    feed.start_rows(folder(t, "stream"), once=True).awaitTermination()
    feed.replay()
    return feed.failed().groupBy(F.col("path").alias("name"), "reason").agg(F.count(F.lit(1)).alias("tries"))
