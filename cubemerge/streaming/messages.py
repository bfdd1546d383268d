"""Incoming messages: envelope, validation, routing, failure summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions.text import clean_node_path, content_kind

METADATA = T.StructType([
    T.StructField("content_type", T.StringType()),
    T.StructField("endpoint_name", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("received_at", T.StringType()),
    T.StructField("schema_path", T.StringType()),
    T.StructField("target_node", T.StringType()),
    T.StructField("node_path", T.StringType()),
    T.StructField("extract_fn", T.StringType()),
    T.StructField("fn_module", T.StringType()),
    T.StructField("dataframe_row", T.MapType(T.StringType(), T.StringType())),
])


def reject_reason(content: Column, content_type: Column) -> Column:
    """Why a payload is not accepted; NULL when it is."""
    kind = content_kind(content_type)
    decoded = F.try_validate_utf8(content.cast("string"))
    # the parser stops after the first value; inside a list, anything behind it shows up
    listed = F.try_parse_json(F.concat(F.lit("["), decoded, F.lit("]")))
    item = lambda i: F.try_variant_get(listed, f"$[{i}]", "variant")
    not_json = item(0).isNull() | item(1).isNotNull()
    return (
        F.when(kind.isNull(), "unsupported content type")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty payload")
        .when((kind == "json") & not_json, "invalid JSON")
        .when((kind == "csv") & decoded.isNull(), "invalid CSV")
    )


def route(messages: DataFrame, catalog: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``node`` (path of the target node) and ``route_error`` to messages with a ``metadata`` struct.

    The node is the metadata's target node followed by its node path; it must exist in ``catalog(path)``, among the rows that agree in the columns ``by``.
    """
    parts, valid = [], F.lit(True)
    for name in ("target_node", "node_path"):
        path, ok = clean_node_path(F.col(f"metadata.{name}"))
        parts.append(path)
        valid = valid & ok
    wanted = messages.withColumn("_path", F.regexp_replace(F.concat_ws("/", *parts), "/+$", "")).withColumn("_valid", valid)
    known = catalog.select(*by, F.col("path").alias("_path"), F.lit(True).alias("_known")).distinct()
    joined = wanted.join(known, ["_path", *by], "left")
    error = F.when(~F.col("_valid"), "invalid node path").when(F.col("_known").isNull(), "unknown node")
    return joined.withColumn("route_error", error).withColumn("node", F.col("_path")).drop("_path", "_valid", "_known")


def failure_summary(failed: DataFrame, reason: str, context: str) -> DataFrame:
    """(type, n, first, last) per kind of failure; the rows themselves stay in the dead-letter table."""
    return failed.groupBy(F.col(reason).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.min(context).alias("first"), F.max(context).alias("last")
    )
