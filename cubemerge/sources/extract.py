"""JSON documents and nested payloads -> rows. All steps are VARIANT or array expressions over a document table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions import text
from cubemerge.functions.datetimes import epoch_millis
from cubemerge.functions.values import safe_double

_NAME = re.compile(r"\{([A-Za-z_]\w*)\}")
_TOKEN = re.compile(r"\{\{|\}\}|\{[A-Za-z_]\w*\}|[^{}]+|[{}]")


class PathError(ValueError):
    """A path pattern or column template is wrong."""


@dataclass(frozen=True)
class Segment:
    """One step of a path: literal text and placeholder names in order, e.g. ("run", "{n}")."""

    parts: tuple[tuple[str, bool], ...]

    @property
    def literal(self) -> str | None:
        return None if any(named for _, named in self.parts) else "".join(t for t, _ in self.parts)

    @property
    def names(self) -> list[str]:
        return [t for t, named in self.parts if named]

    def regex(self) -> str:
        return "^" + "".join("(.*?)" if named else re.escape(t) for t, named in self.parts) + "$"

    def rendered(self, values: dict[str, Column]) -> Column:
        return F.concat(*[values[t] if named else F.lit(t) for t, named in self.parts])


def parse_path(path: str) -> list[Segment]:
    """``/a/{x}/run{n}_{tag}``; ``//`` is a literal slash, ``{{`` and ``}}`` literal braces."""
    if not path.startswith("/") or path.startswith("//"):
        raise PathError(f"path must be absolute: {path}")
    segments = []
    # a slash separates only when it stands alone
    for raw in re.split(r"(?<!/)/(?!/)", path)[1:]:
        parts: list[tuple[str, bool]] = []
        for token in _TOKEN.findall(raw.replace("//", "/")):
            if len(token) > 2 and token[0] == "{":
                parts.append((token[1:-1], True))
            else:
                literal = token[0] if token in ("{{", "}}") else token
                if parts and not parts[-1][1]:
                    parts[-1] = (parts[-1][0] + literal, False)
                else:
                    parts.append((literal, False))
        segments.append(Segment(tuple(parts)))
    return segments


def _quoted(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _get(node: Column, keys: list[str], type_name: str = "variant", arrays: bool = True) -> Column:
    """Descend literal keys in one path expression. A key of digits may be an object key or a list index, so
    such a step is taken both ways."""
    path = "$"
    for i, key in enumerate(keys):
        if arrays and re.fullmatch(r"\d+", key):
            here = node if path == "$" else F.try_variant_get(node, path, "variant")
            child = F.coalesce(
                F.try_variant_get(here, "$" + _quoted(key), "variant"), F.try_variant_get(here, f"$[{int(key)}]", "variant")
            )
            return _get(child, keys[i + 1:], type_name, arrays)
        path += _quoted(key)
    return node if path == "$" and type_name == "variant" else F.try_variant_get(node, path, type_name)


def _explode(df: DataFrame, node: str, name: str) -> DataFrame:
    """One row per child of a VARIANT column: adds ``<name>`` and ``<name>_key`` (list index as text).

    A node that is missing or no container gives no rows, so no filter on the parsed document is needed.
    """
    children = df.sparkSession.tvf.variant_explode(F.col(node).outer())
    keyed = children.select(
        F.coalesce(F.col("key"), F.col("pos").cast("string")).alias(f"{name}_key"), F.col("value").alias(name)
    )
    return df.lateralJoin(keyed)


def _child_by_key(node: Column, key: Column) -> Column:
    """Child whose key is known only per row; NULL when there is none."""
    members = F.try_variant_get(node, "$", "map<string,variant>")
    items = F.try_variant_get(node, "$", "array<variant>")
    index = F.when(key.rlike(r"^\d+$"), key.try_cast("int"))
    return F.coalesce(F.try_element_at(members, key), F.get(items, index))


def _root(documents: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    is_variant = isinstance(documents.schema[doc].dataType, T.VariantType)
    return documents.select(*keep, (F.col(doc) if is_variant else F.try_parse_json(F.col(doc))).alias("_n0"))


def _only_present(df: DataFrame, node: str) -> DataFrame:
    return df.where(F.col(node).isNotNull() & ~F.is_variant_null(F.col(node)))


def json_extract(documents: DataFrame, doc: str, pattern: str, columns: dict[str, str | tuple[str, str]],
                 keep: list[str] | None = None) -> DataFrame:
    """One row per place in a document that matches ``pattern``.

    ``doc`` holds JSON text or VARIANT. A column is a path template, or one ``{placeholder}`` (always text);
    give ``(template, type)`` for a type other than string. ``keep`` carries document columns along. A path
    that does not exist gives NULL. Row order is not defined.
    """
    keep = keep or []
    df = _root(documents, doc, keep)
    segments = parse_path(pattern)
    holders: dict[str, Column] = {}
    # nodes[i]: expression of the node after i segments, relative to the last exploded column
    nodes, literals, base = [F.col("_n0")], [], "_n0"
    for i, segment in enumerate(segments):
        if segment.literal is not None:
            literals.append(segment.literal)
            nodes.append(_get(F.col(base), literals))
            continue
        source, child = base, f"_n{i + 1}"
        if literals:
            source = f"_b{i}"
            df = df.withColumn(source, nodes[-1])
        df = _explode(df, source, child)
        key = F.col(f"{child}_key")
        if len(segment.parts) == 1:
            holders[segment.names[0]] = key
        else:
            regex = "(?s)" + segment.regex()
            df = df.where(key.rlike(regex))
            for group, name in enumerate(segment.names, 1):
                df = df.withColumn(f"_p_{name}", F.regexp_extract(key, regex, group))
                holders[name] = F.col(f"_p_{name}")
        base, literals = child, []
        nodes.append(F.col(child))
    if literals:
        df = _only_present(df.withColumn("_end", nodes[-1]), "_end")
        nodes[-1] = F.col("_end")
    out = []
    for name, spec in columns.items():
        template, type_name = spec if isinstance(spec, tuple) else (spec, "string")
        if not template.startswith("/"):
            match = _NAME.fullmatch(template)
            if not match:
                raise PathError(f"column {name!r} must be an absolute path or one placeholder, got {template!r}")
            if match.group(1) not in holders:
                raise PathError(f"placeholder {match.group(1)!r} is not in the pattern {pattern!r}")
            out.append(holders[match.group(1)].cast(type_name).alias(name))
            continue
        steps = parse_path(template)
        unknown = [p for s in steps for p in s.names if p not in holders]
        if unknown:
            raise PathError(f"placeholders {unknown} are not in the pattern {pattern!r}")
        shared = 0
        while shared < min(len(steps), len(segments)) and steps[shared] == segments[shared]:
            shared += 1
        # start from the node already matched, not from the root
        node, rest = nodes[shared], []
        for step in steps[shared:]:
            if step.literal is not None:
                rest.append(step.literal)
            else:
                node, rest = _child_by_key(_get(node, rest), step.rendered(holders)), []
        out.append(_get(node, rest, type_name).alias(name))
    return df.select(*keep, *out)


def wildcard_extract(documents: DataFrame, doc: str, path: str, out: str = "value", keep: list[str] | None = None,
                     type_name: str = "string") -> DataFrame:
    """Dotted path with ``*`` for every child of an object or list: ``a.*.b``. One row per match."""
    df = _root(documents, doc, keep or [])
    base, literals = "_n0", []
    for i, part in enumerate(p for p in path.split(".") if p):
        if part != "*":
            literals.append(part)
            continue
        source = base
        if literals:
            source = f"_b{i}"
            df = df.withColumn(source, _get(F.col(base), literals, arrays=False))
        base, literals = f"_n{i + 1}", []
        df = _explode(df, source, base)
    if literals:
        df = df.withColumn("_end", _get(F.col(base), literals, arrays=False)).where(F.col("_end").isNotNull())
        base = "_end"
    return df.select(*(keep or []), F.try_variant_get(F.col(base), "$", type_name).alias(out))


# --- forecasts -----------------------------------------------------------------------------------------

_DETAILS = T.MapType(T.StringType(), T.DoubleType())
_BLOCK = T.StructType([T.StructField("details", _DETAILS)])
FORECAST = T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("timeseries", T.ArrayType(T.StructType([
            T.StructField("time", T.StringType()),
            T.StructField("data", T.StructType([
                T.StructField("instant", _BLOCK), T.StructField("next_1_hours", _BLOCK),
            ])),
        ]))),
    ])),
])


def flatten_forecast(documents: DataFrame, doc: str, quantities: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per forecast time; the details of the next hour win over the instant ones of the same name."""
    parsed = documents.select(*(keep or []), F.from_json(F.col(doc), FORECAST).alias("_d"))
    rows = parsed.select(*(keep or []), F.explode("_d.properties.timeseries").alias("_e"))
    instant, following = F.col("_e.data.instant.details"), F.col("_e.data.next_1_hours.details")
    values = [
        F.when(F.map_contains_key(following, q), F.element_at(following, q)).otherwise(F.element_at(instant, q)).alias(q)
        for q in quantities
    ]
    return rows.select(*(keep or []), F.col("_e.time").alias("date_time"), *values)


def forecast_rows(documents: DataFrame, doc: str, quantities: list[str], lat: str, lon: str, grid: str,
                  keep: list[str] | None = None) -> DataFrame:
    """Forecast rows with the location columns of the request."""
    where = [
        F.col(lon).try_cast("double").alias("longitude"),
        F.col(lat).try_cast("double").alias("latitude"),
        F.coalesce(F.col(grid).cast("boolean"), F.lit(False)).alias("grid_domain"),
    ]
    named = documents.select(doc, *(keep or []), *where)
    return flatten_forecast(named, doc, quantities, (keep or []) + ["longitude", "latitude", "grid_domain"])


# --- sensor payloads -----------------------------------------------------------------------------------

_LABEL = T.StructType([T.StructField("label", T.StringType())])
_POINT = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.StringType())])
_SENSOR = T.StructType([T.StructField("metadata", _LABEL), T.StructField("data", T.ArrayType(_POINT))])
SENSOR_PAYLOAD = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("metadata", _LABEL), T.StructField("data", T.ArrayType(_SENSOR)),
    ]))),
])


def sensor_records(documents: DataFrame, doc: str, keep: list[str] | None = None) -> DataFrame:
    """(site, date_time, label, value): parallel sensor series zipped by index with the times of the first.

    A row carries the series of one sensor and the times, so the work is linear in the payload.
    """
    parsed = documents.select(*(keep or []), F.from_json(F.col(doc), SENSOR_PAYLOAD).alias("_d"))
    site = F.get("_d.data", F.lit(0))
    sensors = site.getField("data")
    series = F.transform(sensors, lambda s: F.struct(s["metadata"]["label"].alias("label"), s["data"]["v"].alias("_v")))
    times = F.get(sensors, F.lit(0))["data"]["t"]
    each = parsed.select(*(keep or []), site["metadata"]["label"].alias("site"), times.alias("_t"), F.inline(series))
    own = F.slice(F.coalesce("_v", F.array().cast("array<string>")), F.lit(1), F.size("_t"))
    rows = each.withColumn("_v", own).select(*(keep or []), "site", "label", F.inline(F.arrays_zip("_t", "_v")))
    return rows.select(*(keep or []), "site", epoch_millis(F.col("_t")).alias("date_time"), "label", F.col("_v").alias("value"))


def series_table(records: DataFrame, keys: list[str], labels: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """Long records to one column per given label."""
    return records.groupBy(*keys).agg(*[
        F.max(F.when(F.col(label) == name, F.col(value))).alias(name) for name in labels
    ])


def profile_rows(wide: DataFrame, keys: list[str], air_temp: str = "air_temp", air_humidity: str = "air_humidity") -> DataFrame:
    """Wide measurements to (keys, depth, rock_temp, air_temp, air_humidity).

    Per input row: air temperature at depth "0", humidity at "0.01", and one row per depth column. A missing
    air column gives its row with NULL; text that is no number gives NULL.
    """
    null = F.lit(None).cast("double")
    number = lambda c: safe_double(F.col(f"`{c}`")) if c in wide.columns else null
    entry = lambda depth, rock, temp, hum: F.struct(
        depth.alias("depth"), rock.alias("rock_temp"), temp.alias("air_temp"), hum.alias("air_humidity")
    )
    rows = [
        entry(F.lit("0"), null, number(air_temp), null),
        entry(F.lit("0.01"), null, null, number(air_humidity)),
    ]
    rows += [
        entry(text.depth_label(F.lit(c)), number(c), null, null)
        for c in wide.columns
        if re.match(text.DEPTH_KEY, c)
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))
