"""Incoming table -> schema columns: rename, cast, convert, check, encode, drop rows without keys.

Everything is one projection over the source; the quality report is one aggregate over the same projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions import datetimes, units, values
from cubemerge.operators.blocks import with_position
from cubemerge.schema import DateTimeUnit, NodeSchema, SchemaError, Variable

POLICIES = ("null_cell", "reject_column", "fail")
SEQ = "_seq"


@dataclass
class Expression:
    """Column of one variable, with the conditions the quality report counts."""

    value: Column
    present: Column
    checks: dict[str, Column] = field(default_factory=dict)


@dataclass
class Harmonized:
    """``cells``: schema columns plus the order column; ``report``: (variable, problem, rows)."""

    cells: DataFrame
    report: DataFrame
    missing_columns: list[str]


def _numeric(col: Column, source: T.DataType) -> Column:
    return col.try_cast("double") if isinstance(source, (T.StringType, T.BooleanType)) else col


def _bounds(var: Variable) -> tuple[Any, Any]:
    low, high, unit = var.interval
    if unit is not None and not var.is_datetime:
        low, high = (units.convert_value(x, unit, var.unit) for x in (low, high))
    return low, high


# Label lists up to this length are literals of one expression; longer ones are joined.
LITERAL_LABELS = 32


def _code(name: str) -> str:
    return f"_code_{name}"


def with_codes(df: DataFrame, variables: list[Variable], dictionaries: dict[str, DataFrame]) -> DataFrame:
    """``df`` with the code of each long or stored label list in a column of its own, by equi-joins with (label, code) tables.

    Adaptive execution broadcasts a table whose measured size allows it.
    """
    for var in variables:
        if not _is_joined(var) or var.df_col not in df.columns:
            continue
        if var.label_table is not None:
            table = dictionaries[var.name]
        else:
            table = df.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(dict.fromkeys(var.labels)) if x is not None], ["label", "code"])
        table = table.select(F.col("label").alias(f"_label_{var.name}"), F.col("code").cast("long").alias(_code(var.name)))
        df = df.join(table, F.col(f"`{var.df_col}`") == F.col(f"_label_{var.name}"), "left").drop(f"_label_{var.name}")
    return df


def _is_joined(var: Variable) -> bool:
    return var.label_table is not None or var.labels is not None and len(var.labels) > LITERAL_LABELS


def variable_expression(var: Variable, source: T.DataType | None) -> Expression:
    """Typed, converted value of ``var`` from its source column; ``source`` None means the column is absent."""
    if source is None:
        null = F.lit(None).cast(var.storage_type)
        return Expression(null, F.lit(False))
    raw = F.col(f"`{var.df_col}`")
    if var.is_datetime:
        target = var.unit if isinstance(var.unit, DateTimeUnit) else DateTimeUnit()
        src = var.source_unit if isinstance(var.source_unit, DateTimeUnit) else target
        if isinstance(source, T.StringType):
            value = datetimes.parse_datetime(raw, src, target)
            present = raw.isNotNull() & (F.trim(raw) != "NaT")
            return Expression(value, present, {"unparsable": F.coalesce(present & value.isNull(), F.lit(False))})
        if isinstance(source, (T.IntegerType, T.LongType)):
            local = datetimes.from_epoch_ticks(raw, src.tick)
        else:
            local = raw.cast("timestamp_ntz")
        return Expression(datetimes.convert_datetime(local, src, target), raw.isNotNull())
    if var.is_coded:
        value = F.coalesce(F.col(_code(var.name)), F.lit(0).cast("long")) if _is_joined(var) else values.encode_labels(raw, var.labels)
        unknown = raw.isNotNull() & (value == 0)
        return Expression(value, raw.isNotNull(), {"unknown_label": F.coalesce(unknown, F.lit(False))})
    checks = {}
    type_name = var.type
    typed, trimmed = values.cast_typed(raw, source, type_name)
    dtype = var.storage_type
    if type_name is None and var.unit is not None:
        typed = _numeric(raw, source).cast("double")
    elif type_name is None:
        dtype = source
    if type_name is not None:
        checks["trimmed"] = trimmed
    elif var.unit is not None and isinstance(source, T.StringType):
        checks["unparsable"] = F.coalesce(raw.isNotNull() & typed.isNull(), F.lit(False))
    value = values.na_normalize(typed, dtype, var.na_value, type_name)
    if var.unit is not None and not isinstance(dtype, T.StringType):
        converted = units.convert_unit(value, var.source_unit, var.unit)
        value = converted if isinstance(dtype, values.FLOATS) else converted.cast(dtype)
    return Expression(value, value.isNotNull(), checks)


def _apply_interval(exprs: dict[str, Expression], variables: list[Variable]) -> dict[str, Column]:
    """Out-of-range condition of each variable with an interval."""
    bad = {}
    for var in variables:
        if var.interval is None:
            continue
        low, high = _bounds(var)
        if (low, high) == (-math.inf, math.inf):
            continue
        bad[var.name] = values.out_of_interval(exprs[var.name].value, low, high)
    return bad


def definitions(schema: NodeSchema) -> list[Variable]:
    """Plain coordinates first, then variables (components of composed coordinates included)."""
    return [c for c in schema.coords.values() if not c.is_composed] + list(schema.vars.values())


def harmonize(
    df: DataFrame,
    schema: NodeSchema,
    order: str | None = None,
    out_of_range: str = "null_cell",
    strict: bool = False,
    dictionaries: dict[str, DataFrame] | None = None,
) -> Harmonized:
    """Project ``df`` onto the schema and drop rows with a missing coordinate.

    ``order`` names the column that decides which of two rows for one cell is later. A missing source
    column gives a NULL column and is reported, or raises with ``strict``. ``out_of_range``: ``null_cell``
    blanks the value, ``reject_column`` blanks the whole column of this batch when any value is bad,
    ``fail`` raises when the rows are read. ``dictionaries``: (label, code) of the variables whose labels the schema has in a table.
    """
    if out_of_range not in POLICIES:
        raise ValueError(f"out_of_range must be one of {POLICIES}")
    types = {f.name: f.dataType for f in df.schema.fields}
    defs = definitions(schema)
    missing = [v.name for v in defs if v.df_col not in types]
    if missing and strict:
        raise SchemaError(f"source columns not found for {missing}; the table has {sorted(types)}")
    lacking = [v.name for v in defs if v.label_table is not None and v.name not in (dictionaries or {}) and v.df_col in types]
    if lacking:
        raise SchemaError(f"no label table given for {lacking}")
    df = with_codes(df, defs, dictionaries or {})
    exprs = {v.name: variable_expression(v, types.get(v.df_col)) for v in defs}
    bad = _apply_interval(exprs, defs)
    flags = {f"{n}|{kind}": cond for n, e in exprs.items() for kind, cond in e.checks.items()}
    flags |= {f"{n}|out_of_range": cond for n, cond in bad.items()}

    out = {}
    rejected = None
    if out_of_range == "reject_column" and bad:
        # one-row aggregate, read back as a scalar subquery
        counts = df.agg(*[F.count_if(cond).alias(n) for n, cond in bad.items()])
        rejected = counts.select(F.struct(*counts.columns).alias("s")).scalar()
    for var in defs:
        value = exprs[var.name].value
        if var.name in bad:
            if out_of_range == "null_cell":
                value = F.when(~bad[var.name], value)
            elif out_of_range == "fail":
                stop = F.raise_error(F.concat(F.lit(f"{var.name} out of range: "), value.cast("string")))
                value = F.when(~bad[var.name], value).otherwise(stop.cast(var.storage_type))
        out[var.name] = value
    key_columns = [key for coord in schema.coords.values() for key in coord.keys]
    source = df
    for var in defs:
        if var.name in key_columns and var.df_col in types and not var.is_coded:
            # a missing source value gives no key; said on the raw column, the test reaches the file scan
            source = source.where(F.col(f"`{var.df_col}`").isNotNull())
    columns = [c.alias(n) for n, c in out.items()]
    if order is not None:
        columns.append(F.col(order).alias(SEQ))
    if rejected is not None:
        staged = source.select(*columns, rejected.alias("_rejected"))
        columns = [
            F.when(F.col("_rejected")[n] == 0, F.col(n)).alias(n) if n in bad else F.col(n)
            for n in staged.columns
            if n != "_rejected"
        ]
        cells = staged.select(*columns)
    else:
        cells = source.select(*columns)
    cells = drop_missing_keys(cells, key_columns)
    return Harmonized(cells, quality_report(df, flags, exprs, key_columns, missing), missing)


def drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose every coordinate (every component of a composed one) is present."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def quality_report(
    df: DataFrame, flags: dict[str, Column], exprs: dict[str, Expression], keys: list[str], missing: list[str]
) -> DataFrame:
    """(variable, problem, rows): one aggregate over the source, then unpivoted. Zero counts are left out."""
    aggs = {name: F.count_if(cond) for name, cond in flags.items()}
    aggs |= {f"{k}|missing_key": F.count_if(exprs[k].value.isNull()) for k in keys if k not in missing}
    aggs |= {f"{n}|missing_column": F.count(F.lit(1)) for n in missing}
    if not aggs:
        return df.sparkSession.createDataFrame([], "variable string, problem string, rows bigint")
    row = df.agg(*[agg.alias(name) for name, agg in aggs.items()])
    entries = F.array(*[
        F.struct(
            F.lit(name.rsplit("|", 1)[0]).alias("variable"),
            F.lit(name.rsplit("|", 1)[1]).alias("problem"),
            F.col(f"`{name}`").alias("rows"),
        )
        for name in aggs
    ])
    return row.select(F.inline(entries)).where(F.col("rows") > 0)


def label_table(source: DataFrame, column: str, start: int = 1) -> DataFrame:
    """Label list from a table column: distinct labels in ascending order with 1-based codes."""
    distinct = source.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return with_position(distinct, ["label"], "code").withColumn("code", F.col("code") + F.lit(start))


def encode_with_table(df: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    """Label to code through a (label, code) table; Spark picks the join from the table's size."""
    table = labels.select(F.col("label").alias(column), F.col("code").alias(out))
    return df.join(table, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))


def decode_with_table(df: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    table = labels.select(F.col("code").alias(column), F.col("label").alias(out))
    return df.join(table, column, "left")


def numeric_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Cast every column but ``keep`` to double; text that is no number becomes NULL."""
    return df.select(*[F.col(c) if c in keep else values.safe_double(F.col(c)).alias(c) for c in df.columns])


def finite_export(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns to NULL."""
    return df.select(*[
        values.finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, values.FLOATS) else F.col(f.name)
        for f in df.schema.fields
    ])


def quantity_columns(schema: NodeSchema, exclude: tuple[str, ...] = ("lat", "lon", "latitude", "longitude", "x", "y")) -> list[str]:
    """Names of the variables that are measured quantities, not positions or key parts."""
    parts = schema.component_names()
    return [n for n in schema.vars if n not in parts and n.lower() not in exclude]


def select_role(df: DataFrame, schema: NodeSchema, role: str) -> DataFrame:
    """Keep the ``coords`` or the ``quantities`` of a frame."""
    if role not in ("coords", "quantities"):
        raise ValueError("role is 'coords' or 'quantities'")
    keys = schema.keys_of(tuple(schema.coords))
    names = keys if role == "coords" else quantity_columns(schema)
    return df.select(*[n for n in names if n in df.columns])
