"""Casts, missing values, labels and range checks as column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.schema import COMPLEX, INT_BOUNDS, spark_type, text_length

# Labels kept as a literal array in the plan; larger sets go through the join form in operators.harmonize.

FLOATS = (T.DoubleType, T.FloatType)


def finite_or_null(col: Column) -> Column:
    """NaN and infinities to NULL; for export and for aggregates that must skip them."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), col)


def is_finite(col: Column) -> Column:
    return finite_or_null(col).isNotNull()


def safe_double(col: Column) -> Column:
    """Text or number to double, NULL when not a number."""
    return finite_nan(col.try_cast("double"))


def finite_nan(col: Column) -> Column:
    """NaN to NULL, infinities kept."""
    return F.when(~F.isnan(col), col)


def na_literal(na_value: Any, type_name: str | None) -> Any:
    """Sentinel as a Python value; ``max_int``/``min_int`` depend on the type, ``nan`` is covered by the NaN rule."""
    if na_value in ("max_int", "min_int"):
        bounds = INT_BOUNDS[type_name or "int"]
        return bounds[1] if na_value == "max_int" else bounds[0]
    if na_value is None or na_value == "nan" or (isinstance(na_value, float) and na_value != na_value):
        return None
    return na_value


def na_normalize(col: Column, dtype: T.DataType, na_value: Any = None, type_name: str | None = None) -> Column:
    """Every missing-value mark to NULL: NaN, the declared sentinel, and the U+FFFF filler of fixed-width text."""
    out = finite_nan(col) if isinstance(dtype, FLOATS) else col
    sentinel = na_literal(na_value, type_name)
    if sentinel is not None:
        out = F.nullif(out, F.lit(sentinel).cast(dtype))
    elif isinstance(dtype, T.StringType):
        out = F.when(~out.rlike("^￿+$"), out)
    return out


def _number(col: Column, source: T.DataType) -> Column:
    return col.try_cast("double") if isinstance(source, (T.StringType, T.BooleanType)) else col


def cast_typed(col: Column, source: T.DataType, type_name: str | None) -> tuple[Column, Column]:
    """(value, trimmed): the cast value, and whether the cast lost information.

    Integers out of range give NULL and count as trimmed; fractions are cut toward zero.
    """
    no = F.lit(False)
    if type_name is None:
        return col, no
    width = text_length(type_name) if type_name.startswith("str") else None
    if width is not None:
        text = col.cast("string")
        return F.substring(text, 1, width), F.coalesce(F.char_length(text) > width, no)
    if type_name in COMPLEX:
        part = COMPLEX[type_name]
        if isinstance(source, T.StructType):
            return F.struct(col["re"].cast(part).alias("re"), col["im"].cast(part).alias("im")), no
        return F.when(
            col.isNotNull(),
            F.struct(_number(col, source).cast(part).alias("re"), F.lit(0).cast(part).alias("im")),
        ), no
    if isinstance(source, T.StructType):
        # complex to real keeps the real part
        value, trimmed = cast_typed(col["re"], T.DoubleType(), type_name)
        return value, trimmed | F.coalesce(col["im"] != 0, no)
    target = spark_type(type_name)
    if isinstance(target, T.TimestampNTZType):
        return col.try_cast(target), no
    if type_name in INT_BOUNDS:
        low, high = INT_BOUNDS[type_name]
        exact = col.try_cast("decimal(38,6)")
        whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact))
        inside = whole.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
        value = F.when(inside, whole).cast(target)
        if isinstance(source, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = F.when(col.cast("decimal(20,0)").between(low, high), col).cast(target)
        return value, F.coalesce(~inside | (exact != whole), no)
    value = col.try_cast(target)
    if isinstance(target, T.FloatType) and isinstance(source, T.DoubleType):
        return value, F.coalesce(~F.isnan(col) & (value.cast("double") != col), no)
    return value, no


def encode_labels(col: Column, labels: tuple[Any, ...]) -> Column:
    """Label to its 1-based code; unknown and missing to 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), col), F.lit(0).cast("long"))


def decode_labels(code: Column, labels: tuple[Any, ...]) -> Column:
    """Code back to its label; 0 is missing."""
    return F.get(F.array(*[F.lit(x) for x in labels]), F.nullif(code, F.lit(0)).cast("int") - 1)


def out_of_interval(col: Column, low: Any, high: Any) -> Column:
    """True for a present value outside [low, high]; a missing value is never a violation."""
    return F.coalesce(~col.between(F.lit(low), F.lit(high)), F.lit(False))
