"""Tables of request parameters and per-location fan-out. The requests themselves are not made here."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubemerge.functions.text import render_template
from cubemerge.operators.select import required_columns


class ContextError(ValueError):
    """A variable is defined twice, or a required column is missing."""


def parameter_contexts(rows: DataFrame, constants: dict[str, Any], schema_values: dict[str, list[Any]],
                       outputs: dict[str, str], unique: bool = False) -> DataFrame:
    """Every row combined with the constants and with every combination of the schema values.

    Constants and schema values are short lists from configuration, so they are exploded as literals per row.
    ``outputs`` maps variable to column; rows where one of these is missing or blank are left out (see
    operators.select.required_columns for the rejected ones).
    """
    names = list(constants) + list(schema_values) + list(outputs)
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ContextError(f"variables defined twice: {twice}")
    absent = [c for c in outputs.values() if c not in rows.columns]
    if absent:
        raise ContextError(f"required columns {absent} not in {rows.columns}")
    complete, _ = required_columns(rows, list(outputs.values()))
    out = complete.select(
        *[F.col(c).alias(n) for n, c in outputs.items()], *[F.lit(v).alias(n) for n, v in constants.items()]
    )
    for name, values in schema_values.items():
        listed = list(dict.fromkeys(values)) if unique else values
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in listed])))
    return out


def render(contexts: DataFrame, template: str) -> Column:
    """A template filled from the context's own columns."""
    return render_template(template, {c: F.col(c) for c in contexts.columns})


def per_location(locations: DataFrame, payload_rows: DataFrame, key: str) -> DataFrame:
    """Extracted rows of all locations with the location's columns."""
    return payload_rows.join(locations, key)
