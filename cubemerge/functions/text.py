"""Text rules of the contributed files and messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Depth column names that are rock temperatures, and the two labels of one doubled depth.
DEPTH_KEY = r"^(\d+(\.\d+)?m|15m[AB])$"
DOUBLED_DEPTH = {"15mA": "15.1", "15mB": "15.2"}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def is_depth_key(col: Column) -> Column:
    return col.rlike(DEPTH_KEY)


def depth_label(col: Column) -> Column:
    """``0.05m`` -> ``0.05``; the doubled depth gets two labels; other text is kept."""
    out = F.when(col == "15mA", DOUBLED_DEPTH["15mA"]).when(col == "15mB", DOUBLED_DEPTH["15mB"])
    return out.otherwise(F.regexp_replace(col, "m$", ""))


def first_number(col: Column) -> Column:
    """First signed decimal in a text, else its first digits, else "0"."""
    decimal = F.regexp_extract(col, r"([-+]?\d*\.\d+|\d+)", 1)
    return F.when(decimal != "", decimal).otherwise(F.lit("0"))


def split_lat_lon(col: Column) -> tuple[Column, Column]:
    """``"lat, lon"`` to two doubles; NULL when there are not exactly two numbers."""
    parts = F.split(col, ",")
    number = lambda i: F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    return number(0), number(1)


def render_template(template: str, columns: dict[str, Column]) -> Column:
    """``{name}`` placeholders replaced by columns; NULL when a used column is NULL."""
    parts, pos = [], 0
    for match in _PLACEHOLDER.finditer(template):
        if match.group(1) not in columns:
            raise KeyError(f"template variable {match.group(1)!r} is not defined")
        if match.start() > pos:
            parts.append(F.lit(template[pos:match.start()]))
        parts.append(columns[match.group(1)].cast("string"))
        pos = match.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def content_kind(content_type: Column) -> Column:
    """Payload kind from a content type; the order of the tests matters. NULL when none fits."""
    ct = F.lower(content_type)
    grib = ct.contains("grib") | ct.contains("grb")
    packed = ct.contains("bz2") | ct.contains("bzip2")
    return (
        F.when(ct.contains("json"), "json")
        .when(ct.contains("csv"), "csv")
        .when(grib & packed, "grib_bz2")
        .when(grib, "grib")
        .when(ct.contains("octet-stream"), "octet-stream")
    )


def content_type_of(url: Column, declared: Column) -> Column:
    """Declared content type unless the URL's suffix says it is a GRIB file."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(path.rlike(r"\.(grib2?|grb2?)\.bz2$"), "application/x-grib+bz2")
        .when(path.rlike(r"\.(grib2?|grb2?)$"), "application/x-grib")
        .otherwise(F.lower(F.coalesce(declared, F.lit(""))))
    )


def clean_node_path(path: Column) -> tuple[Column, Column]:
    """(path, valid): surrounding blanks and leading slashes removed; any ``..`` segment is invalid."""
    clean = F.regexp_replace(F.trim(path), "^/+", "")
    climbs = F.exists(F.split(clean, "/"), lambda p: p == "..")
    return F.nullif(clean, F.lit("")), ~F.coalesce(climbs, F.lit(False))


def parse_log_line(line: Column) -> dict[str, Column]:
    """timestamp, level and message of a ``<timestamp> ... level=X ... message=...`` line.

    The level is error, warning or info; without ``message=`` the message is the rest of the line. All parts
    of a blank line are NULL.
    """
    text = F.nullif(F.trim(line), F.lit(""))
    rest = F.when(text.contains(" "), F.regexp_replace(text, r"^\S+ ", "")).when(text.isNotNull(), "")
    level = F.lower(F.regexp_extract(rest, r"(?i)(?:^|\s)level=(\S*)", 1))
    kind = F.when(level == "error", "error").when(level.isin("warn", "warning"), "warning").when(level.isNotNull(), "info")
    message = F.when(rest.contains("message="), F.regexp_replace(rest, r"^(?s).*?message=", "")).otherwise(rest)
    return {"timestamp": F.substring_index(text, " ", 1), "level": kind, "message": message}


def glob_to_regex(pattern: str) -> str:
    """Shell pattern on whole node paths: ``*`` any text (also across levels), ``?`` one character."""
    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"
