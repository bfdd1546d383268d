"""Date-time parsing, zone shifts and ticks. All values are TIMESTAMP_NTZ; the session zone must be UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubemerge.schema import DateTimeUnit

# Zone abbreviations with one meaning, in minutes east of UTC. Summer-time names keep their
# own fixed offset; ambiguous ones (IST, CST, BST, AST ...) are left out on purpose.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EST": -300, "EDT": -240, "MDT": -360, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "JST": 540, "KST": 540, "HKT": 480, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "NZST": 720, "NZDT": 780, "WAT": 60, "CAT": 120, "SAST": 120, "EAT": 180, "PKT": 300, "NPT": 345, "ICT": 420,
    "WIB": 420, "WITA": 480, "WIT": 540, "PHT": 480, "SGT": 480, "NST": -210, "NDT": -150, "ADT": -180, "ART": -180, "BRT": -180,
    "CLT": -240, "COT": -300, "PET": -300, "UYT": -180, "VET": -240, "CHST": 600, "SST": -660,
}

# Tick name -> date_trunc unit and length in microseconds.
TICKS = {
    "D": ("DAY", 86_400_000_000),
    "h": ("HOUR", 3_600_000_000),
    "m": ("MINUTE", 60_000_000),
    "s": ("SECOND", 1_000_000),
    "ms": ("MILLISECOND", 1_000),
    "us": ("MICROSECOND", 1),
    "ns": ("MICROSECOND", 1),
}

# Month names accepted in dates.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_OFFSET = re.compile(r"([+-])(\d{2}):?(\d{2})$")
_ZONE_TAIL = r":\d\d(?:\.\d+)?\s*(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?)$"
# cheap test before the exact one
_ZONE_END = r"[A-Z]$|[+-]\d{2}(?::?\d{2})?$"
# written forms brought into the order of the others first: weekday names, time before date, 12-hour clock
_WEEKDAY = r"^[A-Za-z]{3,9},\s*(?=\d)"
_TIME_FIRST = r"^(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?),?\s+(\S.*\d)$"
_TWELVE = r"(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([AaPp])[Mm]"
_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$"


def fixed_minutes(zone: str | None) -> int | None:
    """Offset of a fixed zone, or None when the zone has rules of its own."""
    if zone is None:
        return 0
    if zone in ZONE_MINUTES:
        return ZONE_MINUTES[zone]
    match = _OFFSET.match(zone)
    if match:
        sign = 1 if match.group(1) == "+" else -1
        return sign * (int(match.group(2)) * 60 + int(match.group(3)))
    return None


def shift_minutes(col: Column, minutes: int | Column) -> Column:
    """Add minutes (literal or column) to a zone-less timestamp."""
    if isinstance(minutes, int) and minutes == 0:
        return col
    value = F.lit(minutes) if isinstance(minutes, int) else minutes
    return col + F.make_dt_interval(mins=value.cast("int"))


def to_utc(col: Column, zone: str | None) -> Column:
    """Local time in ``zone`` to UTC; named zones follow their own rules."""
    minutes = fixed_minutes(zone)
    if minutes is None:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), col)
    return shift_minutes(col, -minutes)


def from_utc(col: Column, zone: str | None) -> Column:
    minutes = fixed_minutes(zone)
    if minutes is None:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), col)
    return shift_minutes(col, minutes)


def convert_timezone(col: Column, source: str | None, target: str | None) -> Column:
    return col if source == target else from_utc(to_utc(col, source), target)


def truncate_tick(col: Column, tick: str) -> Column:
    """Drop the part of a timestamp below ``tick``; nanoseconds are kept as microseconds."""
    unit, micros = TICKS[tick]
    return col if micros == 1 else F.date_trunc(unit, col).cast("timestamp_ntz")


def _floor_div(col: Column, length: int) -> Column:
    """Exact floor division of a long column by a positive constant."""
    return F.call_function("div", col - F.pmod(col, F.lit(length)), F.lit(length))


def to_epoch_ticks(col: Column, tick: str) -> Column:
    """Whole ticks since 1970-01-01 (floor, also before 1970)."""
    micros = F.unix_micros(col.cast("timestamp"))
    if tick == "ns":
        return micros * F.lit(1000)
    length = TICKS[tick][1]
    return micros if length == 1 else _floor_div(micros, length)


def from_epoch_ticks(col: Column, tick: str) -> Column:
    ticks = col.cast("long")
    micros = _floor_div(ticks, 1000) if tick == "ns" else ticks * F.lit(TICKS[tick][1])
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def add_duration(col: Column, seconds: float, tick: str = "us") -> Column:
    """Shift timestamps by a number of seconds, result truncated to ``tick``."""
    micros = int(seconds * 1_000_000)
    whole, rest = divmod(micros, 60_000_000)
    shifted = col + F.make_dt_interval(mins=F.lit(whole), secs=F.lit(rest / 1_000_000))
    return truncate_tick(shifted, tick)


# --- parsing -------------------------------------------------------------------------------------------
#
# The parser is one SQL lambda applied to the column. Written out as Column objects it would be several hundred
# calls into the JVM each time a plan is built, and parts used twice would be computed twice per row.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _stamp(year: str, month: str, day: str) -> str:
    """Timestamp from the tokens ``p`` of a split text; tokens 3.. are the optional time of day."""
    part = lambda i: f"coalesce(get(p, {i}), '0')"
    number = lambda i: f"try_cast({part(i)} AS INT)"
    second = f"try_cast(concat({part(5)}, '.', {part(6)}) AS DECIMAL(16,6))"
    return f"try_make_timestamp_ntz({year}, {month}, {day}, {number(3)}, {number(4)}, {second})"


def _token(i: int) -> str:
    return f"try_cast(get(p, {i}) AS INT)"


def _month_name(i: int) -> str:
    names = ", ".join(f"'{m}'" for m in _MONTHS)
    return f"CAST(array_position(array({names}), lower(substring(get(p, {i}), 1, 3))) AS INT)"


def _form(text: str, pattern: str, build: str) -> str:
    """One written form: checked by one pattern, cut by one split."""
    tokens = f"split({text}, r'[-./,: ]+|(?<=[0-9])T(?=[0-9])')"
    return f"CASE WHEN {text} RLIKE r'{pattern}' THEN {_let(tokens, 'p', build)} END"


def _local_sql(text: str, dayfirst: bool) -> str:
    """Zone-less timestamp of a text without zone part; NULL when no known form fits."""
    a, b = _token(0), _token(1)
    day, month = (a, b) if dayfirst else (b, a)
    # the two first numbers change places when only that gives a month
    year_last = _stamp(_token(2), f"if({month} <= 12, {month}, {day})", f"if({month} <= 12, {day}, {month})")
    compact = rf"regexp_replace({text}, r'^(\d\d\d\d)(\d\d)(\d\d)[T ]?', '$1-$2-$3 ')"
    clock = rf"rtrim(regexp_replace({compact}, r' (\d\d)(\d\d)(\d\d)?$', ' $1:$2:$3'))"
    # fixed rule for years of two digits: 69 to 99 are of the last century
    short = f"({_token(2)} + if({_token(2)} < 69, 2000, 1900))"
    short_year = _stamp(short, f"if({month} <= 12, {month}, {day})", f"if({month} <= 12, {day}, {month})")
    # a text has one of these forms at most; the commonest comes first
    forms = [
        f"CASE WHEN {text} RLIKE r'^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}' THEN try_cast({text} AS TIMESTAMP_NTZ) END",
        _form(text, r"^\d{1,2}[-./]\d{1,2}[-./]\d{2}" + _TIME, short_year),
        _form(text, r"^\d{4}-\d{1,2}$", f"try_make_timestamp_ntz({_token(0)}, {_token(1)}, 1, 0, 0, 0)"),
        _form(text, r"^\d{1,2}[-./]\d{1,2}[-./]\d{4}" + _TIME, year_last),
        _form(text, r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}" + _TIME, _stamp(_token(0), _token(1), _token(2))),
        _form(text, r"^\d{1,2}[ -][A-Za-z]{3,9}[ ,-]+\d{4}" + _TIME, _stamp(_token(2), _month_name(1), _token(0))),
        _form(text, r"^[A-Za-z]{3,9} \d{1,2},? \d{4}" + _TIME, _stamp(_token(2), _month_name(0), _token(1))),
        rf"CASE WHEN {text} RLIKE r'^\d{{8}}([T ]?\d{{4}}(\d\d)?)?$' THEN try_cast(rtrim(':', {clock}) AS TIMESTAMP_NTZ) END",
    ]
    return f"coalesce({', '.join(forms)})"


def _shift_sql(value: str, minutes: str) -> str:
    return f"({value} + make_dt_interval(0, 0, {minutes}, 0))"


def _zone_sql(value: str, source: str | None, target: str | None) -> str:
    """Local time in ``source`` to local time in ``target``."""
    if source == target:
        return value
    a, b = fixed_minutes(source), fixed_minutes(target)
    if a is not None and b is not None:
        return value if a == b else _shift_sql(value, str(b - a))
    name = lambda z, m: z if m is None else ("UTC" if m == 0 else f"{'+' if m > 0 else '-'}{abs(m) // 60:02d}:{abs(m) % 60:02d}")
    return f"convert_timezone('{name(source, a)}', '{name(target, b)}', {value})"


def _tick_sql(value: str, tick: str) -> str:
    unit, micros = TICKS[tick]
    return value if micros == 1 else f"CAST(date_trunc('{unit}', {value}) AS TIMESTAMP_NTZ)"


def _apply(col: Column, name: str, body: str) -> Column:
    """The SQL lambda ``name -> body`` applied to one value."""
    return F.get(F.call_function("transform", F.array(col), F.expr(f"{name} -> {body}")), F.lit(0))


def parse_datetime(col: Column, source: DateTimeUnit, target: DateTimeUnit | None = None) -> Column:
    """Free-form text to a timestamp in the target's zone and tick.

    Text without a zone is local time of ``source.tz``; an explicit offset or abbreviation wins over it.
    "NaT" and text that fits no known form give NULL.
    """
    target = target or source

    def in_target(value: str, zone: str | None) -> str:
        in_source = _tick_sql(_zone_sql(value, zone, source.tz or "UTC"), source.tick)
        return _tick_sql(_zone_sql(in_source, source.tz or "UTC", target.tz or "UTC"), target.tick)

    naive = in_target(_local_sql("t", source.dayfirst), source.tz or "UTC")
    table = ", ".join(f"'{k}', {v}" for k, v in ZONE_MINUTES.items())
    digits = "replace(z, ':', '')"
    minutes = (
        f"CASE WHEN z RLIKE r'^[+-]' THEN if(startswith(z, '-'), -1, 1) * (CAST(substring({digits}, 2, 2) AS INT) * 60"
        f" + coalesce(try_cast(substring({digits}, 4, 2) AS INT), 0)) ELSE try_element_at(map({table}), z) END"
    )
    pair = f"struct({_local_sql('b', source.dayfirst)} AS at, {minutes} AS off)"
    # a zone nobody knows makes the time unknown
    given = f"CASE WHEN q.off IS NOT NULL THEN {in_target(_shift_sql('q.at', '-q.off'), 'UTC')} END"
    zoned = _let("rtrim(substring(t, 1, length(t) - length(z)))", "b", _let(pair, "q", given))
    split_zone = _let(f"regexp_extract(t, r'{_ZONE_TAIL}', 1)", "z", f"CASE WHEN z = '' THEN {naive} ELSE {zoned} END")
    # a quick test first: only a text with a time of day can end in a zone
    body = f"CASE WHEN t RLIKE r'{_ZONE_END}' THEN {split_zone} ELSE {naive} END"
    hour = f"(try_cast(regexp_extract(w, r'{_TWELVE}', 1) AS INT) % 12 + if(lower(regexp_extract(w, r'{_TWELVE}', 3)) = 'p', 12, 0))"
    clock = f"CASE WHEN w RLIKE r'{_TWELVE}' THEN regexp_replace(w, r'{_TWELVE}', concat(lpad({hour}, 2, '0'), '$2')) ELSE w END"
    ordered = f"regexp_replace(regexp_replace(v, r'{_WEEKDAY}', ''), r'{_TIME_FIRST}', '$2 $1')"
    return _apply(F.trim(col), "v", _let(ordered, "w", _let(clock, "t", body)))


def convert_datetime(col: Column, source: DateTimeUnit, target: DateTimeUnit) -> Column:
    """Timestamp column given in the source unit to the target unit."""
    return truncate_tick(convert_timezone(truncate_tick(col, source.tick), source.tz, target.tz), target.tick)


def parse_logger_time(col: Column) -> Column:
    """Logger files: ``dd-MM-yyyy HH:mm:ss``, ISO, or epoch milliseconds; anything else NULL."""
    forms = [
        _form("t", r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$", _stamp(_token(2), _token(1), _token(0))),
        r"CASE WHEN t RLIKE r'^\d\d\d\d-\d\d-\d\d' THEN try_cast(t AS TIMESTAMP_NTZ) END",
        r"CASE WHEN t RLIKE r'^-?\d+$' THEN CAST(timestamp_millis(try_cast(t AS BIGINT)) AS TIMESTAMP_NTZ) END",
    ]
    return _apply(F.trim(col), "t", f"coalesce({', '.join(forms)})")


def epoch_millis(col: Column) -> Column:
    """Epoch milliseconds to UTC time."""
    return F.timestamp_millis(col).cast("timestamp_ntz")
