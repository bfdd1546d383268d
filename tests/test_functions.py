"""Units, date-times, values and text rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cubemerge.functions import datetimes, geo, text, units, values
from cubemerge.schema import DateTimeUnit, NodeSchema, SchemaError, StepLimits, spark_type
from cubemerge.operators import harmonize as hz


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_unit_conversion():
    assert units.convert_value(20.0, "degC", "K") == pytest.approx(293.15)
    assert units.convert_value(212.0, "degF", "degC") == pytest.approx(100.0)
    assert units.convert_value(1.0, "g/m^3", "kg/m**3") == pytest.approx(1e-3)
    assert units.convert_value(1013.25, "hPa", "Pa") == pytest.approx(101325.0)
    assert units.convert_value(36.0, "km/h", "m/s") == pytest.approx(10.0)
    assert units.convert_value(50.0, "percent", "") == pytest.approx(0.5)
    assert units.conversion("m", "m") == (1.0, 0.0)
    for source, target in (("Pa", "m"), ("bool", ""), ("nonsense", "m")):
        with pytest.raises(units.UnitError):
            units.conversion(source, target)


@pytest.mark.parametrize("written, source, expected", [
    ("2025-05-13T08:00:00", DateTimeUnit("s", "UTC"), datetime(2025, 5, 13, 8)),
    ("2025-05-13T08:00:00", DateTimeUnit("s", "CET"), datetime(2025, 5, 13, 7)),
    ("2025-05-13T08:00:00Z", DateTimeUnit("s", "CET"), datetime(2025, 5, 13, 8)),
    ("2025-05-13 08:00:00+03:30", DateTimeUnit("s", "CET"), datetime(2025, 5, 13, 4, 30)),
    ("2025-05-13 08:00:00 EST", DateTimeUnit("s"), datetime(2025, 5, 13, 13)),
    ("2025-07-01 12:00:00", DateTimeUnit("s", "Europe/Prague"), datetime(2025, 7, 1, 10)),
    ("13.5.2025 8:01", DateTimeUnit("s", dayfirst=True), datetime(2025, 5, 13, 8, 1)),
    ("05/06/2025", DateTimeUnit("s"), datetime(2025, 5, 6)),
    ("05/06/2025", DateTimeUnit("s", dayfirst=True), datetime(2025, 6, 5)),
    ("25/06/2025", DateTimeUnit("s"), datetime(2025, 6, 25)),
    ("2025-05-13T08:00:59.75", DateTimeUnit("s"), datetime(2025, 5, 13, 8, 0, 59)),
    ("2 OCT 2024 01:02:03.5", DateTimeUnit("ms"), datetime(2024, 10, 2, 1, 2, 3)),
    ("20240102T101112", DateTimeUnit("s"), datetime(2024, 1, 2, 10, 11, 12)),
    ("20240102", DateTimeUnit("s"), datetime(2024, 1, 2)),
    ("2024/1/2 1:02", DateTimeUnit("s"), datetime(2024, 1, 2, 1, 2)),
    ("2024-01-01 12:00:00+03", DateTimeUnit("s"), datetime(2024, 1, 1, 9)),
    ("2024-01-01 12:00:00 EAT", DateTimeUnit("s"), datetime(2024, 1, 1, 9)),
    ("2024-01-01 12:00:00 SAST", DateTimeUnit("s"), datetime(2024, 1, 1, 10)),
    ("2024-01-01 12:00:00 XQZ", DateTimeUnit("s"), None),
    ("2024-01-01 3:05 PM", DateTimeUnit("s"), datetime(2024, 1, 1, 15, 5)),
    ("2024-01-01 12:10:00 am", DateTimeUnit("s"), datetime(2024, 1, 1, 0, 10)),
    ("Mon, 01 Jan 2024 12:00:00 +0100", DateTimeUnit("s"), datetime(2024, 1, 1, 11)),
    ("Mon, 01 Jan 2024 12:00:00 GMT", DateTimeUnit("s"), datetime(2024, 1, 1, 12)),
    ("12:30 2024-01-01", DateTimeUnit("s"), datetime(2024, 1, 1, 12, 30)),
    ("2024-05", DateTimeUnit("s"), datetime(2024, 5, 1)),
    ("5/3/99", DateTimeUnit("s"), datetime(1999, 5, 3)),
    ("5/3/24 1:00", DateTimeUnit("s", dayfirst=True), datetime(2024, 3, 5, 1)),
    ("NaT", DateTimeUnit("s"), None),
    ("yesterday", DateTimeUnit("s"), None),
    ("2025-13-40", DateTimeUnit("s"), None),
])
def test_parse_datetime(spark, written, source, expected):
    assert one(spark, datetimes.parse_datetime(F.lit(written), source, DateTimeUnit("s", "UTC"))) == expected


def test_ticks_floor_before_epoch(spark):
    ts = F.lit("1969-12-31 23:30:00").cast("timestamp_ntz")
    got = one(spark, datetimes.to_epoch_ticks(ts, "h"), datetimes.to_epoch_ticks(ts, "us"), datetimes.truncate_tick(ts, "D"),
              datetimes.from_epoch_ticks(F.lit(-1), "D"))
    assert got == (-1, -1_800_000_000, datetime(1969, 12, 31), datetime(1969, 12, 31))


def cast(spark, value, sql_type, target):
    df = spark.range(1).select(F.lit(value).cast(sql_type).alias("c"))
    out, trimmed = values.cast_typed(F.col("c"), df.schema["c"].dataType, target)
    return tuple(df.select(out.alias("v"), trimmed.alias("t")).first())


def test_cast_typed(spark):
    assert cast(spark, 3.7, "double", "int32") == (3, True)
    assert cast(spark, -3.7, "double", "int64") == (-3, True)
    assert cast(spark, 3.0, "double", "int8") == (3, False)
    assert cast(spark, 300, "int", "int8") == (None, True)
    assert cast(spark, -1, "int", "uint8") == (None, True)
    assert cast(spark, 2**62, "bigint", "int64") == (2**62, False)
    assert cast(spark, "abcdef", "string", "str[4]") == ("abcd", True)
    assert cast(spark, "12.5", "string", "float64") == (12.5, False)
    assert cast(spark, "x", "string", "float64") == (None, False)
    assert cast(spark, 0.1, "double", "float32")[1] is True
    value, trimmed = cast(spark, 2.5, "double", "complex")
    assert (value["re"], value["im"], trimmed) == (2.5, 0.0, False)


def test_missing_values(spark):
    norm = lambda v, t, na=None, name=None: one(spark, values.na_normalize(F.lit(v).cast(t), spark_type(name), na, name))
    assert norm(float("nan"), "double", name="float64") is None
    assert norm(-1.0, "double", -1.0, "float64") is None
    assert norm(2**31 - 1, "int", "max_int", "int32") is None
    assert norm(-1, "int", None, "int32") == -1
    assert norm("￿￿", "string", None, "str[2]") is None


def test_labels_round_trip(spark):
    df = spark.createDataFrame([("red",), ("green",), ("unknown",), ("blue",), (None,)], "c string")
    labels = ("red", "green", "blue")
    coded = df.select(values.encode_labels(F.col("c"), labels).alias("k"))
    assert [r["k"] for r in coded.collect()] == [1, 2, 0, 3, 0]
    back = coded.select(values.decode_labels(F.col("k"), labels).alias("c"))
    assert [r["c"] for r in back.collect()] == ["red", "green", None, "blue", None]


def test_text_rules(spark):
    lit = F.lit
    assert one(spark, text.depth_label(lit("15mA")), text.depth_label(lit("15mB")), text.depth_label(lit("0.05m")), text.depth_label(lit("name"))) == ("15.1", "15.2", "0.05", "name")
    assert one(spark, text.is_depth_key(lit("10m")), text.is_depth_key(lit("15mC"))) == (True, False)
    assert one(spark, text.first_number(lit("U = -3.7 V")), text.first_number(lit("no 42")), text.first_number(lit("none"))) == ("-3.7", "42", "0")
    assert one(spark, *text.split_lat_lon(lit("50.1, 14.2"))) == (50.1, 14.2)
    assert one(spark, *text.split_lat_lon(lit("50.1"))) == (None, None)
    kinds = {"application/json": "json", "text/csv": "csv", "application/x-grib+bz2": "grib_bz2", "application/x-grib": "grib",
             "application/octet-stream": "octet-stream", "text/html": None}
    assert one(spark, *[text.content_kind(lit(k)) for k in kinds]) == tuple(kinds.values())
    assert one(spark, text.content_type_of(lit("http://h/a.GRB2.bz2?x=1"), lit("text/html")), text.content_type_of(lit("http://h/a"), lit("Text/HTML"))) == ("application/x-grib+bz2", "text/html")
    path, valid = text.clean_node_path(lit("  //a/b "))
    assert one(spark, path, valid, text.clean_node_path(lit("a/../b"))[1], text.clean_node_path(lit("/"))[0]) == ("a/b", True, False, None)
    assert one(spark, text.render_template("a/{x}?{y}", {"x": lit(1), "y": lit("q")})) == "a/1?q"
    with pytest.raises(KeyError):
        text.render_template("{z}", {})


def test_mercator_and_probe(spark):
    x, y = geo.web_mercator(F.lit(180.0), F.lit(89.0))
    got = one(spark, x, y, geo.zoom_span(F.lit(1)))
    assert got == pytest.approx((20037508.3428, 20037508.3428, 20037508.3428), rel=1e-6)


def test_schema_rules():
    with pytest.warns(UserWarning):
        schema = NodeSchema.from_dict({
            "COORDS": {"t": {"merge": {"step_limits": [1, 2]}, "sorted": "None"}, "p": {"composed": ["a", "b"]}},
            "VARS": {"v": {"coords": ["t", "p", "extra"], "unit": "K"}, "a": {"coords": "p", "type": "float64"}, "b": {"coords": "p", "type": "float64"}},
        })
    assert schema.coords["t"].step_limits == StepLimits("limits", 1, 2, None) and schema.coords["t"].sorted
    assert not schema.coords["p"].sorted and schema.coords["p"].keys == ("a", "b")
    assert list(schema.coords) == ["t", "p", "extra"]
    assert schema.keys_of(("t", "p")) == ["t", "a", "b"]
    assert [v.name for v in schema.cubes()[("t", "p", "extra")]] == ["v"]
    for bad in ({"step_limits": [3, 1]}, {"step_limits": "sometimes"}, {"type": "decimal"}):
        with pytest.raises(SchemaError):
            NodeSchema.from_dict({"COORDS": {"t": bad}})


def test_out_of_range_policies(spark):
    spec = {"COORDS": {"i": {"type": "int64"}}, "VARS": {"v": {"unit": "degC", "source_unit": "K", "coords": ["i"], "range": {"interval": [273.15, 283.15, "K"]}}}}
    schema = NodeSchema.from_dict(spec)
    df = spark.createDataFrame([(1, 275.0), (2, 300.0), (3, None)], "i long, v double")
    read = lambda policy: {r["i"]: r["v"] for r in hz.harmonize(df, schema, out_of_range=policy).cells.collect()}
    # the bounds are given in another unit than the variable's
    assert read("null_cell") == {1: pytest.approx(1.85), 2: None, 3: None}
    assert read("reject_column") == {1: None, 2: None, 3: None}
    with pytest.raises(Exception, match="out of range"):
        read("fail")
