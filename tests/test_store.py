"""End-to-end updates of a store. Expected values follow from the rules: what is interpolated is computed here again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cubemerge.schema import NodeSchema, SchemaError
from cubemerge.sources.store import Store, copy_tree

# Water levels of a harbour: hours in steps of 2 to 6, spots given by two whole numbers, centimetres stored as metres.
LEVELS = {
    "ATTRS": {"place": "harbour"},
    "COORDS": {
        "hour": {"unit": {"tick": "h", "tz": "UTC"}, "source_unit": {"tick": "s", "tz": "UTC"}, "df_col": "read_at", "step_limits": [2, 6, "h"]},
        "spot": {"composed": ["pier", "gauge"], "sorted": False},
    },
    "VARS": {
        "level": {"unit": "m", "source_unit": "cm", "df_col": "cm", "coords": ["hour", "spot"]},
        "pier": {"type": "int64", "coords": ["spot"]},
        "gauge": {"type": "int64", "coords": ["spot"]},
    },
}
SPOTS = [(1, 7), (1, 9), (4, 7)]
MIDNIGHT = datetime(2031, 6, 2)
SENSORS = {
    "COORDS": {
        "at": {"unit": {"tick": "m", "tz": "UTC"}, "df_col": "stamp"},
        "sensor": {"type": "str[12]", "sorted": False},
    },
    "VARS": {"flow": {"type": "float64", "df_col": "litres", "coords": ["at", "sensor"]}},
}
_SERIES = {"COORDS": {"second": {"type": "int64"}}, "VARS": {"depth": {"type": "float64", "coords": ["second"]}}}
RIVERS = {**_SERIES, "upper": {**_SERIES, "brook": _SERIES}, "lower": _SERIES}


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, " + schema)


def levels(spark, hours, cm):
    """A reading of every spot at every hour: ``cm(hour, number of the spot)``."""
    stamp = lambda h: (MIDNIGHT + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = [(stamp(h), pier, gauge, float(cm(h, k))) for h in hours for k, (pier, gauge) in enumerate(SPOTS)]
    return frame(spark, rows, "read_at string, pier long, gauge long, cm double")


def test_update_is_aligned_to_the_stored_hours(spark, tmp_path):
    node = Store.open(spark, str(tmp_path), LEVELS).node("")
    read = lambda: {((r["hour"] - MIDNIGHT).total_seconds() / 3600, r["pier"], r["gauge"]): r["level"] for r in node.read_df("level").collect()}
    old, new = (lambda h, k: 100 + h + 10 * k), (lambda h, k: 500 - 3 * h * h + k)
    node.update(levels(spark, [0, 4], old), "row")
    assert read() == {(h, *SPOTS[k]): pytest.approx(old(h, k) / 100) for h in (0, 4) for k in range(3)}

    result = node.update(levels(spark, [11, 3], new), "row")
    # 4 lies within the update; behind it 11 is 7 hours away, which makes two steps of whole hours: 7 and 11
    assert result.new_values["hour"] == 2
    axis = [(r["hour"] - MIDNIGHT).total_seconds() / 3600 for r in node.axis("hour").orderBy("pos").collect()]
    assert axis == [0, 4, 7, 11]
    between = lambda h, k: new(3, k) + (new(11, k) - new(3, k)) * (h - 3) / 8
    want = {(0, *SPOTS[k]): old(0, k) for k in range(3)} | {(h, *SPOTS[k]): between(h, k) for h in (4, 7, 11) for k in range(3)}
    assert read() == {cell: pytest.approx(v / 100) for cell, v in want.items()}
    assert node.check_axes().isEmpty()


def test_partial_update_of_unsorted_coordinate(spark, tmp_path):
    schema = "stamp string, sensor string, litres double"
    at = "2031-06-02T12:30:00"
    every = frame(spark, [(at, f"s{i}", float(i)) for i in range(5)], schema)
    some = frame(spark, [(at, "s3", 33.0), (at, "s1", 31.0)], schema)
    read = lambda node: {r["sensor"]: r["flow"] for r in node.read_df("flow").collect()}

    keep = Store.open(spark, str(tmp_path / "keep"), SENSORS).node("")
    keep.update(every, "row")
    keep.update(some, "row")
    assert read(keep) == {"s0": 0.0, "s1": 31.0, "s2": 2.0, "s3": 33.0, "s4": 4.0}

    box = Store.open(spark, str(tmp_path / "box"), SENSORS).node("")
    box.update(every, "row", policy="overwrite")
    box.update(some, "row", policy="overwrite")
    # the update's box reaches from s1 to s3 on the stored axis: what it has no value for is blanked
    assert read(box) == {"s0": 0.0, "s1": 31.0, "s3": 33.0, "s4": 4.0}


def test_cells_without_value_or_key(spark, tmp_path):
    node = Store.open(spark, str(tmp_path), LEVELS).node("")
    rows = [("2031-06-02T05:59:59Z", 1, 7, 250.0), ("2031-06-02T05:00:00Z", 1, 9, float("nan")), ("2031-06-02T05:30:00Z", None, 9, 1.0), ("nonsense", 1, 7, 1.0)]
    result = node.update(frame(spark, rows, "read_at string, pier long, gauge long, cm double"), "row")
    assert [tuple(r) for r in node.read_df("level").collect()] == [(datetime(2031, 6, 2, 5), 1, 7, pytest.approx(2.5))]
    # a spot with a missing value stays on its axis, rows with a missing key do not
    assert sorted(tuple(r) for r in node.axis("spot").select("pier", "gauge").collect()) == [(1, 7), (1, 9)]
    assert {(r["variable"], r["problem"]): r["rows"] for r in result.problems.collect()} == {("pier", "missing_key"): 1, ("hour", "missing_key"): 1, ("hour", "unparsable"): 1}
    dense = node.read_df("level", dense=True).collect()
    assert len(dense) == 2 and sum(r["level"] is None for r in dense) == 1


def test_tree_update_and_reopen(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), RIVERS)
    cells = {"": (5, 0.5), "upper": (60, 1.25), "upper/brook": (61, 0.125)}
    store.update_tree({p: frame(spark, [r], "second long, depth double") for p, r in cells.items()}, "row")
    again = Store.open(spark, str(tmp_path))
    for path, cell in cells.items():
        assert [tuple(r) for r in again.node(path).read_df("depth").collect()] == [cell]
    assert again.node("lower").read_df("depth").count() == 0
    assert {r["path"] for r in again.find("*brook").collect()} == {"upper/brook"}
    assert {r["path"]: r["cells"] for r in again.variables().collect()} == {"": 1, "upper": 1, "upper/brook": 1, "lower": 0}

    target = Store.open(spark, str(tmp_path / "copy"), {**_SERIES, "lower": _SERIES})
    assert copy_tree(again, target) == ["upper", "upper/brook"]
    assert [tuple(r) for r in target.node("").read_df("depth").collect()] == [cells[""]]


def test_read_slice_opens_only_needed_buckets(spark, tmp_path):
    spec = {"COORDS": {"day": {"unit": {"tick": "D"}, "bucket_span": 3}}, "VARS": {"count": {"type": "int64", "coords": ["day"]}}}
    node = Store.open(spark, str(tmp_path), spec).node("")
    day = lambda d: str((MIDNIGHT + timedelta(days=d)).date())
    read = lambda **label: sorted(r["count"] for r in node.read_df("count", **label).collect())
    node.update(frame(spark, [(day(d), d) for d in range(9)], "day string, count long"), "row")
    part = node.read_df("count", day=slice(day(2), day(4)))
    assert sorted(r["count"] for r in part.collect()) == [2, 3, 4]
    opened = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in part.inputFiles()}
    number = lambda d: (MIDNIGHT + timedelta(days=d) - datetime(1970, 1, 1)).days // 3
    assert opened == {str(number(d)) for d in (2, 3, 4)}
    with pytest.raises(KeyError):
        read(day=day(40))
    result = node.update(frame(spark, [(day(8), 80)], "day string, count long"), "row")
    assert result.buckets == {"day": 1} and read() == [*range(8), 80]
    assert len(node.expire(keep=1)) == 1 and node.expire(keep=1) == []
    assert read() == [*range(8), 80]


def test_dropped_dimension_must_be_constant(spark, tmp_path):
    spec = {
        "COORDS": {"at": {"unit": {"tick": "s"}}, "sensor": {"type": "str[12]", "sorted": False}},
        "VARS": {"flow": {"type": "float64", "coords": ["at", "sensor"]}, "height": {"unit": "m", "coords": ["sensor"]}},
    }
    schema = "at string, sensor string, flow double, height double"
    node = Store.open(spark, str(tmp_path / "a"), spec).node("")
    node.update(frame(spark, [("2031-06-02", "s1", 1.0, 12.5), ("2031-06-03", "s1", 2.0, None), ("2031-06-03", "s2", 3.0, 13.0)], schema), "row")
    assert {r["sensor"]: r["height"] for r in node.read_df("height").collect()} == {"s1": 12.5, "s2": 13.0}
    bad = [("2031-06-02", "s1", 1.0, 12.5), ("2031-06-03", "s1", 2.0, 12.25)]
    with pytest.raises(ValueError, match="not constant"):
        Store.open(spark, str(tmp_path / "b"), spec).node("").update(frame(spark, bad, schema), "row")


def test_missing_column_is_reported_or_raises(spark, tmp_path):
    node = Store.open(spark, str(tmp_path), SENSORS).node("")
    df = frame(spark, [("2031-06-02", "s1")], "stamp string, sensor string")
    with pytest.raises(SchemaError):
        node.update(df, "row", strict=True)
    result = node.update(df, "row")
    assert {(r["variable"], r["problem"]) for r in result.problems.collect()} == {("flow", "missing_column")}
    assert not node.store.events().where(F.col("message").contains("missing_column")).isEmpty()


def test_no_new_and_insert(spark, tmp_path):
    spec = {"COORDS": {"x": {"type": "float64", "step_limits": "no_new"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}}
    node = Store.open(spark, str(tmp_path), NodeSchema.from_dict(spec)).node("")
    put = lambda rows, **k: node.update(frame(spark, rows, "x double, v double"), "row", **k)
    read = lambda: {r["x"]: r["v"] for r in node.read_df("v").collect()}
    put([(4.0, 0.0), (6.0, 0.0), (9.0, 0.0)])
    # 6 is hit, 9 takes from 8 and 12; 12 is behind the last coordinate and serves that only, 20 serves nothing
    put([(6.0, 60.0), (8.0, 80.0), (12.0, 160.0), (20.0, 7.0)])
    assert read() == {4.0: 0.0, 6.0: 60.0, 9.0: pytest.approx(100.0)}
    # one value between two stored ones has no target
    put([(5.0, 99.0)])
    assert read() == {4.0: 0.0, 6.0: 60.0, 9.0: pytest.approx(100.0)}
    put([(5.0, 99.0)], insert=True)
    assert read()[5.0] == 99.0 and [r["x"] for r in node.axis("x").orderBy("pos").collect()] == [4.0, 5.0, 6.0, 9.0]


def test_many_appends_keep_the_axis_dense(spark, tmp_path, monkeypatch):
    import cubemerge.sources.store as module

    monkeypatch.setattr(module, "MAX_AXIS_GENERATIONS", 2)
    spec = {"COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}}
    node = Store.open(spark, str(tmp_path), spec).node("")
    for i in range(4):
        node.update(frame(spark, [(2 * i, 1.0), (2 * i + 1, 2.0)], "x long, v double"), "row")
    assert [tuple(r) for r in node.axis("x").orderBy("pos").collect()] == [(i, i) for i in range(8)]
    assert len(node._state()["axes"]["x"]["gens"]) == 2 and node.read_df("v").count() == 8


POINTS = {"COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}, "w": {"type": "float64", "coords": ["x"]}}}


def test_lost_values_are_reported(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), POINTS)
    node = store.node("")
    node.update(frame(spark, [(0, 1.0, 1.0), (10, 2.0, 2.0), (20, 3.0, 3.0)], "x long, v double, w double"), "row")
    # between 0 and 20: 10 takes from 9 and 12, the others reach no stored coordinate; 21 and later are new coordinates
    result = node.update(frame(spark, [(3, 5.0, None), (7, 5.0, 6.0), (9, 10.0, 1.0), (12, 20.0, 4.0), (15, 5.0, None), (30, 7.0, 7.0)], "x long, v double, w double"), "row")
    assert {(r["variable"], r["rows"]) for r in result.problems.where("problem = 'no_target'").collect()} == {("v", 2), ("w", 1)}
    messages = [r["message"] for r in store.events().collect()]
    assert "v no_target 2" in messages and "w no_target 1" in messages
    assert {r["x"]: r["v"] for r in node.read_df("v").collect()}[10] == pytest.approx(10 + 10 / 3)
    # nothing is lost on coordinates that are stored, nor with insert
    fine = node.update(frame(spark, [(10, 1.0, 1.0), (30, 1.0, 1.0)], "x long, v double, w double"), "row")
    assert fine.problems.isEmpty()
    assert node.update(frame(spark, [(11, 1.0, 1.0)], "x long, v double, w double"), "row", insert=True).problems.isEmpty()
    # no value at all reaches a target: all are counted
    lost = node.update(frame(spark, [(13, 5.0, None)], "x long, v double, w double"), "row")
    assert [(r["variable"], r["rows"]) for r in lost.problems.collect()] == [("v", 1)]


def test_values_without_extension_are_reported(spark, tmp_path):
    spec = {"COORDS": {"x": {"type": "int64", "step_limits": "no_new"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}}
    store = Store.open(spark, str(tmp_path), spec)
    node = store.node("")
    node.update(frame(spark, [(0, 1.0), (10, 2.0)], "x long, v double"), "row")
    result = node.update(frame(spark, [(10, 3.0), (20, 4.0), (30, 5.0)], "x long, v double"), "row")
    assert {(r["problem"], r["rows"]) for r in result.problems.collect()} == {("no_target", 2)}
    assert any("new values ignored" in r["message"] for r in store.events().collect())


def test_hashed_buckets_split_and_only_touched_ones_are_rewritten(spark, tmp_path):
    spec = {"COORDS": {"name": {"type": "str[16]", "sorted": False}}, "VARS": {"v": {"type": "float64", "coords": ["name"]}}}
    store = Store.open(spark, str(tmp_path), spec, bucket_bytes=3000)
    node = store.node("")
    rows = lambda ids, base: frame(spark, [(f"n{i:05}", base + i / 7) for i in ids], "name string, v double")
    node.update(rows(range(100), 0.0), "row")
    first = node._state()["cubes"]["name"]
    node.update(rows(range(100, 1500), 0.0), "row")
    grown = node._state()["cubes"]["name"]
    node.update(rows(range(1500), 1000.0), "row")
    entry = node._state()["cubes"]["name"]
    assert len(entry["leaves"]) > len(first["leaves"]) and len(grown["buckets"]) >= 1
    # leaves of different depth stand beside each other: every hash belongs to one
    assert sum(2.0 ** (1 - leaf.bit_length()) for leaf in entry["leaves"]) == 1
    assert set(map(int, entry["buckets"])) <= set(entry["leaves"]) and set(entry["bytes"]) == set(entry["buckets"])
    before = dict(entry["buckets"])
    result = node.update(rows([7], 5000.0), "row")
    after = node._state()["cubes"]["name"]
    changed = {b for b in set(before) | set(after["buckets"]) if before.get(b) != after["buckets"].get(b)}
    assert result.buckets["name"] <= 2 and 1 <= len(changed) <= 3 and len(before) > 4
    got = {r["name"]: r["v"] for r in node.read_df("v").collect()}
    assert len(got) == 1500 and got["n00007"] == 5001.0 and got["n01499"] == pytest.approx(1000 + 1499 / 7)


def test_nodes_new_in_the_schema_are_added_on_reopen(spark, tmp_path):
    cube = {"COORDS": {"x": {"type": "int64"}}, "VARS": {"v": {"type": "float64", "coords": ["x"]}}}
    store = Store.open(spark, str(tmp_path), {**cube, "old": cube})
    store.node("old").update(frame(spark, [(1, 1.0)], "x long, v double"), "row")
    again = Store.open(spark, str(tmp_path), {**cube, "old": {**cube, "deep": cube}, "new": cube})
    assert sorted(again.nodes) == ["", "new", "old", "old/deep"]
    again.node("old/deep").update(frame(spark, [(2, 2.0)], "x long, v double"), "row")
    # the added nodes are found without a schema too, what was stored is there
    plain = Store.open(spark, str(tmp_path))
    assert sorted(plain.nodes) == ["", "new", "old", "old/deep"]
    assert plain.node("old").read_df("v").count() == plain.node("old/deep").read_df("v").count() == 1


def test_events_are_compacted(spark, tmp_path, monkeypatch):
    import cubemerge.sources.store as module

    monkeypatch.setattr(module, "EVENT_COMMITS", 3)
    store = Store.open(spark, str(tmp_path), POINTS)
    for i in range(9):
        store.log_event("INFO", "", f"event {i}")
    store.note("INFO", "a", "first")
    store.note("INFO", "b", "second")
    store.flush_events()
    assert sorted(r["message"] for r in store.events().collect()) == sorted([f"event {i}" for i in range(9)] + ["first", "second"])
    folders = store._event_log()[1]
    assert len(folders) <= 5 and sum(f.startswith("all=") for f in folders) == 2
    assert store.events().where("day IS NULL").isEmpty() and Store.open(spark, str(tmp_path)).events().count() == 11


def test_labels_from_a_file_and_appended(spark, tmp_path):
    (tmp_path / "kinds.csv").write_text("note,kind\nx,clay\ny,sand\nz,clay\n,\n,rock\n")
    spec = {"COORDS": {"x": {"type": "int64"}}, "VARS": {"soil": {"df_col": "kind", "range": {"discrete": str(tmp_path / "kinds.csv")}, "coords": ["x"]}}}
    node = Store.open(spark, str(tmp_path / "store"), spec).node("")
    rows = frame(spark, [(1, "sand"), (2, "clay"), (3, "mud"), (4, None), (5, "rock")], "x long, kind string")
    result = node.update(rows, "row")
    codes = {r["x"]: r["soil"] for r in node.read_df("soil").collect()}
    assert codes == {1: 2, 2: 1, 3: 0, 4: 0, 5: 3}
    assert [(r["problem"], r["rows"]) for r in result.problems.collect()] == [("unknown_label", 1)]
    # appended labels get the codes after the last one, whatever their order; old codes stay
    more = spark.createDataFrame([("mud",), ("clay",), ("ash",), (None,)], "kind string")
    assert node.add_labels("soil", more, "kind") == 2 and node.add_labels("soil", more, "kind") == 0
    assert {r["label"]: r["code"] for r in node.labels("soil").collect()} == {"clay": 1, "sand": 2, "rock": 3, "ash": 4, "mud": 5}
    node.update(rows, "row")
    assert {r["x"]: r["soil"] for r in node.decode(node.read_df("soil")).collect()} == {1: "sand", 2: "clay", 3: "mud", 4: None, 5: "rock"}
    node.expire(keep=1)
    assert node.labels("soil").count() == 5
    with pytest.raises(SchemaError):
        node.add_labels("x", more, "kind")


def test_long_label_lists_are_joined(spark, tmp_path):
    labels = [f"l{i}" for i in range(500)]
    spec = {"COORDS": {"x": {"type": "int64"}}, "VARS": {"kind": {"range": {"discrete": labels}, "coords": ["x"]}}}
    node = Store.open(spark, str(tmp_path), spec).node("")
    node.update(frame(spark, [(i, f"l{i}") for i in range(0, 600, 7)] + [(1000, None)], "x long, kind string"), "row")
    assert {r["x"]: r["kind"] for r in node.read_df("kind").collect()} == {**{i: i + 1 if i < 500 else 0 for i in range(0, 600, 7)}, 1000: 0}


def test_messages_are_set_aside_by_themselves(spark, tmp_path):
    spec = {
        "COORDS": {"date_time": {"unit": {"tick": "s"}}, "borehole": {"type": "str[8]", "sorted": False, "step_limits": "no_new"}},
        "VARS": {"temp": {"unit": "degC", "coords": ["date_time", "borehole"]}, "lat": {"unit": "deg", "coords": ["borehole"]}},
    }
    node = Store.open(spark, str(tmp_path), spec).node("")
    node.update(frame(spark, [("2024-01-01", "A", 1.0, 49.0), ("2024-01-01", "B", 1.0, 50.0)], "date_time string, borehole string, temp double, lat double"), "row")
    rows = [
        ("m1", 0, "2024-01-02", "A", 2.0, 48.0),
        ("m2", 0, "2024-01-02", "A", 3.0, 47.0), ("m2", 1, "2024-01-03", "A", 4.0, 46.0),  # lat differs within the message
        ("m3", 0, "2024-01-02", "C", 9.0, 1.0),  # a borehole that is not stored
        ("m4", 0, "2024-01-02", "A", 5.0, 45.0), ("m4", 1, "2024-01-04", "B", None, None),
    ]
    df = spark.createDataFrame(rows, "m string, line long, date_time string, borehole string, temp double, lat double")
    result, failed = node.update_messages(df.withColumn("o", F.struct("m", "line")), "o", "m")
    assert {r["message"]: r["reason"].split(":")[0] for r in failed.collect()} == {"m2": "not constant along dropped dimensions", "m3": "borehole"}
    # as if merged one after the other: m4 after m1
    assert {r["borehole"]: r["lat"] for r in node.read_df("lat").collect()} == {"A": 45.0, "B": 50.0}
    temps = {(str(r["date_time"])[:10], r["borehole"]): r["temp"] for r in node.read_df("temp").collect()}
    assert temps == {("2024-01-01", "A"): 1.0, ("2024-01-01", "B"): 1.0, ("2024-01-02", "A"): 5.0}
