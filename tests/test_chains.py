"""Limited-step chains over blocks against the plain rule."""

import random

import numpy as np
import pytest

from cubemerge.operators import align, chains


def kept(values, low):
    out = []
    for v in sorted(set(values)):
        if not out or v - out[-1] >= low:
            out.append(v)
    return out


def run(spark, rows, low, schema="k string, x long", **sizes):
    points = spark.createDataFrame(rows, schema).distinct().repartition(5)
    got = {}
    for r in chains.kept_points(points, ["k"], "x", low, **sizes).collect():
        got.setdefault(r["k"], []).append((r["x"], r["_prev"]))
    return {k: sorted(v) for k, v in got.items()}


def check(got, rows, low):
    keys = {r[0] for r in rows}
    assert set(got) == keys
    for key in keys:
        want = kept([x for k, x in rows if k == key], low)
        assert [x for x, _ in got[key]] == want
        assert [p for _, p in got[key]] == [None, *want[:-1]]


@pytest.mark.parametrize("low", [0, 1, 3, 17, 400])
@pytest.mark.parametrize(("points_a_block", "fan"), [(65536, 1024), (16, 3), (5, 2), (1, 4)])
def test_one_hot_key_and_small_ones(spark, low, points_a_block, fan):
    rng = random.Random(low + points_a_block)
    rows = [("hot", rng.randrange(600)) for _ in range(300)] + [(rng.choice([None, "a", "b", "c"]), rng.randrange(60)) for _ in range(60)] + [("one", 5)]
    check(run(spark, rows, low, points_a_block=points_a_block, fan=fan), rows, low)


def test_many_points_within_one_step(spark):
    # no chain enters most of the blocks: all points of many blocks lie within one step
    rows = [("k", x) for x in range(200)] + [("k", 1000 + x) for x in range(200)] + [("z", 7)]
    for low in (150, 199, 200, 201, 5000):
        check(run(spark, rows, low, points_a_block=7, fan=3), rows, low)


@pytest.mark.parametrize("low", [0.1, 0.3, 2.5])
def test_differences_decide_not_sums(spark, low):
    rng = random.Random(1)
    rows = [("k", k / 10) for k in range(200)] + [("r", rng.random() * 30) for _ in range(200)] + [("big", 1e15 + k / 8) for k in range(50)]
    check(run(spark, rows, low, "k string, x double", points_a_block=11, fan=4), rows, low)


def test_jump_tables_hold_one_step_of_points():
    xs = np.arange(10_000, dtype=np.int64) * 3
    enter, leave, whole = chains.jump_table(xs, 100)
    # 0, 3, ... 99 are within a step of the first point, 102 is the last one at which a chain may enter
    assert whole and len(enter) <= 35
    for last in range(-100, 1):
        chain = kept([last, *xs.tolist()], 100)
        assert chains.jump(enter, leave, np.array([last]), 100)[0] == chain[-1]
    assert chains.jump_table(xs[:5], 1000)[2] is False


def test_grid_without_points(spark):
    empty = spark.createDataFrame([], "k long, x double")
    assert align.adjust_grid(empty, "x", 1, 2, ["k"]).count() == 0
    odd = spark.createDataFrame([(1, None), (1, float("nan")), (1, 0.0), (1, 3.0)], "k long, x double")
    assert sorted(r["x"] for r in align.adjust_grid(odd, "x", 1, 2, ["k"]).collect()) == [0.0, 1.5, 3.0]
