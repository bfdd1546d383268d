"""Nearest sites of a table of probes against all distances."""

import math
import random

import pytest

from cubemerge.operators import lookup, nearest


def plain(sites, probes, farthest=math.inf):
    out = []
    known = [s for s in sites if s[0] is not None and all(v is not None and math.isfinite(v) for v in s[1:])]
    for p, lat, lon in probes:
        if lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)):
            continue
        ranked = sorted(((y - lat) * (y - lat) + (x - lon) * (x - lon), s, y, x) for s, y, x in known)
        ranked = [r for r in ranked if r[0] <= farthest * farthest]
        if ranked:
            out.append((p, *ranked[0]))
    return sorted(out)


def run(spark, sites, probes, **options):
    s = spark.createDataFrame(sites, "s string, lat double, lon double")
    p = spark.createDataFrame(probes, "p long, lat double, lon double")
    return sorted(tuple(r) for r in nearest.nearest_sites(s, "s", "lat", "lon", p, "p", **options).collect())


@pytest.mark.parametrize("leaf", [64, 4, 1])
def test_probes_equal_all_distances(spark, leaf):
    rng = random.Random(leaf)
    # a crowd in one place, a few far off, repeated positions, ties on a lattice
    sites = [(f"a{i:03}", 50 + rng.gauss(0, 0.001), 14 + rng.gauss(0, 0.001)) for i in range(150)]
    sites += [(f"b{i:03}", rng.uniform(-80, 80), rng.uniform(-170, 170)) for i in range(40)]
    sites += [(f"c{i:03}", float(i % 5), float(i // 5)) for i in range(25)] + [("c2", 0.0, 0.0), ("c1", 0.0, 0.0), (None, 1.5, 1.5), ("n", None, 3.0), ("m", float("nan"), 1.0), ("i", float("inf"), 1.0)]
    probes = [(i, 50 + rng.gauss(0, 0.002), 14 + rng.gauss(0, 0.002)) for i in range(60)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]
    probes += [(200 + i, i % 6 - 0.5, i // 6 - 0.5) for i in range(36)] + [(300, 0.0, 0.0)] * 3 + [(301, None, 1.0), (302, float("nan"), 1.0), (303, 1e9, -1e9), (304, 50.0, 14.0)]
    assert run(spark, sites, probes, leaf=leaf) == plain(sites, probes)
    assert run(spark, sites, probes, leaf=leaf, max_distance=0.7) == plain(sites, probes, 0.7)


def test_one_site_no_site_no_probe(spark):
    assert run(spark, [("a", 1.0, 2.0)], [(1, 1.0, 2.0), (2, 0.0, 0.0)]) == [(1, 0.0, "a", 1.0, 2.0), (2, 5.0, "a", 1.0, 2.0)]
    assert run(spark, [], [(1, 1.0, 2.0)]) == []
    assert run(spark, [("a", None, 2.0)], [(1, 1.0, 2.0)]) == []
    assert run(spark, [("a", 1.0, 2.0)], []) == []
    assert run(spark, [("a", 1.0, 2.0)], [(1, 1.0, 3.0)], max_distance=0.5) == []


def test_long_list_of_probes(spark):
    sites = spark.createDataFrame([(f"s{i}", float(i), 0.0) for i in range(50)], "s string, lat double, lon double")
    found = lookup.nearest_site(sites, "s", "lat", "lon", [lookup.Probe(i / 4, 0.1) for i in range(150)])
    assert found.count() == 150 and found.columns == ["probe", "distance2", "s", "lat", "lon"]
