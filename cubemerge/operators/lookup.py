"""Lookups: attributes, nearest site, inherited configuration, message sidecars.

No side is force-broadcast: adaptive execution broadcasts a lookup whose measured size allows it and splits
skewed partitions of a shuffled join otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.operators.nearest import nearest_sites

# Probe positions (clicks on a map) up to this many are literals of one aggregate; more are a table.
LITERAL_PROBES = 100


def attribute_lookup(df: DataFrame, table: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Add attributes by key. A key with no row or with several rows in ``table`` raises on read."""
    unique = table.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.any_value(a).alias(a) for a in attributes]
    )
    text = F.concat(F.lit(f"{key} must match exactly one row: "), F.col(key).cast("string"))
    checked = df.join(unique, key, "left").withColumn(
        "_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(text).cast("boolean"))
    )
    return checked.where("_ok").drop("_n", "_ok")


@dataclass(frozen=True)
class Probe:
    lat: float
    lon: float


def nearest_site(sites: DataFrame, site: str, lat: str, lon: str, probes: list[Probe],
                 max_distance: float | None = None) -> DataFrame:
    """(probe, site, lat, lon, distance2): nearest site to each probe by squared degree distance.

    Sites with a missing position are ignored, ties go to the smaller site key. A few probes are literals and each is
    one aggregate of a single scan, so a task sends one row whatever the number of sites; ``nearest_sites`` answers a table of probes.
    """
    if len(probes) > LITERAL_PROBES or not probes:
        table = sites.sparkSession.createDataFrame([(i, float(p.lat), float(p.lon)) for i, p in enumerate(probes)], f"probe int, `{lat}` double, `{lon}` double")
        return nearest_sites(sites, site, lat, lon, table, "probe", max_distance).select("probe", "distance2", site, lat, lon)
    located = sites.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    best = []
    for i, probe in enumerate(probes):
        dy, dx = F.col(lat) - F.lit(probe.lat), F.col(lon) - F.lit(probe.lon)
        d2 = dy * dy + dx * dx
        entry = F.struct(d2.alias("distance2"), site, lat, lon)
        if max_distance is not None:
            entry = F.when(d2 <= F.lit(max_distance * max_distance), entry)
        best.append(F.min(entry).alias(f"b{i}"))
    row = located.agg(*best)
    found = F.array(*[
        F.struct(F.lit(i).alias("probe"), *[F.col(f"b{i}")[c].alias(c) for c in ("distance2", site, lat, lon)])
        for i in range(len(probes))
    ])
    return row.select(F.inline(found)).where(F.col("distance2").isNotNull())


def site_by_index(sites: DataFrame, index: int) -> DataFrame:
    """Site at an explicit axis position; out of range raises on read."""
    count = sites.count()
    if not 0 <= index < count:
        raise IndexError(f"site index {index} is outside 0..{count - 1}")
    return sites.where(F.col("pos") == F.lit(index))


def ancestors(path: F.Column) -> F.Column:
    """Array of (prefix, depth) of a node path, the path itself and the root ("" at depth 0) included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depths = F.sequence(F.lit(0), F.size(parts))
    return F.transform(
        depths,
        lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("prefix"), d.alias("depth")),
    )


def inherited_config(nodes: DataFrame, configs: DataFrame, path: str, config: str, default: str | None = None) -> DataFrame:
    """Config of the longest ancestor path that has one, else ``default``; an equi-join on the prefixes."""
    exploded = nodes.select(path, F.inline(ancestors(F.col(path))))
    table = configs.select(F.col(path).alias("prefix"), F.col(config))
    found = exploded.join(table, "prefix").groupBy(path).agg(F.max_by(F.col(config), F.col("depth")).alias(config))
    return nodes.select(path).distinct().join(found, path, "left").withColumn(config, F.coalesce(F.col(config), F.lit(default)))


def with_sidecar(messages: DataFrame, sidecars: DataFrame, suffix: str = ".meta.json") -> DataFrame:
    """Messages with the metadata file of the same name; both frames have ``path``."""
    normal = sidecars.withColumn("path", F.regexp_replace("path", suffix.replace(".", r"\.") + "$", ""))
    return messages.join(normal, "path", "left")
