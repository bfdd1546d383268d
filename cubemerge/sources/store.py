"""Node store: a tree of nodes, each with its cubes and axes as partitioned Parquet.

    <root>/<node>/schema.json                     the schema; the stored one wins on reopen
    <root>/<node>/_versions/v000003.json          which files make up version 3; the highest one is read
    <root>/<node>/cube=<coords>/bucket=<b>/gen=<g>/*.parquet
    <root>/<node>/axis=<coord>/gen=<g>/*.parquet
    <root>/<node>/dict=<name>/gen=<g>/*.parquet   the labels of a table named in the schema, with their codes
    <root>/_events/batch=<id>/*.parquet           events, and in _commits which folders make up the log

A write adds files under a new ``gen`` for the buckets it touches and then publishes one small version file,
so a reader sees the old or the new state and a failed write changes nothing. One writer per node at a time;
``Node.expire`` removes the generations that newer versions have replaced.

A cube with a sorted numeric or date-time coordinate is cut into buckets along it. Others are cut by the hash of their keys: a bucket is a leaf of a binary tree
over the low bits of the hash, the version file has the leaves and their bytes, and a leaf of more than ``BUCKET_BYTES`` is split when an update rewrites it, so a cube
grows without its other buckets being touched.
"""

from __future__ import annotations

import json
import logging
import math
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.functions.datetimes import TICKS, to_epoch_ticks
from cubemerge.functions.values import decode_labels
from cubemerge.operators import align, merge
from cubemerge.operators.blocks import with_position
from cubemerge.operators.grid import axis, axis_values, cube_cells, duplicates, eliminate_dims, pivot_cells, reindex, sparse
from cubemerge.operators.harmonize import SEQ, definitions, harmonize
from cubemerge.operators.select import match_nodes, sel
from cubemerge.schema import Coord, DateTimeUnit, NodeSchema, SchemaError
from cubemerge.session import materialize, read_exact
from cubemerge.sources.files import read_delimited

log = logging.getLogger(__name__)

# Bytes a bucket of a hashed cube may have before its next rewrite splits it; a store can be opened with another limit.
BUCKET_BYTES = 128 << 20
# Directories up to this many slots are broadcast: two numbers a slot.
BROADCAST_SLOTS = 1 << 16
# Appends to an axis before it is written as a whole again.
MAX_AXIS_GENERATIONS = 64
DEFAULT_BUCKET_DAYS = 30
# Appends to the event log before their folders are written as one.
EVENT_COMMITS = 32
MESSAGE, TURN = "_message", "_turn"
LABELS = "label string, code bigint"
EVENTS = "time timestamp_ntz, level string, node string, message string"


class Files:
    """The few whole-file operations a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, path: str):
        full = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return full.getFileSystem(self._conf), full

    def exists(self, path: str) -> bool:
        fs, full = self._at(path)
        return fs.exists(full)

    def names(self, path: str) -> list[str]:
        fs, full = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(full)) if fs.exists(full) else []

    def sizes(self, pattern: str) -> dict[str, int]:
        """Bytes of the Parquet files that match a pattern, by the folder below the pattern's first wildcard: one call."""
        fs, full = self._at(pattern)
        # counted from the end: what the root is called does not matter
        place = pattern.count("/") - pattern[: pattern.index("*")].count("/") + 1
        out: dict[str, int] = {}
        for status in fs.globStatus(full) or ():
            name = status.getPath().toString().split("/")[-place]
            out[name] = out.get(name, 0) + status.getLen()
        return out

    def read_json(self, path: str) -> dict[str, Any]:
        fs, full = self._at(path)
        stream = fs.open(full)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, full = self._at(path)
        fs.delete(full, True)

    def mkdirs(self, path: str) -> None:
        fs, full = self._at(path)
        fs.mkdirs(full)

    def publish_json(self, path: str, value: dict[str, Any]) -> None:
        """Write under a temporary name, then rename: the file appears whole or not at all."""
        fs, final = self._at(path)
        _, temp = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(json.dumps(value).encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise FileExistsError(f"{path} was published by another writer")


@dataclass
class UpdateResult:
    """What an update did. ``problems`` is the quality report (variable, problem, rows); ``no_target`` rows count values
    at coordinates between stored ones that no stored or new coordinate takes anything from."""

    version: int
    problems: DataFrame
    buckets: dict[str, int] = field(default_factory=dict)
    new_values: dict[str, int] = field(default_factory=dict)


def _fields(schema: T.StructType) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema.json()))


class Node:
    def __init__(self, store: "Store", path: str, schema: NodeSchema):
        self.store, self.path, self.schema = store, path, schema
        self.spark = store.spark

    # --- state -----------------------------------------------------------------------------------------

    def _rel(self, name: str) -> str:
        return f"{self.path}/{name}" if self.path else name

    def version(self) -> int:
        names = [n for n in self.store.files.names(self._rel("_versions")) if n.endswith(".json")]
        # by number: as text, version 1000000 would come before 999999
        return max((int(n[1:-5]) for n in names), default=0)

    def _state(self) -> dict[str, Any]:
        number = self.version()
        if not number:
            return {"version": 0, "cubes": {}, "axes": {}, "dicts": {}}
        return self.store.files.read_json(self._rel(f"_versions/v{number:06d}.json"))

    def _publish(self, state: dict[str, Any]) -> None:
        self.store.files.publish_json(self._rel(f"_versions/v{state['version']:06d}.json"), state)

    # --- reading ---------------------------------------------------------------------------------------

    def axis(self, coord: str, state: dict[str, Any] | None = None) -> DataFrame:
        """Key columns and ``pos`` of a coordinate."""
        entry = (state or self._state())["axes"].get(coord)
        if entry is None:
            return self.spark.createDataFrame([], self.schema.axis_type(coord))
        base = f"{self.store.root}/{self._rel(f'axis={coord}')}"
        return read_exact(self.spark, T.StructType.fromJson(entry["type"]), *[f"{base}/gen={g}" for g in entry["gens"]])

    def cube(self, coords: tuple[str, ...], buckets: list[int] | None = None, state: dict[str, Any] | None = None) -> DataFrame:
        """Stored cells of one coordinate list; only the given buckets are opened."""
        entry = (state or self._state())["cubes"].get(cube_id(coords))
        if entry is None:
            return self.spark.createDataFrame([], self.schema.cube_type(coords, self.schema.cubes()[coords]))
        wanted = entry["buckets"] if buckets is None else {str(b): entry["buckets"][str(b)] for b in buckets if str(b) in entry["buckets"]}
        schema = T.StructType.fromJson(entry["type"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        base = f"{self.store.root}/{self._rel('cube=' + cube_id(coords))}"
        return read_exact(self.spark, schema, *[f"{base}/bucket={b}/gen={g}" for b, g in wanted.items()])

    def read(self) -> dict[tuple[str, ...], DataFrame]:
        """All cubes, lazily."""
        state = self._state()
        return {coords: self.cube(coords, None, state) for coords in self.schema.cubes()}

    def read_df(self, variables: str | list[str], dense: bool = False, **labels: Any) -> DataFrame:
        """Variables of one coordinate list as a long table, restricted by label selection.

        Comparisons on the leading coordinate decide which buckets are opened; the others reach the Parquet
        filters. ``dense`` adds a NULL row for every combination of the selected coordinates without a cell.
        """
        names = [variables] if isinstance(variables, str) else list(variables)
        groups = {self.schema.vars[n].coords for n in names}
        if len(groups) != 1:
            raise SchemaError(f"{names} do not share one coordinate list")
        coords, state = groups.pop(), self._state()
        keys = self.schema.keys_of(coords)
        axes = {c: self.axis(c, state) for c in coords}
        by_key = {k: axes[c] for c in coords for k in self.schema.coords[c].keys}
        cells = self.cube(coords, self._selected_buckets(coords, labels, state), state)
        cells = sel(cells.select(*keys, *names), by_key, **labels)
        if not dense:
            return sparse(cells, names)
        chosen = []
        for c in coords:
            own = {k: v for k, v in labels.items() if k in self.schema.coords[c].keys}
            part = sel(axes[c], None, **own).drop("pos")
            chosen.append(axis(part, list(self.schema.coords[c].keys)) if own else axes[c])
        return reindex(cells, chosen, keys).select(*keys, *names)

    def _selected_buckets(self, coords: tuple[str, ...], labels: dict[str, Any], state: dict[str, Any]) -> list[int] | None:
        lead = self._leading(coords)
        entry = state["cubes"].get(cube_id(coords))
        if lead is None or entry is None or lead.keys[0] not in labels:
            return None
        label, span = labels[lead.keys[0]], entry["span"]
        one = lambda v: _bucket_of(v, lead, span)
        if isinstance(label, slice):
            low = one(label.start) if label.start is not None else -math.inf
            high = one(label.stop) if label.stop is not None else math.inf
        else:
            values = [one(v) for v in (label if isinstance(label, (list, tuple, set)) else [label])]
            low, high = (min(values), max(values)) if values else (0, -1)
        return [int(b) for b in entry["buckets"] if low <= int(b) <= high]

    # --- labels ----------------------------------------------------------------------------------------

    def labels(self, variable: str, state: dict[str, Any] | None = None) -> DataFrame:
        """(label, code) of a variable whose labels are in a table; codes count from 1 in the order in which labels came."""
        entry = (state or self._state()).get("dicts", {}).get(variable)
        if entry is None:
            return self.spark.createDataFrame([], LABELS)
        base = f"{self.store.root}/{self._rel(f'dict={variable}')}"
        return read_exact(self.spark, T.StructType.fromDDL(LABELS), *[f"{base}/gen={g}" for g in entry["gens"]])

    def add_labels(self, variable: str, labels: DataFrame, column: str, order: list[str] | None = None) -> int:
        """Append the labels of a table that the variable does not have yet, in ``order`` (by default their own); returns how many.

        Codes given out stay: labels are never renumbered or removed.
        """
        if variable not in {v.name for v in definitions(self.schema) if v.label_table is not None}:
            raise SchemaError(f"{variable!r} has no label table in the schema")
        state = self._state()
        entry = state.get("dicts", {}).get(variable) or {"gens": [], "size": 0}
        named = [f"_o{i}" for i in range(len(order or []))]
        rows = labels.select(F.col(column).cast("string").alias("label"), *[F.col(o).alias(n) for o, n in zip(order or [], named, strict=True)]).where("label IS NOT NULL")
        first = rows.groupBy("label").agg(F.min(F.struct(*named)).alias("_first")) if named else rows.distinct()
        fresh = first.join(self.labels(variable, state).select("label"), "label", "left_anti")
        numbered = with_position(fresh, ["_first", "label"] if named else ["label"], "code")
        gen = f"{state['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.store.root}/{self._rel(f'dict={variable}')}/gen={gen}"
        numbered.select("label", (F.col("code") + F.lit(entry["size"] + 1)).alias("code")).write.parquet(folder)
        count = read_exact(self.spark, T.StructType.fromDDL(LABELS), folder).count()
        if count:
            entry = {"gens": [*entry["gens"], gen], "size": entry["size"] + count}
            self._publish({**state, "version": state["version"] + 1, "dicts": {**state.get("dicts", {}), variable: entry}})
        return count

    def _dictionaries(self) -> dict[str, DataFrame]:
        """Label tables of the variables that have one; a table named as a delimited file is read once, when it is first needed."""
        wanted = [v for v in definitions(self.schema) if v.label_table is not None]
        for var in wanted:
            if var.name not in self._state().get("dicts", {}) and var.label_table.lower().endswith((".csv", ".txt", ".tsv")):
                table = read_delimited(self.spark, var.label_table, line="_line")
                self.add_labels(var.name, table, var.df_col, ["_line"])
        return {v.name: self.labels(v.name) for v in wanted}

    def decode(self, df: DataFrame) -> DataFrame:
        """Codes of the schema's coded variables back to their labels; code 0 and unknown codes give NULL."""
        state = self._state()
        for var in definitions(self.schema):
            if var.name not in df.columns or not var.is_coded:
                continue
            if var.label_table is None:
                df = df.withColumn(var.name, decode_labels(F.col(var.name), var.labels))
                continue
            table = self.labels(var.name, state).select(F.col("code").alias(var.name), F.col("label").alias("_label"))
            df = df.join(table, var.name, "left").withColumn(var.name, F.col("_label")).select(*df.columns)
        return df

    # --- layout ----------------------------------------------------------------------------------------

    def _leading(self, coords: tuple[str, ...]) -> Coord | None:
        """First sorted numeric or date-time coordinate: the one buckets are cut on."""
        for name in coords:
            coord = self.schema.coords[name]
            if coord.sorted and not coord.is_composed and not isinstance(coord.storage_type, T.StringType):
                return coord
        return None

    def _span(self, coords: tuple[str, ...]) -> float | None:
        lead = self._leading(coords)
        if lead is None:
            return None
        if lead.bucket_span:
            return lead.bucket_span
        if lead.step_limits.kind == "limits":
            return max(1, lead.chunk_size * align.step_bounds(lead)[1])
        if isinstance(lead.unit, DateTimeUnit):
            return DEFAULT_BUCKET_DAYS * TICKS["D"][1] // TICKS[lead.unit.tick][1]
        return float(lead.chunk_size)

    def _placed(self, coords: tuple[str, ...], cells: DataFrame, entry: dict[str, Any]) -> DataFrame:
        """``cells`` with the ``bucket`` each belongs to by an entry's span or leaves."""
        lead = self._leading(coords)
        if lead is not None:
            key = F.col(lead.keys[0])
            if lead.is_datetime:
                tick = lead.unit.tick if isinstance(lead.unit, DateTimeUnit) else "us"
                key = to_epoch_ticks(key, tick)
            return cells.withColumn("bucket", F.floor(key / F.lit(entry["span"])).cast("long"))
        depth = max(leaf.bit_length() - 1 for leaf in entry["leaves"])
        slot = F.xxhash64(*self.schema.keys_of(coords)).bitwiseAND(F.lit((1 << depth) - 1))
        if min(entry["leaves"]).bit_length() - 1 == depth:
            return cells.withColumn("bucket", slot + F.lit(1 << depth))
        slots = [(low, leaf) for leaf in entry["leaves"] for low in range(leaf - (1 << leaf.bit_length() - 1), 1 << depth, 1 << leaf.bit_length() - 1)]
        directory = self.spark.createDataFrame(slots, "_slot long, bucket long")
        return cells.withColumn("_slot", slot).join(F.broadcast(directory) if len(slots) <= BROADCAST_SLOTS else directory, "_slot").drop("_slot")

    def _write_cube(self, coords: tuple[str, ...], cells: DataFrame, gen: str, entry: dict[str, Any]) -> tuple[dict[str, str], dict[str, int]]:
        """Append the cells as new generation; returns bucket -> gen and bucket -> bytes of what was written."""
        relative = self._rel("cube=" + cube_id(coords))
        placed = self._placed(coords, cells, entry).withColumn("gen", F.lit(gen))
        # rebalance splits an oversized bucket over several tasks and joins small ones
        placed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "gen").parquet(f"{self.store.root}/{relative}")
        sizes = {name.split("=", 1)[1]: size for name, size in self.store.files.sizes(f"{relative}/bucket=*/gen={gen}/*.parquet").items()}
        return {b: gen for b in sizes}, sizes

    def _write_axis(self, coord: str, values: DataFrame, gen: str, size: int | None = None, before: dict[str, Any] | None = None) -> dict[str, Any]:
        """Write axis values; with ``before`` they are added to the generations of that entry."""
        folder = f"{self.store.root}/{self._rel(f'axis={coord}')}/gen={gen}"
        values.write.parquet(folder)
        if before is not None:
            return {**before, "gens": before["gens"] + [gen], "size": before["size"] + size}
        kind = _fields(values.schema)
        size = read_exact(self.spark, kind, folder).count() if size is None else size
        return {"gens": [gen], "size": size, "type": json.loads(kind.json())}

    def _extend_axis(self, coord: Coord, entry: dict[str, Any], stored: DataFrame, fresh: DataFrame, count: int, gen: str, insert: bool) -> dict[str, Any]:
        """New values of an axis: appended after the stored ones, or sorted in with ``insert``.

        An append writes the new values only; after many of them the axis is written as one generation again.
        """
        keys = list(coord.keys)
        if coord.sorted and insert:
            whole = axis(align.axis_union(stored, fresh, keys), keys)
            return self._write_axis(coord.name, whole, gen, entry["size"] + count)
        shape = T.StructType.fromJson(entry["type"])
        numbered = with_position(fresh, keys, rows=count).withColumn("pos", F.col("pos") + F.lit(entry["size"]))
        added = numbered.select(*[F.col(f.name).cast(f.dataType) for f in shape.fields])
        if len(entry["gens"]) < MAX_AXIS_GENERATIONS:
            return self._write_axis(coord.name, added, gen, count, entry)
        return self._write_axis(coord.name, stored.select(*shape.names).unionByName(added), gen, entry["size"] + count)

    # --- writing ---------------------------------------------------------------------------------------

    def update(self, df: DataFrame, order: str, policy: str = merge.COALESCE, out_of_range: str = "null_cell",
               strict: bool = False, insert: bool = False) -> UpdateResult:
        """Harmonize a table, align it to the stored coordinates and merge it.

        ``order`` names the column that says which of two rows for one cell is later. ``insert`` keeps update
        values between stored coordinates as new coordinates instead of interpolating to the stored ones.
        """
        result = harmonize(df, self.schema, order, out_of_range, strict, self._dictionaries())
        rows = materialize(result.cells, "update")
        cubes, problems = {}, [result.report]
        for coords in self.schema.cubes():
            cells, conflicts = cube_cells(rows, self.schema, coords, SEQ)
            cubes[coords] = cells
            if conflicts is not None:
                counted = conflicts.groupBy("variable").agg(F.count(F.lit(1)).alias("rows"))
                problems.append(counted.select("variable", F.lit("not_constant").alias("problem"), "rows"))
        report = problems[0]
        for part in problems[1:]:
            report = report.unionByName(part)
        report = materialize(report, "report")
        broken = report.where("problem = 'not_constant'").collect()
        if broken:
            raise ValueError(f"{self.path}: not constant along dropped dimensions: {[r['variable'] for r in broken]}")
        self.store.log_report(self.path, report)
        axes = {c: axis_values(rows, list(coord.keys)) for c, coord in self.schema.coords.items()}
        return self._merged(cubes, axes, report, policy, insert)

    def update_messages(self, df: DataFrame, order: str, message: str, policy: str = merge.COALESCE, out_of_range: str = "null_cell") -> tuple[UpdateResult, DataFrame]:
        """``update`` with the rows of several messages, without those that could not be merged by themselves.

        ``order`` is a struct column; its field ``message`` names the message of a row, and messages are merged as if one after the other, in the order of the fields up to that one. Returns the result
        and (message, reason) of the messages set aside: those with a variable that is not constant along a dropped dimension, and those with a new
        value on a coordinate that allows none. The number of jobs does not depend on the number of messages.
        """
        result = harmonize(df, self.schema, order, out_of_range, dictionaries=self._dictionaries())
        fields = result.cells.schema[SEQ].dataType.names
        turn = F.struct(*[F.col(SEQ)[f].alias(f) for f in fields[: fields.index(message) + 1]])
        rows = materialize(result.cells.withColumn(MESSAGE, F.col(SEQ)[message]).withColumn(TURN, turn), "update")
        all_keys = self.schema.keys_of(tuple(self.schema.coords))
        state, reduced, reasons = self._state(), {}, []
        for coords, variables in self.schema.cubes().items():
            keys, names = self.schema.keys_of(coords), [v.name for v in variables]
            if set(keys) != set(all_keys):
                values, conflicts = eliminate_dims(pivot_cells(rows, [MESSAGE, TURN, *all_keys], names, SEQ), [MESSAGE, TURN, *keys], names)
                reduced[coords] = materialize(values, "update")
                reasons.append(conflicts.select(MESSAGE, F.concat(F.lit("not constant along dropped dimensions: "), "variable").alias("reason")))
        for name, coord in self.schema.coords.items():
            if not coord.sorted and coord.step_limits.kind == "no_new" and name in state["axes"]:
                new = align.extension(rows, self.axis(name, state), list(coord.keys))
                reasons.append(new.select(MESSAGE, F.lit(f"{name}: new values are not allowed on an unsorted coordinate").alias("reason")))
        failed = rows.select(MESSAGE, F.lit("").alias("reason")).limit(0)
        for part in reasons:
            failed = failed.unionByName(part)
        failed = materialize(failed.groupBy(MESSAGE).agg(F.min("reason").alias("reason")), "failed")
        good = materialize(rows.join(failed, MESSAGE, "left_anti"), "update") if not failed.isEmpty() else rows
        cubes = {}
        for coords, variables in self.schema.cubes().items():
            keys, names = self.schema.keys_of(coords), [v.name for v in variables]
            # the value of a message is one for each cell; of several messages the last one that has it wins
            cells = pivot_cells(reduced[coords].join(failed, MESSAGE, "left_anti"), keys, names, TURN) if coords in reduced else pivot_cells(good, keys, names, SEQ)
            cubes[coords] = sparse(cells, names).select(*keys, *names)
        report = materialize(result.report, "report")
        self.store.log_report(self.path, report)
        axes = {c: axis_values(good, list(coord.keys)) for c, coord in self.schema.coords.items()}
        merged = self._merged(cubes, axes, report, policy, False)
        return merged, failed.withColumnRenamed(MESSAGE, "message")

    def update_cells(self, cubes: dict[tuple[str, ...], DataFrame], policy: str = merge.COALESCE, insert: bool = False) -> UpdateResult:
        """Merge cells that are in schema form already, after checking them against the schema."""
        # read several times below: for the axes, the touched buckets and the merge
        checked = {c: materialize(validate_cells(df, self.schema, c), "update") for c, df in cubes.items()}
        axes = {}
        for name, coord in self.schema.coords.items():
            keys = list(coord.keys)
            having = [df.select(*keys) for c, df in checked.items() if name in c]
            if having:
                values = having[0]
                for more in having[1:]:
                    values = values.unionByName(more)
                axes[name] = values.distinct()
        empty = self.spark.createDataFrame([], "variable string, problem string, rows bigint")
        return self._merged(checked, axes, empty, policy, insert)

    def _merged(self, *update: Any) -> UpdateResult:
        """``_merge``, with all events of the update appended at once, also when it fails."""
        try:
            return self._merge(*update)
        finally:
            self.store.flush_events()

    def _merge(self, cubes: dict[tuple[str, ...], DataFrame], axes: dict[str, DataFrame], report: DataFrame,
               policy: str, insert: bool) -> UpdateResult:
        if policy not in (merge.COALESCE, merge.OVERWRITE):
            raise ValueError(f"unknown policy {policy!r}")
        state = self._state()
        gen = f"{state['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        new = {"version": state["version"] + 1, "cubes": dict(state["cubes"]), "axes": dict(state["axes"]), "dicts": state.get("dicts", {})}
        result = UpdateResult(new["version"], report)
        stored_axes = {c: self.axis(c, state) for c in axes}
        first = {c: c not in state["axes"] for c in axes}
        targets, update_axes = {}, {}
        for name, values in axes.items():
            coord = self.schema.coords[name]
            if first[name]:
                new["axes"][name] = self._write_axis(name, axis(values, list(coord.keys)), gen)
                continue
            update_axes[name] = materialize(values, "axis")
            targets[name] = self._targets(coord, update_axes[name], stored_axes[name], policy, insert)
            if targets[name].ignored:
                self.store.note("ERROR", self.path, f"{name}: {targets[name].ignored} new values ignored, extension is not allowed")
            fresh = targets[name].extension
            count = fresh.count()
            result.new_values[name] = count
            if count:
                new["axes"][name] = self._extend_axis(coord, state["axes"][name], stored_axes[name], fresh, count, gen, insert)
            if not coord.sorted and coord.step_limits.kind == "limits":
                self.store.note("ERROR", self.path, f"{name}: step limits have no meaning on an unsorted coordinate")
        lost: list[tuple[str, str, int]] = []
        for coords, cells in cubes.items():
            watched: list[Observation] = []
            aligned = self._align(coords, cells, targets, update_axes, insert, watched)
            self._merge_cube(coords, aligned, targets, policy, state, new, gen, result, watched, lost)
        self._publish(new)
        if lost:
            rows = self.spark.createDataFrame(lost, "variable string, problem string, rows bigint")
            result.problems = result.problems.unionByName(rows)
            for variable, problem, count in lost:
                self.store.note("ERROR", self.path, f"{variable} {problem} {count}")
        return result

    def _targets(self, coord: Coord, update: DataFrame, stored: DataFrame, policy: str, insert: bool) -> align.Targets:
        if not coord.sorted:
            found = align.unsorted_targets(update, stored, coord, box=policy == merge.OVERWRITE)
        elif insert:
            keys = list(coord.keys)
            found = align.Targets(align.overlap(update, stored, keys), align.extension(update, stored, keys))
        else:
            found = align.sorted_targets(update, stored.select(*coord.keys), coord)
        return align.Targets(
            materialize(found.overlap, "axis"), materialize(found.extension, "axis"), found.ignored, found.low, found.high
        )

    def _align(self, coords: tuple[str, ...], cells: DataFrame, targets: dict[str, align.Targets],
               update_axes: dict[str, DataFrame], insert: bool, watched: list[Observation]) -> DataFrame:
        """Cells at the target coordinates. Dimensions whose targets are all update values need no interpolation.

        ``watched`` gets an observation for each dimension: the values of every variable that reach no target. They are known once the
        cells have been computed.
        """
        names = [c for c in cells.columns if c not in self.schema.keys_of(coords)]
        for name in coords:
            coord = self.schema.coords[name]
            if name not in targets or not coord.sorted or insert:
                continue
            key = list(coord.keys)
            wanted = targets[name].all()
            off_grid = not align.extension(wanted, update_axes[name], key).isEmpty()
            order = cells.columns
            watched.append(Observation(f"lost-{uuid.uuid4().hex}"))
            if not off_grid:
                cells = align.targeted(cells, wanted.select(*key), key, names, watched[-1]).select(*order)
                continue
            pairs = align.bracket(wanted, update_axes[name], key[0])
            others = [k for k in self.schema.keys_of(coords) if k != key[0]]
            cells = align.interpolate(cells, pairs, key[0], others, names, lost=watched[-1]).select(*order)
        return cells

    def _merge_cube(self, coords: tuple[str, ...], cells: DataFrame, targets: dict[str, align.Targets], policy: str,
                    state: dict[str, Any], new: dict[str, Any], gen: str, result: UpdateResult, watched: list[Observation],
                    lost: list[tuple[str, str, int]]) -> None:
        name = cube_id(coords)
        entry = state["cubes"].get(name)
        keys = self.schema.keys_of(coords)
        values = [c for c in cells.columns if c not in keys]
        if entry is None:
            cells = cells.select(*keys, *values)
            entry = {"span": self._span(coords), "type": json.loads(_fields(cells.schema).json())}
            if entry["span"] is None:
                cells = materialize(cells, "cells")
                depth = _depth(_size(cells), self.store.bucket_bytes)
                entry["leaves"] = list(range(1 << depth, 2 << depth))
            entry["buckets"], entry["bytes"] = self._write_cube(coords, cells, gen, entry)
            new["cubes"][name] = entry
            result.buckets[name] = len(entry["buckets"])
            return
        stored_type = T.StructType.fromJson(entry["type"])
        cells = materialize(cells.select(*[F.col(f.name).cast(f.dataType) for f in stored_type.fields]), "cells")
        counts = [o.get for o in watched]
        lost += [(v, "no_target", total) for v in values if (total := sum(c.get(v, 0) for c in counts))]
        box = [(list(self.schema.coords[c].keys), targets[c].overlap) for c in coords if c in targets]
        touched = self._placed(coords, cells, entry).select("bucket").distinct()
        lead = self._leading(coords)
        if policy == merge.OVERWRITE and lead is not None and lead.name in targets:
            touched = touched.union(self._placed(coords, targets[lead.name].overlap, entry).select("bucket")).distinct()
        # as many as the state file lists at most, which is read on the driver anyway
        buckets = list(map(int, entry["buckets"])) if policy == merge.OVERWRITE and lead is None else [r["bucket"] for r in touched.collect()]
        if not buckets:
            result.buckets[name] = 0
            return
        stored = self.cube(coords, buckets, state)
        if policy == merge.OVERWRITE:
            merged = merge.merge_overwrite(stored, cells, keys, values, box)
        else:
            merged = merge.merge_coalesce(stored, cells, keys, values)
        entry = dict(entry)
        if "leaves" in entry:
            # a rewritten leaf that has outgrown its size is split; all others stay as they are
            grown = {b: _depth(entry["bytes"].get(str(b), 0), self.store.bucket_bytes) for b in buckets}
            entry["leaves"] = sorted(child for leaf in entry["leaves"] for child in _split(leaf, grown.get(leaf, 0)))
        written, sizes = self._write_cube(coords, merged, gen, entry)
        gone = set(map(str, buckets))
        entry["buckets"] = {**{b: g for b, g in entry["buckets"].items() if b not in gone}, **written}
        entry["bytes"] = {**{b: n for b, n in entry["bytes"].items() if b not in gone}, **sizes}
        new["cubes"][name] = entry
        result.buckets[name] = len(written)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete generations that none of the newest ``keep`` versions uses; returns their folders.

        Generations of a version not published yet are left alone, a write may be under way.
        """
        current = self.version()
        used, kept = set(), range(max(1, current - keep + 1), current + 1)
        for number in kept:
            state = self.store.files.read_json(self._rel(f"_versions/v{number:06d}.json"))
            used |= {f"axis={c}/gen={g}" for c, e in state["axes"].items() for g in e["gens"]}
            used |= {f"dict={v}/gen={g}" for v, e in state.get("dicts", {}).items() for g in e["gens"]}
            used |= {f"cube={c}/bucket={b}/gen={g}" for c, e in state["cubes"].items() for b, g in e["buckets"].items()}
        removed = []
        for table in self.store.files.names(self.path):
            parents = [table] if table.startswith(("axis=", "dict=")) else []
            if table.startswith("cube="):
                parents = [f"{table}/{b}" for b in self.store.files.names(self._rel(table)) if b.startswith("bucket=")]
            for parent in parents:
                for gen in self.store.files.names(self._rel(parent)):
                    folder = f"{parent}/{gen}"
                    if gen.startswith("gen=") and int(gen[4:].split("-")[0]) <= current and folder not in used:
                        self.store.files.delete(self._rel(folder))
                        removed.append(folder)
        return removed

    def check_axes(self) -> DataFrame:
        """(coord, n): number of repeated values per axis; empty when all axes are unique."""
        state, parts = self._state(), []
        for name, coord in self.schema.coords.items():
            repeated = duplicates(self.axis(name, state), list(coord.keys))
            parts.append(repeated.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("coord"), "n"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.where("n > 0")


def _depth(size: int, limit: int) -> int:
    """Halvings that bring ``size`` bytes to those a bucket may have."""
    return max(0, math.ceil(math.log2(size / limit))) if size > 0 else 0


def _split(leaf: int, depth: int) -> list[int]:
    """The leaves below a leaf after ``depth`` more bits of the hash. A leaf is the low bits it stands for, with a one in front."""
    bits = leaf.bit_length() - 1
    low = leaf - (1 << bits)
    return [(1 << bits + depth) + (more << bits) + low for more in range(1 << depth)]


def _size(df: DataFrame) -> int:
    """Bytes of the files behind a table that was just read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cube_id(coords: tuple[str, ...]) -> str:
    return "+".join(c.replace(" ", "_") for c in coords) or "scalar"


def _bucket_of(value: Any, lead: Coord, span: float) -> int:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if isinstance(value, datetime):
        tick = lead.unit.tick if isinstance(lead.unit, DateTimeUnit) else "us"
        delta = value - datetime(1970, 1, 1)
        micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
        return math.floor((micros // TICKS[tick][1]) / span)
    return math.floor(value / span)


def validate_cells(df: DataFrame, schema: NodeSchema, coords: tuple[str, ...]) -> DataFrame:
    """Cells against the schema: a missing key or variable, or a coordinate the cube does not have, is an
    error; other extra columns are warned about and not stored. Rows without a key are dropped."""
    if coords not in schema.cubes():
        raise SchemaError(f"no variables over {coords}")
    keys = schema.keys_of(coords)
    names = [v.name for v in schema.cubes()[coords]]
    missing = [c for c in keys + names if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing} for {coords}")
    foreign = [c for c in df.columns if c in schema.keys_of(tuple(schema.coords)) and c not in keys]
    if foreign:
        raise SchemaError(f"undeclared dimensions {foreign} for {coords}")
    extra = [c for c in df.columns if c not in keys + names]
    if extra:
        log.warning("columns %s are not in the schema and are left out", extra)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.select(*keys, *names)


class Store:
    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.bucket_bytes = spark, root.rstrip("/"), bucket_bytes
        self.files = Files(spark, self.root)
        self.nodes: dict[str, Node] = {}
        self._reports: list[DataFrame] = []
        self._notes: list[tuple[datetime, str, str, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str, schema: NodeSchema | dict[str, Any] | None = None, bucket_bytes: int = BUCKET_BYTES) -> "Store":
        """Create a store or open it; a node that has a schema already keeps it, nodes new in ``schema`` are added."""
        store = cls(spark, root, bucket_bytes)
        if schema is None:
            if not store.files.exists("schema.json"):
                raise FileNotFoundError(f"no store at {root}")
            schema = store.files.read_json("schema.json")
        tree = schema if isinstance(schema, NodeSchema) else NodeSchema.from_dict(schema)
        store._add("", tree)
        return store

    def _add(self, path: str, tree: NodeSchema | None) -> None:
        name = f"{path}/schema.json" if path else "schema.json"
        below = f"{path}/" if path else ""
        children: dict[str, NodeSchema | None] = {}
        own = tree
        if self.files.exists(name):
            own = NodeSchema.from_dict(self.files.read_json(name))
            # nodes added after this schema was written have their own files only
            children = {c: None for c in self.files.names(path) if "=" not in c and not c.startswith(("_", ".")) and self.files.exists(f"{below}{c}/schema.json")}
        else:
            self.files.publish_json(name, tree.source)
        self.nodes[path] = Node(self, path, own)
        for schema in (own, tree):
            children |= schema.children if schema is not None else {}
        for child, sub in children.items():
            self._add(f"{below}{child}", sub)

    def node(self, path: str) -> Node:
        path = path.strip("/")
        if path not in self.nodes:
            raise KeyError(f"no node {path!r}")
        return self.nodes[path]

    def update_tree(self, frames: dict[str, DataFrame], order: str, **options: Any) -> dict[str, UpdateResult]:
        """Update the nodes named in a mapping, each in its own job."""
        return {path: self.node(path).update(df, order, **options) for path, df in frames.items()}

    # --- events ----------------------------------------------------------------------------------------

    def log_report(self, path: str, report: DataFrame) -> None:
        """Keep the rows of a quality report for the next ``flush_events``."""
        self._reports.append(report.select(
            F.current_timestamp().cast("timestamp_ntz").alias("time"),
            F.lit("ERROR").alias("level"),
            F.lit(path).alias("node"),
            F.concat_ws(" ", "variable", "problem", F.col("rows").cast("string")).alias("message"),
        ))

    def note(self, level: str, path: str, message: str) -> None:
        """Keep an event for the next ``flush_events``."""
        self._notes.append((datetime.now(timezone.utc).replace(tzinfo=None), level, path, message))

    def log_event(self, level: str, path: str, message: str) -> None:
        self.note(level, path, message)
        self.flush_events()

    def flush_events(self) -> None:
        """Append the events kept so far as one commit: their files first, then a small file that names the folders which make up the log.

        After ``EVENT_COMMITS`` appends the small folders are written as one; readers of the commit before still have theirs.
        """
        events = self.spark.createDataFrame(self._notes, EVENTS) if self._notes else None
        for report in self._reports:
            events = report if events is None else events.unionByName(report)
        self._reports, self._notes = [], []
        if events is None:
            return
        folder = f"batch={uuid.uuid4().hex}"
        events.write.parquet(f"{self.root}/_events/{folder}")
        while True:
            number, folders = self._event_log()
            small = [f for f in folders if f.startswith("batch=")]
            tail = [folder]
            if len(small) >= EVENT_COMMITS:
                tail = [f"all={uuid.uuid4().hex}"]
                whole = self.spark.read.schema(EVENTS).parquet(*[f"{self.root}/_events/{f}" for f in [*small, folder]])
                whole.hint("rebalance").write.parquet(f"{self.root}/_events/{tail[0]}")
                folders = [f for f in folders if f not in small]
            try:
                self.files.publish_json(f"_events/_commits/{number + 1:08d}.json", {"folders": [*folders, *tail]})
                return
            except FileExistsError:
                continue  # another node of the store has appended meanwhile

    def _event_log(self) -> tuple[int, list[str]]:
        """Number and folders of the last commit."""
        numbers = [int(n[:-5]) for n in self.files.names("_events/_commits") if n.endswith(".json")]
        if not numbers:
            return 0, []
        return max(numbers), self.files.read_json(f"_events/_commits/{max(numbers):08d}.json")["folders"]

    def events(self) -> DataFrame:
        """``time, level, node, message, day`` of all committed events; a filter on the time reaches the files."""
        folders = self._event_log()[1]
        if folders:
            log = self.spark.read.schema(EVENTS).parquet(*[f"{self.root}/_events/{f}" for f in folders])
        else:
            log = self.spark.createDataFrame([], EVENTS)
        return log.withColumn("day", F.to_date("time"))

    # --- catalog ---------------------------------------------------------------------------------------

    def nodes_table(self) -> DataFrame:
        """(path, parent, children, arrays) of every node."""
        rows = [
            (p, p.rsplit("/", 1)[0] if "/" in p else ("" if p else None), len(n.schema.children),
             len(n.schema.coords) + len(n.schema.vars))
            for p, n in sorted(self.nodes.items())
        ]
        return self.spark.createDataFrame(rows, "path string, parent string, children int, arrays int")

    def find(self, pattern: str, name: str | None = None) -> DataFrame:
        return match_nodes(self.nodes_table(), pattern, store=name)

    def variables(self) -> DataFrame:
        """(path, variable, dims, unit, cells, missing): one aggregate per cube."""
        parts = []
        for path, node in sorted(self.nodes.items()):
            state = node._state()
            for coords, variables in node.schema.cubes().items():
                cells = node.cube(coords, None, state)
                entries = F.array(*[
                    F.struct(
                        F.lit(path).alias("path"), F.lit(v.name).alias("variable"), F.lit(",".join(coords)).alias("dims"),
                        F.lit(v.unit if isinstance(v.unit, str) else None).cast("string").alias("unit"),
                        F.col(v.name).alias("cells"), (F.col("_all") - F.col(v.name)).alias("missing"),
                    )
                    for v in variables
                ])
                counts = cells.agg(F.count(F.lit(1)).alias("_all"), *[F.count(v.name).alias(v.name) for v in variables])
                parts.append(counts.select(F.inline(entries)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def axes_table(self) -> DataFrame:
        """(path, coord, value) of every axis value, as text; input of views.coord_overview."""
        parts = []
        for path, node in sorted(self.nodes.items()):
            state = node._state()
            for name, coord in node.schema.coords.items():
                value = F.concat_ws(",", *[F.col(k).cast("string") for k in coord.keys])
                parts.append(node.axis(name, state).select(F.lit(path).alias("path"), F.lit(name).alias("coord"), value.alias("value")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def copy_tree(source: Store, target: Store, policy: str = merge.COALESCE) -> list[str]:
    """Copy every node through the target's schema; returns the nodes skipped because the target lacks them."""
    skipped = []
    for path, node in sorted(source.nodes.items()):
        if path not in target.nodes:
            log.warning("node %r is not in the target, skipped", path)
            skipped.append(path)
            continue
        if not node.version():
            continue
        there = target.node(path)
        wanted = there.schema.cubes()
        cubes = {c: df for c, df in node.read().items() if c in wanted}
        if cubes:
            there.update_cells(cubes, policy, insert=True)
    return skipped
