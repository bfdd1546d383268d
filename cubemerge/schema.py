"""Dataset schemas: plain dataclasses read on the driver from a dict (YAML or JSON file)."""

from __future__ import annotations

import json
import math
import re
import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

RESERVED = ("ATTRS", "COORDS", "VARS")

# Declared type -> Spark type. Unsigned 64-bit needs a decimal, bool is stored as a byte.
TYPES: dict[str, T.DataType] = {
    "bool": T.ByteType(),
    "int": T.LongType(),
    "int8": T.ByteType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint": T.DecimalType(20, 0),
    "uint8": T.ShortType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.DoubleType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}

# Valid range of the integer types.
INT_BOUNDS = {
    "bool": (-128, 127),
    "int": (-(2**63), 2**63 - 1),
    "int8": (-128, 127),
    "int32": (-(2**31), 2**31 - 1),
    "int64": (-(2**63), 2**63 - 1),
    "uint": (0, 2**64 - 1),
    "uint8": (0, 255),
    "uint32": (0, 2**32 - 1),
    "uint64": (0, 2**64 - 1),
}

COMPLEX = {"complex": "double", "complex128": "double", "complex64": "float"}
DEFAULT_TEXT_LENGTH = 32
DEFAULT_CHUNK = 1024


class SchemaError(ValueError):
    """The schema itself is wrong."""


@dataclass(frozen=True)
class DateTimeUnit:
    tick: str = "us"
    tz: str | None = None
    dayfirst: bool = False
    yearfirst: bool = True


UnitSpec = str | DateTimeUnit | None


@dataclass(frozen=True)
class StepLimits:
    """Extension rule of a coordinate: ``no_new``, ``any_new`` or steps within [start, end]."""

    kind: str
    start: float | None = None
    end: float | None = None
    unit: str | None = None


def _none(value: Any) -> Any:
    if value == "None":
        warnings.warn('the text "None" is read as null', stacklevel=3)
        return None
    return value


def _unit(value: Any) -> UnitSpec:
    value = _none(value)
    return DateTimeUnit(**value) if isinstance(value, dict) else value


def text_length(type_name: str | None) -> int | None:
    """n of ``str[n]``; plain ``str`` gets the default length with a warning."""
    match = re.fullmatch(r"str(?:\[(\d+)\])?", type_name or "")
    if not match:
        return None
    if match.group(1) is None or int(match.group(1)) <= 0:
        warnings.warn(f"type {type_name!r} has no valid length, using str[{DEFAULT_TEXT_LENGTH}]", stacklevel=2)
        return DEFAULT_TEXT_LENGTH
    return int(match.group(1))


def spark_type(type_name: str | None) -> T.DataType | None:
    """Storage type of a declared type; None means "keep the source type"."""
    if type_name is None:
        return None
    if type_name in TYPES:
        return TYPES[type_name]
    if type_name in COMPLEX:
        part = T.DoubleType() if COMPLEX[type_name] == "double" else T.FloatType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    if re.fullmatch(r"str(\[\d+\])?", type_name):
        return T.StringType()
    if re.fullmatch(r"datetime64(\[\w+\])?", type_name):
        return T.TimestampNTZType()
    raise SchemaError(f"unsupported value type {type_name!r}")


@dataclass(frozen=True)
class Variable:
    name: str
    coords: tuple[str, ...] = ()
    unit: UnitSpec = None
    type: str | None = None
    na_value: Any = None
    df_col: str = ""
    source_unit: UnitSpec = None
    labels: tuple[Any, ...] | None = None
    label_table: str | None = None
    interval: tuple[Any, Any, str | None] | None = None
    description: str | None = None

    @property
    def is_datetime(self) -> bool:
        return isinstance(self.unit, DateTimeUnit) or (self.type or "").startswith("datetime64")

    @property
    def is_coded(self) -> bool:
        """Stored as codes of labels, which the schema lists or has in a table of the store."""
        return self.labels is not None or self.label_table is not None

    @property
    def storage_type(self) -> T.DataType:
        if self.is_coded:
            return T.LongType()
        if self.is_datetime:
            return T.TimestampNTZType()
        if self.type is None:
            # a unit without a type means floating point; nothing declared means text is kept as it is
            return T.DoubleType() if self.unit is not None else T.StringType()
        return spark_type(self.type)


@dataclass(frozen=True)
class Coord(Variable):
    composed: tuple[str, ...] = ()
    chunk_size: int = DEFAULT_CHUNK
    step_limits: StepLimits = StepLimits("any_new")
    sorted: bool = True
    bucket_span: float | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        """Columns that identify one value: the components of a composed coordinate, else itself."""
        return self.composed or (self.name,)

    @property
    def is_composed(self) -> bool:
        return len(self.composed) > 1


def _interval(spec: Any) -> tuple[Any, Any, str | None] | None:
    """Bounds and unit of an allowed range.

    Nothing given means that no value is allowed, an empty list that every value is. One bound stands for both; a third
    entry is the unit of the bounds.
    """
    match spec:
        case None:
            return -math.inf, -math.inf, None
        case []:
            return -math.inf, math.inf, None
        case [low, high, unit]:
            return low, high, unit
        case [low, high]:
            return low, high, None
        case [only]:
            return only, only, None
        case list() | tuple():
            raise SchemaError(f"an interval has two bounds and a unit at most: {spec}")
    return spec, spec, None


def _step_limits(spec: Any) -> StepLimits:
    spec = _none(spec)
    if spec is None or spec == "no_new":
        return StepLimits("no_new")
    if spec == "any_new" or spec == []:
        return StepLimits("any_new")
    if isinstance(spec, dict):
        spec = [spec["start"], spec["end"], spec.get("unit")]
    if not isinstance(spec, (list, tuple)) or len(spec) < 2:
        raise SchemaError(f"invalid step_limits {spec!r}")
    if spec[0] > spec[1]:
        raise SchemaError(f"invalid step_limits: {spec[0]} > {spec[1]}")
    return StepLimits("limits", spec[0], spec[1], spec[2] if len(spec) > 2 else None)


def _common(name: str, spec: dict[str, Any]) -> dict[str, Any]:
    unit = _unit(spec.get("unit"))
    source = _unit(spec.get("source_unit"))
    rng = _none(spec.get("range")) or {}
    coords = _none(spec.get("coords")) or ()
    labels = rng.get("discrete")
    # a text names a table: a delimited file with the labels, or labels added to the store under that name
    table = labels if isinstance(labels, str) else None
    type_name = _none(spec.get("type"))
    if type_name is not None:
        spark_type(type_name)
    return dict(
        name=name,
        coords=(coords,) if isinstance(coords, str) else tuple(coords),
        unit=unit,
        type=type_name,
        na_value=spec.get("na_value"),
        df_col=spec.get("df_col") or name,
        source_unit=source if source is not None else unit,
        labels=tuple(labels) if isinstance(labels, (list, tuple)) else None if table else labels,
        label_table=table,
        interval=_interval(rng["interval"]) if "interval" in rng else None,
        description=spec.get("description"),
    )


@dataclass(frozen=True)
class NodeSchema:
    """One node of the tree: attributes, coordinates, variables and child nodes."""

    attrs: dict[str, Any] = field(default_factory=dict)
    coords: dict[str, Coord] = field(default_factory=dict)
    vars: dict[str, Variable] = field(default_factory=dict)
    children: dict[str, "NodeSchema"] = field(default_factory=dict)
    source: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> "NodeSchema":
        coord_specs = {k: dict(v or {}) for k, v in (spec.get("COORDS") or {}).items()}
        var_specs = {k: dict(v or {}) for k, v in (spec.get("VARS") or {}).items() if k not in coord_specs}
        for var_spec in var_specs.values():
            mentioned = _none(var_spec.get("coords")) or ()
            for coord in (mentioned,) if isinstance(mentioned, str) else mentioned:
                coord_specs.setdefault(coord, {})
        coords = {}
        for name, item in coord_specs.items():
            merge = item.get("merge") or {}
            if "step_limits" in merge and "step_limits" not in item:
                warnings.warn(f"{name}: step_limits nested under merge", stacklevel=2)
                item["step_limits"] = merge["step_limits"]
            composed = tuple(_none(item.get("composed")) or ())
            composed = composed if len(composed) > 1 else ()
            is_sorted = _none(item.get("sorted"))
            chunk = _none(item.get("chunk_size"))
            common = _common(name, item)
            common["coords"] = common["coords"] or (name,)
            coords[name] = Coord(
                **common,
                composed=composed,
                chunk_size=int(chunk) if chunk else DEFAULT_CHUNK,
                step_limits=_step_limits(item["step_limits"]) if "step_limits" in item else StepLimits("any_new"),
                sorted=bool(is_sorted) if is_sorted is not None else not composed,
                bucket_span=item.get("bucket_span"),
            )
        variables = {k: Variable(**_common(k, v)) for k, v in var_specs.items() if k not in coords}
        for coord in coords.values():
            for part in coord.composed:
                if part not in variables:
                    raise SchemaError(f"{coord.name}: component {part!r} is not a declared variable")
        children = {k: cls.from_dict(v) for k, v in spec.items() if k not in RESERVED and isinstance(v, dict)}
        return cls(dict(spec.get("ATTRS") or {}), coords, variables, children, spec)

    @classmethod
    def load(cls, path: str) -> "NodeSchema":
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as exc:
            raise SchemaError("reading YAML schemas needs PyYAML; use JSON instead") from exc
        return cls.from_dict(yaml.safe_load(text) or {})

    def walk(self, path: str = "") -> list[tuple[str, "NodeSchema"]]:
        """(path, node) for this node and all below, parents first; the root path is empty."""
        out = [(path, self)]
        for name, child in self.children.items():
            out += child.walk(f"{path}/{name}" if path else name)
        return out

    def component_names(self) -> set[str]:
        return {part for coord in self.coords.values() for part in coord.composed}

    def keys_of(self, coords: tuple[str, ...]) -> list[str]:
        """Key columns of a coordinate list."""
        return [key for name in coords for key in self.coords[name].keys]

    def cubes(self) -> dict[tuple[str, ...], list[Variable]]:
        """Variables grouped by coordinate list; components of composed coordinates are keys, not values."""
        parts, out = self.component_names(), {}
        for var in self.vars.values():
            if var.name not in parts:
                out.setdefault(var.coords, []).append(var)
        return out

    def key_variable(self, key: str) -> Variable:
        """Definition behind a key column (a plain coordinate or a component)."""
        return self.coords[key] if key in self.coords and not self.coords[key].is_composed else self.vars[key]

    def cube_type(self, coords: tuple[str, ...], variables: list[Variable]) -> T.StructType:
        keys = [T.StructField(k, self.key_variable(k).storage_type) for k in self.keys_of(coords)]
        return T.StructType(keys + [T.StructField(v.name, v.storage_type) for v in variables])

    def axis_type(self, coord: str) -> T.StructType:
        keys = [T.StructField(k, self.key_variable(k).storage_type) for k in self.coords[coord].keys]
        return T.StructType(keys + [T.StructField("pos", T.LongType())])
