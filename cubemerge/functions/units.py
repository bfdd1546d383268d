"""Physical units, resolved on the driver to one linear expression per column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("m", "kg", "s", "K", "A", "mol", "cd", "bool")


class UnitError(ValueError):
    """Unknown unit, or two units of different dimension."""


@dataclass(frozen=True)
class Unit:
    """value_in_base = value * scale + offset, for the given exponents of the base dimensions."""

    dims: tuple[int, ...]
    scale: float
    offset: float = 0.0


def _dims(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


# SI base and derived units, and the common non-SI units of field measurements.
_BASE = {
    "": Unit(_dims(), 1.0),
    "dimensionless": Unit(_dims(), 1.0),
    "m": Unit(_dims(m=1), 1.0),
    "meter": Unit(_dims(m=1), 1.0),
    "metre": Unit(_dims(m=1), 1.0),
    "g": Unit(_dims(kg=1), 1e-3),
    "gram": Unit(_dims(kg=1), 1e-3),
    "t": Unit(_dims(kg=1), 1e3),
    "s": Unit(_dims(s=1), 1.0),
    "sec": Unit(_dims(s=1), 1.0),
    "second": Unit(_dims(s=1), 1.0),
    "min": Unit(_dims(s=1), 60.0),
    "minute": Unit(_dims(s=1), 60.0),
    "h": Unit(_dims(s=1), 3600.0),
    "hour": Unit(_dims(s=1), 3600.0),
    "d": Unit(_dims(s=1), 86400.0),
    "day": Unit(_dims(s=1), 86400.0),
    "week": Unit(_dims(s=1), 604800.0),
    "year": Unit(_dims(s=1), 31557600.0),
    "K": Unit(_dims(K=1), 1.0),
    "kelvin": Unit(_dims(K=1), 1.0),
    "degC": Unit(_dims(K=1), 1.0, 273.15),
    "celsius": Unit(_dims(K=1), 1.0, 273.15),
    "degF": Unit(_dims(K=1), 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "A": Unit(_dims(A=1), 1.0),
    "mol": Unit(_dims(mol=1), 1.0),
    "cd": Unit(_dims(cd=1), 1.0),
    "bool": Unit(_dims(bool=1), 1.0),
    "boolean": Unit(_dims(bool=1), 1.0),
    "rad": Unit(_dims(), 1.0),
    "radian": Unit(_dims(), 1.0),
    "deg": Unit(_dims(), 0.017453292519943295),
    "degree": Unit(_dims(), 0.017453292519943295),
    "%": Unit(_dims(), 0.01),
    "percent": Unit(_dims(), 0.01),
    "ppm": Unit(_dims(), 1e-6),
    "Hz": Unit(_dims(s=-1), 1.0),
    "N": Unit(_dims(kg=1, m=1, s=-2), 1.0),
    "Pa": Unit(_dims(kg=1, m=-1, s=-2), 1.0),
    "bar": Unit(_dims(kg=1, m=-1, s=-2), 1e5),
    "atm": Unit(_dims(kg=1, m=-1, s=-2), 101325.0),
    "J": Unit(_dims(kg=1, m=2, s=-2), 1.0),
    "W": Unit(_dims(kg=1, m=2, s=-3), 1.0),
    "V": Unit(_dims(kg=1, m=2, s=-3, A=-1), 1.0),
    "ohm": Unit(_dims(kg=1, m=2, s=-3, A=-2), 1.0),
    "S": Unit(_dims(kg=-1, m=-2, s=3, A=2), 1.0),
    "C": Unit(_dims(A=1, s=1), 1.0),
    "l": Unit(_dims(m=3), 1e-3),
    "L": Unit(_dims(m=3), 1e-3),
    "liter": Unit(_dims(m=3), 1e-3),
}

# SI prefixes.
_PREFIX = {"T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}

_FACTOR = re.compile(r"([*/]?)\s*([A-Za-z%]+|1)\s*(?:(?:\*\*|\^)\s*(-?\d+))?\s*")


def _atom(name: str) -> Unit:
    if name == "1":
        return _BASE[""]
    if name in _BASE:
        return _BASE[name]
    if len(name) > 1 and name[0] in _PREFIX and name[1:] in _BASE and not _BASE[name[1:]].offset:
        base = _BASE[name[1:]]
        return Unit(base.dims, base.scale * _PREFIX[name[0]])
    if name.endswith("s") and name[:-1] in _BASE:
        return _BASE[name[:-1]]
    raise UnitError(f"unknown unit {name!r}")


def parse_unit(text: str | None) -> Unit:
    """``"g/m^3"``, ``"W/m**2"``, ``"degC"``, ``"hPa"`` ...; None is dimensionless."""
    text = (text or "").strip()
    if text in _BASE:
        return _BASE[text]
    dims, scale, offset, pos, count = [0] * len(DIMENSIONS), 1.0, 0.0, 0, 0
    while pos < len(text):
        match = _FACTOR.match(text, pos)
        if not match:
            raise UnitError(f"cannot read unit {text!r}")
        op, name, power = match.groups()
        atom, exponent = _atom(name), int(power or 1)
        exponent = -exponent if op == "/" else exponent
        dims = [a + b * exponent for a, b in zip(dims, atom.dims)]
        scale *= atom.scale**exponent
        offset, count, pos = atom.offset, count + 1, match.end()
    return Unit(tuple(dims), scale, offset if count == 1 else 0.0)


def conversion(source: str | None, target: str | None) -> tuple[float, float]:
    """(a, b) such that target_value = source_value * a + b."""
    src, dst = parse_unit(source), parse_unit(target)
    if src.dims != dst.dims:
        raise UnitError(f"cannot convert {source!r} to {target!r}")
    return src.scale / dst.scale, (src.offset - dst.offset) / dst.scale


def convert_value(value: float, source: str | None, target: str | None) -> float:
    """Driver-side conversion of one schema constant (interval bounds, steps)."""
    a, b = conversion(source, target)
    return value * a + b


def convert_unit(col: Column, source: str | None, target: str | None) -> Column:
    """Convert a numeric column; a no-op conversion returns the column itself."""
    a, b = conversion(source, target)
    out = col if a == 1.0 else col * F.lit(a)
    return out if b == 0.0 else out + F.lit(b)
