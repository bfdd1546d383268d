"""Words of Arrow text columns and 64-bit hashes of words and word sequences, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes a word may hold; UTF-8 continuation and lead bytes are above 0x7F, so both classes can be told by the byte
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, 9, 10, 11, 12, 13]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[0x30:0x3A] = LETTERS_DIGITS[0x61:0x7B] = LETTERS_DIGITS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents 0 to n - 1."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        made = []
        for base in (_BASE, _UNBASE):
            each = np.full(size, base, np.uint64)
            each[0] = 1
            made.append(np.cumprod(each))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hash of any span of a sequence of 64-bit values in constant time, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self._unpower = _power(n + 1)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self._prefix[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self._prefix[end] - self._prefix[start]) * self._unpower[start] + size * _BASE)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` values, also those across rows."""
        n = max(0, len(self._prefix) - k)
        return mix((self._prefix[k : k + n] - self._prefix[:n]) * self._unpower[:n] + np.array([k], np.uint64) * _BASE)


class Words:
    """Words of a text column: byte range of each word, and ``first[r]:first[r + 1]`` as the words of row ``r``."""

    def __init__(self, texts: pa.Array, allowed: np.ndarray, lower: bool):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if data is None or bounds[-1] == bounds[0]:
            self.bytes = np.zeros(0, np.uint8)
        else:
            self.bytes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        self.rows = bounds - bounds[0]
        if lower:
            self.bytes = LOWER[self.bytes]
        n = len(self.bytes)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = allowed[self.bytes]
        border = np.zeros(n + 1, bool)
        border[self.rows] = True
        here = inside[1:-1]
        self.start = np.flatnonzero(here & (~inside[:-2] | border[:-1]))
        self.end = np.flatnonzero(here & (~inside[2:] | border[1:])) + 1
        self.first = np.searchsorted(self.start, self.rows)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return Rolling(_BYTE[LOWER[self.bytes] if lower else self.bytes]).span(self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` text bytes, so that arrays per byte stay small. A longer text is
    a piece of its own: whole texts are always processed together."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    if reach < width:
        shift = width - reach
        out = np.minimum(out[: max(0, len(out) - shift)], out[shift:])
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` members: the group and the number within the group of each member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
