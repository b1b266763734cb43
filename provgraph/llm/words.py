"""Words of Arrow text columns as numpy arrays of 64-bit hashes, without a Python object per word.

A word's hash is a polynomial in its bytes over the integers modulo 2**64, each byte first replaced
by a random odd number, then mixed. Equal words hash alike on every machine and in every process;
two given words of a corpus collide with a chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once.
WINDOW = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15


def _mask(separators: Iterable[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words as ``[^\x20\x09-\x0D]+``.
SPACED = _mask([32, *range(9, 14)])
#: Words as ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case: A-Z count as letters here.
ALNUM = _mask([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_powers: dict[str, np.ndarray] = {}


def _power(sign: str) -> np.ndarray:
    """Powers of the base ("+") or of its inverse ("-") up to WINDOW."""
    if sign not in _powers:
        base = _BASE if sign == "+" else pow(_BASE, -1, 2**64)
        steps = np.full(WINDOW + 1, base, dtype=U)
        steps[0] = 1
        _powers[sign] = np.multiply.accumulate(steps)
    return _powers[sign]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of the first word at or after it.

    ``data``: the bytes of all texts; ``offsets``: where each begins, and the end.
    """
    inside = word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def _long_hash(piece: np.ndarray) -> int:
    total = 0
    for at in range(0, len(piece), WINDOW):
        part = piece[at : at + WINDOW]
        with np.errstate(over="ignore"):
            block = int((_BYTES[part] * _power("+")[: len(part)]).sum(dtype=U))
        total = (total + block * pow(_BASE, at, 2**64)) % 2**64
    return total


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, A-Z counted as lower case; windows of words at a time."""
    out = np.empty(len(starts), dtype=U)
    first, n = 0, len(starts)
    while first < n:
        origin = int(starts[first])
        last = int(np.searchsorted(ends, origin + WINDOW, side="right"))
        if last <= first:
            out[first] = _long_hash(data[origin : int(ends[first])])
            first += 1
            continue
        part = data[origin : int(ends[last - 1])]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(_BYTES[part] * _power("+")[: len(part)], out=sums[1:])
        s, e = starts[first:last] - origin, ends[first:last] - origin
        out[first:last] = (sums[e] - sums[s]) * _power("-")[s]
        first = last
    return mix(out)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and where each text begins, and the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that this worker no longer uses back to the system; a worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in groups of about ``most`` bytes of text, each row whole, with their bytes and offsets."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        batch = data = offsets = None
    release()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class HashIndex:
    """Positions of 64-bit hashes in a sorted array of distinct ones, many at a time."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.keys = np.append(sorted_hashes.astype(U), U(2**64 - 1))
        self.n = len(sorted_hashes)
        self.bits = max(1, min(22, int(self.n).bit_length() + 1))
        top = (sorted_hashes >> U(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1))
        self.deep = int(np.diff(self.first).max()) if self.n else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each, or -1."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        top = (wanted >> U(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        for step in range(self.deep):
            here = at + step
            hit = (here < end) & (self.keys[np.minimum(here, self.n)] == wanted)
            out[hit] = here[hit]
        return out
