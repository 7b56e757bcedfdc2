"""Words of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these are ASCII, so that cutting the UTF-8 bytes
is the same as cutting the text. Nothing here works row by row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the n + 1 places where its rows begin and end."""
    column = column.fill_null("").cast(pa.large_binary())
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, places - places[0]


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def released(function: Callable) -> Callable:
    """``function`` over the batches of a task; memory that it has freed goes back to the system when the task ends."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, name: str = "text", most: int = (1 << 19) - 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least), so that memory stays bounded."""
    _, places = utf8(batch.column(batch.schema.get_field_index(name)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(places, places[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    give_back()


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, about ``most`` bytes each: what is combined before a shuffle has a wider view."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            yield from whole
            give_back()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Words:
    """The words of a column: bytes, where each word begins and ends, its row, and the first word of each row."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # n rows + 1

    def hashes(self) -> np.ndarray:
        """64 bits for each word; different words agree with a chance of about 2**-64."""
        return spans(self.data, self.begin, self.end)


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 7 << 15) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of one running sum of powers.

    ``begin`` must not fall. About ``most`` bytes are summed at a time, so that tables of powers stay small.
    """
    out = np.zeros(len(begin), np.uint64)
    cuts = np.searchsorted(begin, np.arange(0, len(data) + most, most))
    cuts[-1] = len(begin)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        low, high = int(begin[a]), int(end[a:b].max())
        power, inverse = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], dtype=np.uint64, out=total[1:])
        first, last = begin[a:b] - low, end[a:b] - low
        out[a:b] = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return out


def words(column: pa.Array, lower: bool = False) -> Words:
    data, places = utf8(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    begin = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    first = np.searchsorted(begin, places)
    row = np.repeat(np.arange(len(places) - 1), np.diff(first))
    return Words(data, begin, end, row, first)


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring values; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * _U(_BASE) + h[k : len(h) - n + 1 + k]
    return mix(total)


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and where each begins and ends in them."""
    size = end - begin
    places = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=places[1:])
    return data[np.arange(places[-1]) + np.repeat(begin - places[:-1], size)], places


def strings(data: np.ndarray, places: np.ndarray, text: bool = False) -> pa.Array:
    kind = pa.large_string() if text else pa.large_binary()
    return pa.Array.from_buffers(kind, len(places) - 1, [None, pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
