"""Texts as byte arrays inside tasks: word hashes and window hashes of many texts at once."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are handled together up to so many bytes; a longer text stands alone, whole.
SLICE = 1 << 21
_MULTIPLIER = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, U), np.ones(1, U)]

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task, until another is asked for.

    The package's code is sent to the workers by value, so its own globals last for one task only. A worker holds one
    object at a time: what one operator left behind goes when the next one's tasks come.
    """
    box = sys.modules.setdefault("_siftrow_worker_memory", types.ModuleType("_siftrow_worker_memory"))
    if getattr(box, "name", None) != name:
        box.name, box.held = name, None
        box.held = make()
    return box.held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * _MULTIPLIER)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums, of which `span_hashes` makes the hash of any span of data."""
    up, _ = powers(max(1, len(data)))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    _, down = powers(int(starts.max()) + 1)
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ mix((ends - starts).astype(U) + U(1)))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of texts as (bytes, offsets, first row): text i is bytes[offsets[i]:offsets[i + 1]]; null texts are empty."""
    column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (one more than texts).

    Words are runs of bytes other than blanks, or of the bytes that solid marks.
    """
    solid = ~BLANK[data] if solid is None else solid
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each element, the segment it lies in; bounds has one number more than segments."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
