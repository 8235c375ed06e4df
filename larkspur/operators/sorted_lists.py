"""Short sorted lists of integers as bytes: packed by the differences of neighbours, and how many values two lists share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the longest varint.
WIDEST = 10


def packed_rows(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Bytes of each list: its first value and then the steps, seven bits a byte, the lowest first."""
    steps = np.diff(values, prepend=np.int64(0))
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    steps[firsts] = values[firsts]
    steps = steps.astype(np.uint64)
    size = np.ones(len(steps), np.int64)
    for k in range(1, WIDEST):
        size += steps >> np.uint64(7 * k) > 0
    stops = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(stops[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        part = (steps[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[stops[has] + k] = part | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    places = stops[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of packed lists, in order; nulls are empty."""
    column = pc.fill_null(column, b"")
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    steps = np.bitwise_or.reduceat((raw & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64), starts).astype(np.int64)
    first = np.searchsorted(starts, offsets)  # number of each list's first value
    row = np.repeat(np.arange(len(column)), np.diff(first))
    total = np.cumsum(steps)  # wraps, and so do the differences
    return row, total - (total - steps)[first[:-1][row]]


def shared_rows(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many values the packed lists of each row share."""
    (row_a, a), (row_b, b) = unpacked_rows(left), unpacked_rows(right)
    if not len(a) or not len(b):
        return np.zeros(len(left), np.int64)
    low, high = int(min(a.min(), b.min())), int(max(a.max(), b.max()))
    width = high - low + 1
    if width * len(left) < 1 << 62:
        a, b = a - low, b - low
    else:
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b, width = at[: len(a)], at[len(a) :], len(names)
    keys, others = row_a * width + a, row_b * width + b
    place = np.minimum(np.searchsorted(others, keys), len(others) - 1)
    return np.bincount(row_a[others[place] == keys], minlength=len(left))


def packed(values: Column) -> Column:
    """Bytes of a sorted array of bigints without nulls."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int64()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return packed_rows(offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))

    return pack(values)


def shared(left: Column, right: Column) -> Column:
    """How many values two packed lists share, 0 with a null."""

    @F.arrow_udf("bigint")
    def count(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array(shared_rows(one, other), pa.int64())

    return count(left, right)
