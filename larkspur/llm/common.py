"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.storage import materialize, release

__all__ = ["materialize", "release"]  # of the library, for this subpackage's operators

#: Bytes of text that a vectorised step works on at a time; its arrays take some dozen times as much.
SLICE_BYTES = 512 << 10
#: Bytes of a table that may be broadcast, as rows times the bytes of a row; beyond it joins shuffle.
BROADCAST_BYTES = 8 << 20

#: Lower-cases A-Z and turns every ASCII byte outside 0-9, A-Z, a-z into a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def row_bytes(df: DataFrame) -> int:
    """About how many bytes a row takes in a broadcast table: fixed types by their sizes, short strings and keys as 64."""
    sizes = {"int": 8, "bigint": 8, "double": 8, "boolean": 8, "smallint": 8}
    return 48 + sum(sizes.get(kind, 64) for _, kind in df.dtypes)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows take few bytes; else as it is, for a shuffled join.

    For tables of numbers, keys and short strings only.
    """
    return F.broadcast(df) if rows * row_bytes(df) <= BROADCAST_BYTES else df


def give_back() -> None:
    """Returns what a task's arrays have left in the allocators to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def by_place(docs: DataFrame, work: Callable[[DataFrame], DataFrame], own: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs' columns of work(docs), for which they are named by their places (``own`` ones apart), so that no name can clash."""
    plain = [name if name in own else f"at_{i}" for i, name in enumerate(docs.columns)]
    return work(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns can't clash."""
    return df.select("doc_id", "text")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id order, nulls first; equal doc_ids in the order of their texts' MD5.

    Ranges are cut by both, so that many rows of one doc_id (or of none) spread over tasks; the cut points that the
    driver samples hold a digest, never a text.
    """
    tie = F.md5("text")
    return documents(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start, n = 0, batch.num_rows
    while start < n:
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_arrow(
    df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = SLICE_BYTES
) -> DataFrame:
    """mapInArrow over runs of rows of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield one(part)
        give_back()

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys ends; the input is sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        last = values[-1]
        n = int(pc.sum(pc.cast(pc.equal(values, last), pa.int64())).as_py())
        if n == batch.num_rows and held and held[-1].column(key)[-1] == last:
            held.append(batch)
            continue
        if n == batch.num_rows:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
            continue
        held.append(batch.slice(0, batch.num_rows - n))
        yield pa.Table.from_batches(held)
        held = [batch.slice(batch.num_rows - n)]
    if held:
        yield pa.Table.from_batches(held)


def labels_of_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes, the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label
