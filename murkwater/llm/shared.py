"""What the text operators share: written tables, partition counts and packed exchanges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions.folder import written

__all__ = ["gathered", "packed", "partitions", "record", "records", "unpacked", "written"]


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for; it is meant to grow with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of ``values`` as binary values that end at ``bounds``."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.array(np.asarray(bounds, np.int64) * width, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def packed(part: np.ndarray, columns: dict[str, np.ndarray], lengths: np.ndarray | None = None, items: dict[str, np.ndarray] | None = None) -> dict[str, pa.Array]:
    """One row for each value of ``part``: the values of each column that go there, as bytes.

    Packed rows keep a shuffle of many small numbers compact and out of row-at-a-time code. With
    ``lengths`` each row is a run that owns so many consecutive values of ``items``; they go along.
    """
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    bounds = np.r_[starts, len(part)]
    out: dict[str, pa.Array] = {"part": pa.array(part[starts].astype(np.int32))}
    out |= {name: _bytes(values[order], bounds) for name, values in columns.items()}
    if lengths is not None:
        first = np.cumsum(lengths) - lengths
        lengths = lengths[order].astype(np.int64)
        ends = np.cumsum(lengths)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[order] - (ends - lengths), lengths)
        bounds = np.r_[0, ends][bounds]
        out |= {name: _bytes(values[index], bounds) for name, values in (items or {}).items()}
    return out


def record(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are missing are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)


def records(part: np.ndarray, columns: dict[str, np.ndarray], lengths: np.ndarray, items: dict[str, np.ndarray], schema: pa.Schema, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Runs packed by ``part`` as batches of about ``most`` runs and items: a batch's binary columns end at 2 GB."""
    ends = np.cumsum(lengths, dtype=np.int64)
    weights = ends + np.arange(1, len(lengths) + 1)
    lo = 0
    while lo < len(lengths):
        before = int(weights[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(weights, before + most, "right")))
        first, last = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
        yield record(packed(part[lo:hi], {n: v[lo:hi] for n, v in columns.items()}, lengths[lo:hi], {n: v[first:last] for n, v in items.items()}), schema)
        lo = hi


def unpacked(batches: Iterable[pa.RecordBatch], dtypes: dict[str, type]) -> dict[str, np.ndarray]:
    """All packed values of a partition, column by column."""
    found: dict[str, list[np.ndarray]] = {name: [] for name in dtypes}
    for batch in batches:
        for name, dtype in dtypes.items():
            for value in batch.column(name):
                if value.is_valid:
                    found[name].append(np.frombuffer(value.as_buffer(), dtype))
    return {name: np.concatenate(found[name]) if found[name] else np.empty(0, dtype) for name, dtype in dtypes.items()}


def gathered(batches: Iterable[pa.RecordBatch], most_bytes: int, text: str = "text") -> Iterator[pa.Table]:
    """Batches joined until their texts hold ``most_bytes``; a single longer batch is cut by rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = np.zeros(batch.num_rows, np.int64)
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows:
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1]
            lengths = np.diff(offsets).astype(np.int64)
        for row, length in enumerate(lengths.tolist()):
            if size and size + length > most_bytes:
                held.append(batch.slice(start, row - start))
                yield pa.Table.from_batches([x for x in held if x.num_rows], batch.schema)
                held, size, start = [], 0, row
            size += length
        held.append(batch.slice(start))
    if held and any(x.num_rows for x in held):
        yield pa.Table.from_batches([x for x in held if x.num_rows])
