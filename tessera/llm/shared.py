"""Storage shared by the driver and all executors, and the batch helpers that the operators use."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.storage import discard, fresh_dir, shared_dir, written

__all__ = ["discard", "fresh_dir", "few_rows", "give_back", "map_batches", "open_fs", "shared_dir", "sheltered", "slices", "text_bytes", "text_column", "written"]


def open_fs(uri: str):
    """(filesystem, path) of a URI, on a worker or on the driver; any file system that pyarrow knows."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])
    return found, path


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column with 64-bit offsets, nulls as empty strings."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and the rows' n + 1 offsets into it (no copy)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row stands alone, whole."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end
        row = end


def sheltered(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the used ones under names that clash with none, and a function that gives a frame df's columns again."""
    rest = {c: f"__column_{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.select(*used, *(df[c].alias(r) for c, r in rest.items())), lambda out: out.select(*(out[rest.get(c, c)].alias(c) for c in df.columns))


def give_back() -> None:
    """Workers live on from task to task; what one has freed should not count against the next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for steps that make Python objects of rows. Unused memory goes back to the system after each."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)
        give_back()


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; a batch for which it gives None yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 2500):
            if (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)

