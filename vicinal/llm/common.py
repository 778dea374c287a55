"""Helpers shared by the corpus operators: shared-folder tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import materialize, shared_folder

__all__ = ["append_columns", "buffers", "materialize", "release", "run_starts", "shared_folder", "slices", "spread", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: F.Column | str) -> F.Column:
    """UTF-8 bytes of a text; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column as numpy views; nulls are empty.

    ``offsets`` has one entry more than the column and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = column.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    if not len(large):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = large.buffers()
    offsets = np.frombuffer(off, np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    values = batch.column(batch.schema.get_field_index(column))
    if not (pa.types.is_string(values.type) or pa.types.is_large_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)):
        yield batch
        return
    _, off = buffers(values)
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield batch.slice(start, stop - start)
        start = stop


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where any of the sorted key columns changes."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Gives a worker's free memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def append_columns(docs: DataFrame, keep: list[str] | None, inputs: list[F.Column], compute, new: str, limit: int = 8 << 20) -> DataFrame:
    """``docs`` with columns computed from Arrow batches.

    ``keep`` names the columns of ``docs`` to return (all, if None). ``inputs`` are evaluated by Spark
    and handed to ``compute`` as a list of arrays; it returns the new columns, whose schema is ``new``.
    Batches are cut by the bytes of the first input. Columns called like a new one are left out.
    """
    new_names = {c.strip().rsplit(" ", 1)[0].strip("`").lower() for c in new.split(",")}
    columns = [c for c in docs.columns if c.lower() not in new_names] if keep is None else keep
    rows = docs.select(*(F.col(f"`{c}`") for c in columns), *(c.alias(f"__in{i}") for i, c in enumerate(inputs)))
    n = len(columns)
    names = [c.strip().rsplit(" ", 1)[0].strip("`") for c in new.split(",")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__in0", limit):
                found = compute([part.column(i) for i in range(n, part.num_columns)])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *found], [*columns, *names])
        release()

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, out + new)
