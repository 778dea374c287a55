"""Sequence packing by best-fit decreasing.

A document's ids (with the end-of-document id) are cut into full windows first; the remainders are
placed, longest first, into the open window with the least capacity that still holds them. A segment
tree over remaining capacities finds that window in logarithmic time.

Each input partition packs its own documents, so no row moves between tasks and a lost task gives the
same sequences again: a sequence id is the partition's number and a running number in it. At most one
window per partition and block of ``BLOCK`` remainders is poorly filled, a share that falls with size.

A null or empty text is one piece with the end id alone; repeated rows are packed one by one. Texts of any
length are tokenized whole. Ties: of remainders of one length the earlier row goes first, of windows with one
capacity the one that was used last. Empty tables give no rows. Only id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder, tokenizer_path

WINDOW = 1024
END_ID = 0
#: Remainders that are packed together (a bound on a task's memory).
BLOCK = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over capacities 0..size: which capacities have an open window?"""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of ``need`` or more."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each piece and the number of windows; 0 < length <= window."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(window), 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found = (window, used)
            used += 1
        capacity, place[i] = found
        offset[i] = window - capacity
        if capacity > need:
            tree.put(capacity - need, found[1])
    return place, offset, used


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum, and its place."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        ids_of = encoder(path)
        base = TaskContext.get().partitionId() << 33
        used = 0
        held: list[tuple] = []

        def rows_of(block):
            nonlocal used
            cols = [np.array([p[k] for p in block], np.int64) for k in range(1, 5)]
            full = cols[1] == window
            seq, off = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            seq[full] = used + np.arange(full.sum())
            used += int(full.sum())
            place, offset, n = best_fit_decreasing(cols[1][~full], window)
            seq[~full], off[~full] = used + place, offset
            used += n
            columns = [pa.array([p[0] for p in block], pa.int64()), *(pa.array(c) for c in cols), pa.array(base + seq), pa.array(off)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(ids_of.encode(text), np.array([end_id], "<u4")).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        held.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                if len(held) >= BLOCK:
                    yield rows_of(held)
                    held = []
        if held:
            yield rows_of(held)

    return rows.mapInArrow(run, SCHEMA)
