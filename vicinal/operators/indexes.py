"""Indexes: from query features to matches (qid, qtag, object, dtag, distance, rank), cut by hint_R and hint_K."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.similarity import FLT_MAX, FLT_MIN_NORMAL, Similarity, dot
from ..plans.search import hint_topk, unique, within
from ..storage import materialize

#: Query features that may be broadcast at once.
QUERY_BLOCK = 5_000
#: Numbers that such a broadcast may hold.
QUERY_NUMBERS = 4 << 20
#: Objects whose counted words are scored at once.
OBJECTS = 2_000
#: Features of a side of a grid cell, beyond that.
CELL = 20_000
#: Numbers of entries that may be broadcast at once.
ENTRY_NUMBERS = 16 << 20
#: Queries that a task answers at once, pairs it compares at once, pairs measured one by one at once, matches it holds
#: for queries that want most entries, and rows of a batch it passes on.
BLOCK, TILE, PAIRS, HELD, OUT_ROWS = 1_024, 2 << 20, 1 << 13, 1 << 20, 1 << 16
#: Pairs of a block that are measured at once, in a processor's own memory.
PIECE = 1 << 14
#: Entries of a random group from which NN-descent takes its first neighbours, about.
GROUP = 5_000


def _blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in blocks of a checked size, dealt by their place, so that repeated ones spread."""
    n = queries.count()
    k = max(1, math.ceil(n / block))
    if k == 1:
        return [queries]
    keyed = materialize(queries.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2 * k))), "queries")
    return [keyed.where(F.col("__block") == i).drop("__block") for i in range(2 * k)]


def _measured(pairs: DataFrame, measure: Similarity, dim: int | None) -> DataFrame:
    d = measure.apply(F.col("feature"), F.col("qfeature"), dim).cast("double")
    return pairs.withColumn("distance", d).where(within(F.col("distance"), F.col("hint_R"), measure.polarity)).drop("feature", "qfeature")


def _scores(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of ``a`` against ``b``, whose first axis is the dimension (the others are broadcast against each other),
    summed dimension by dimension in double, as floats."""

    def total(term):
        out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
        for x, y in zip(a, b):
            out += term(x, y).astype(np.float64, copy=False)
        return out

    def size(a):
        out = np.zeros(a.shape[1:])
        for x in a:
            out += x.astype(np.float64) ** 2
        return np.sqrt(out)

    if name == "l1":
        d = total(lambda a, b: np.abs(a - b))
    elif name == "l2":
        d = np.sqrt(total(lambda a, b: (a - b).astype(np.float64) ** 2))
    elif name == "hamming":
        d = total(lambda a, b: np.bitwise_count(a ^ b))
    elif name == "type_hamming":
        d = total(lambda a, b: a != b)
    else:
        dot = total(lambda a, b: a.astype(np.float64) * b.astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            d = dot / (size(a) * size(b))
        normal = np.abs(d)
        d = np.where((normal >= FLT_MIN_NORMAL) & (normal <= FLT_MAX), d, -1.0)  # NaN fails both
    with np.errstate(over="ignore"):
        return d.astype(np.float32).astype(np.float64)


#: Measures that are computed batch by batch.
MEASURED = ("l1", "l2", "cosine", "hamming", "type_hamming")


def feature_matrix(column: pa.Array, kind, dim: int | None) -> np.ndarray:
    """Features as rows of a matrix; one that is null, of another length, or holds a null is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim or 1), kind)
    lengths = np.diff(column.offsets.to_numpy())
    dim = int(lengths[0]) if dim is None else dim
    flat = column.flatten()
    if column.null_count or flat.null_count or (lengths != dim).any():
        raise ValueError(f"a feature does not have {dim} values")
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


class Linear:
    """Every query feature against every entry. Null features take no part; one of another length is an error.

    Few queries (a checked number of rows and values) are broadcast, and entries stay where they are. For many queries
    the entries are broadcast if their values are few (checked), and a task has the whole answers of its queries. Else
    both are dealt to a grid: blocks of queries by blocks of entries, one task for each cell, all in one job. A
    task passes on only what can be among the hint_K nearest of a query, ties included. Features that are no arrays
    (words), and measures with parameters, are measured as columns.
    """

    #: Every entry inside the limits is found.
    exact = True

    def __init__(self, dim: int | None = None):
        self.dim = dim

    def search(self, queries: DataFrame, entries: DataFrame, measure: Similarity) -> DataFrame:
        queries, entries = queries.where("feature is not null"), entries.where("feature is not null")
        if not isinstance(entries.schema["feature"].dataType, ArrayType) or measure.name not in MEASURED:
            found = None
            for block in _blocks(queries):
                part = hint_topk(self._columns(block, entries, measure), measure.polarity)
                found = part if found is None else found.unionByName(part)
            return found
        dim = self.dim
        if dim is None:
            first = queries.select(F.size("feature")).first()
            dim = first[0] if first else 1
        n = queries.count()
        if n <= QUERY_BLOCK and n * dim <= QUERY_NUMBERS:
            return hint_topk(self._broadcast(queries, entries, measure, dim, n), measure.polarity)
        if entries.count() * dim <= ENTRY_NUMBERS:
            found = _resident(queries, entries, measure, dim, n)
            # a feature that is asked twice has one list
            return found if unique(queries, "qid", "qtag") else hint_topk(found.drop("rank"), measure.polarity)
        return hint_topk(self._grid(queries, entries, measure, dim, n), measure.polarity)

    def _columns(self, block: DataFrame, entries: DataFrame, measure: Similarity) -> DataFrame:
        asked = block.withColumnRenamed("feature", "qfeature")
        return _measured(entries.select("object", "dtag", "feature").crossJoin(F.broadcast(asked)), measure, self.dim)

    def _broadcast(self, queries: DataFrame, entries: DataFrame, measure: Similarity, dim: int, n: int) -> DataFrame:
        spark, kind = entries.sparkSession, _numbers(entries)
        asked = queries.toArrow()  # QUERY_BLOCK rows at most
        q = feature_matrix(asked["feature"], kind, dim)
        limits = asked["hint_R"].to_numpy().astype(float), np.minimum(asked["hint_K"].to_numpy(), 1 << 30).astype(int)
        rest = asked.drop_columns(["feature"])
        shared = spark.sparkContext.broadcast((q, *limits, rest))
        sign, name = -measure.polarity, measure.name

        def run(batches):
            q, radius, k, rest = shared.value
            for batch in batches:
                batch, tied = _in_order(batch)
                x = feature_matrix(batch.column(2), kind, dim)
                for row, col, d, _ in _nearest(name, sign, x, q, radius, k, tied):
                    yield from _pairs(batch.select([0, 1]), rest, row, col, d)

        return entries.select("object", "dtag", "feature").mapInArrow(run, _pair_schema(entries, queries))

    def _grid(self, queries: DataFrame, entries: DataFrame, measure: Similarity, dim: int, n: int) -> DataFrame:
        kind, sign, name = _numbers(entries), -measure.polarity, measure.name
        across, down = math.ceil(n / CELL), max(1, math.ceil(entries.count() / CELL))
        rest = [f for f in queries.schema if f.name != "feature"]
        cut = lambda parts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        null = lambda f, name: F.lit(None).cast(f.dataType).alias(name)
        feature = F.col("feature").cast(entries.schema["feature"].dataType).alias("__f")
        own = [entries.schema["object"], entries.schema["dtag"]]
        # one frame of both sides: in a cogroup, sides that stem from one column lose it
        left = entries.select(*(F.col(f.name).alias(f"__o{i}") for i, f in enumerate(own)), *(null(f, f"__r{i}") for i, f in enumerate(rest)), feature, F.lit(False).alias("__asked"), cut(down).alias("__e")).withColumn("__q", every(across))
        right = queries.select(*(null(f, f"__o{i}") for i, f in enumerate(own)), *(F.col(f.name).alias(f"__r{i}") for i, f in enumerate(rest)), feature, F.lit(True).alias("__asked"), cut(across).alias("__q")).withColumn("__e", every(down))
        names = [f.name for f in rest]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(batches)
            left = cell.filter(pc.invert(cell["__asked"])).select(["__o0", "__o1", "__f"]).rename_columns(["object", "dtag", "feature"])
            right = cell.filter(cell["__asked"]).select([f"__r{i}" for i in range(len(names))] + ["__f"]).rename_columns([*names, "feature"])
            del cell
            left, tied = _in_order(left)
            x, q = feature_matrix(left["feature"], kind, dim), feature_matrix(right["feature"], kind, dim)
            radius, k = right["hint_R"].to_numpy().astype(float), np.minimum(right["hint_K"].to_numpy(), 1 << 30).astype(int)
            for row, col, d, _ in _nearest(name, sign, x, q, radius, k, tied):
                yield from _pairs(left.select(["object", "dtag"]), right.select(names), row, col, d)

        return left.unionByName(right).groupBy("__q", "__e").applyInArrow(run, _pair_schema(entries, queries))


def _resident(queries: DataFrame, entries: DataFrame, measure: Similarity, dim: int, n: int, codes=None) -> DataFrame:
    """Ranked matches of many queries, with all entries (few, checked) broadcast in the order of ties.

    ``codes`` makes a matrix of codes of one of features, a column for each table: only pairs that share one are then
    compared.
    """
    spark, kind = entries.sparkSession, _numbers(entries)
    held = entries.select("object", "dtag", "feature").orderBy("object", "dtag").toArrow().combine_chunks()
    x = feature_matrix(held["feature"], kind, dim)
    tables = None if codes is None else _buckets(codes(x))
    shared = spark.sparkContext.broadcast((x, tables, held.select(["object", "dtag"])))
    sign, name = -measure.polarity, measure.name
    rest = [c for c in queries.columns if c != "feature"]

    def run(batches):
        x, tables, own = shared.value
        for batch in batches:
            q = feature_matrix(batch["feature"], kind, dim)
            radius, k = batch["hint_R"].to_numpy(zero_copy_only=False).astype(float), np.minimum(batch["hint_K"].to_numpy(), 1 << 30).astype(int)
            asked = None if tables is None else codes(q)
            for row, col, d, rank in _nearest(name, sign, x, q, radius, k, True, tables, asked):
                yield from _pairs(own, batch.select(rest), row, col, d, rank)

    # enough tasks for all cores, each with enough queries for whole blocks
    parts = max(spark.sparkContext.defaultParallelism * 4, math.ceil(n / QUERY_BLOCK))
    return queries.repartition(parts).select(*rest, "feature").mapInArrow(run, StructType([*_pair_schema(entries, queries), StructField("rank", IntegerType())]))


def _buckets(codes: np.ndarray) -> list:
    """For each table: its codes in order, where each one's rows start, and the rows."""
    out = []
    for column in codes.T:
        rows = np.argsort(column, kind="stable")
        names, starts = np.unique(column[rows], return_index=True)
        out.append((names, np.append(starts, len(rows)), rows))
    return out


def _in_order(entries):
    """(entries in the order that decides ties, whether they are): Arrow orders whole numbers and strings as Spark does."""
    kinds = [entries.schema.field(c).type for c in ("object", "dtag")]
    if not all(pa.types.is_integer(t) or pa.types.is_string(t) for t in kinds):
        return entries, False
    keys = pa.table([entries.column(0), entries.column(1)], names=["object", "dtag"])
    return entries.take(pc.sort_indices(keys, sort_keys=[("object", "ascending"), ("dtag", "ascending")], null_placement="at_start")), True


def _numbers(entries: DataFrame):
    kind = entries.schema["feature"].dataType.simpleString()
    return np.float32 if "float" in kind else np.float64 if "double" in kind else np.int64


def _pair_schema(entries: DataFrame, queries: DataFrame) -> StructType:
    return StructType([entries.schema["object"], entries.schema["dtag"], *(f for f in queries.schema if f.name != "feature"), StructField("distance", DoubleType())])


def _pairs(entries, queries, row: np.ndarray, col: np.ndarray, d: np.ndarray, rank: np.ndarray | None = None):
    """Rows of matches, of the chosen entries and queries (batches or tables), in batches of a bounded size."""
    flat = lambda t: [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
    left, right = flat(entries), flat(queries)
    more = [] if rank is None else ["rank"]
    for at in range(0, len(row), OUT_ROWS):
        part = slice(at, at + OUT_ROWS)
        columns = [c.take(pa.array(row[part])) for c in left] + [c.take(pa.array(col[part])) for c in right]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        last = [pa.array(rank[part], pa.int32())] if more else []
        yield pa.RecordBatch.from_arrays([*columns, pa.array(d[part], pa.float64()), *last], [*entries.schema.names, *queries.schema.names, "distance", *more])


def _screen(name: str, x: np.ndarray, q: np.ndarray):
    """(X, Q, of, margin): ``Q @ X.T`` in floats is at most ``of(score)`` for a pair of that score or a better one.

    None where no such product exists. The margins are those of a float product of that length, so that no pair is
    lost; what passes is measured exactly.
    """
    if name not in ("l2", "cosine") or x.dtype != np.float32:
        return None
    for m in (x, q):
        if not np.isfinite(m).all() or np.abs(m).max(initial=0) > 1e15:
            return None
    eps = 4 * (x.shape[1] + 8) * 2.0**-24
    wide = lambda m: m.astype(np.float64)
    if name == "cosine":
        unit = lambda m: (wide(m) / np.maximum(np.sqrt((wide(m) ** 2).sum(axis=1, keepdims=True)), 1e-300)).astype(np.float32)
        return unit(x), -unit(q), lambda cols, worst: worst + eps
    square = lambda m: (wide(m) ** 2).sum(axis=1) * (1 - eps)
    left = np.concatenate([x, square(x)[:, None].astype(np.float32)], axis=1)
    right = np.concatenate([-2 * q, np.ones((len(q), 1), np.float32)], axis=1)
    own = square(q)
    return left, right, lambda cols, worst: np.maximum(worst, 0) ** 2 * (1 + 2.0**-20) - own[cols] + 1e-30


def _few(flags: np.ndarray) -> np.ndarray:
    """Where a matrix is true, as ``flatnonzero``; where few are, eight are looked at as one number."""
    flags = flags.ravel()
    n = len(flags) // 8 * 8
    at = (np.flatnonzero(flags[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flags[at]], n + np.flatnonzero(flags[n:])])


class _Best:
    """The nearest rows of ``x`` for each row of ``q``, fed block by block: by distance, then by row."""

    def __init__(self, name: str, sign: int, x: np.ndarray, q: np.ndarray, screen, radius: np.ndarray, k: np.ndarray, tied: bool):
        self.name, self.sign, self.x, self.q, self.screen, self.tied = name, sign, x, q, screen, tied
        self.k, self.radius = np.minimum(k, len(x)), sign * radius
        self.bound, self.last = self.radius.copy(), np.full(len(q), len(x))  # score and row of the worst that counts
        self.found, self.waiting, self.room = [], 0, max(1, int(self.k.sum()))
        self.held = {}

    def space(self, kind, shape: tuple[int, int]) -> np.ndarray:
        """A matrix to write to, in memory that the next block uses again (touching new memory costs as much as a product)."""
        n = shape[0] * shape[1]
        if len(self.held.get(kind, ())) < n:
            self.held[kind] = np.empty(n, kind)
        return self.held[kind][:n].reshape(shape)

    def feed(self, cols, rows) -> None:
        """Compare the queries ``cols`` with the entries ``rows`` (slices or index arrays)."""
        numbers = lambda s, n: np.arange(n)[s] if isinstance(s, slice) else s
        cols_, rows_ = numbers(cols, len(self.q)), numbers(rows, len(self.x))
        if not len(cols_) or not len(rows_):
            return
        if self.screen is None:
            dense = True
        else:
            left, right, of = self.screen
            with np.errstate(over="ignore"):
                limit = np.nextafter(of(cols_, self.bound[cols_]).astype(np.float32), np.float32(np.inf))
                product = np.matmul(right[cols], left[rows].T, out=self.space(np.float32, (len(cols_), len(rows_))))
            close = np.less_equal(product, limit[:, None], out=self.space(np.bool_, product.shape))
            dense = np.count_nonzero(close) * 4 > close.size
        if dense:
            a, b = np.ascontiguousarray(self.q[cols].T), np.ascontiguousarray(self.x[rows].T)
            d = self.space(np.float64, (len(cols_), len(rows_)))
            wide = min(len(rows_), PIECE)
            high = PIECE // wide
            for i in range(0, len(cols_), high):
                for j in range(0, len(rows_), wide):
                    d[i : i + high, j : j + wide] = self.sign * _scores(self.name, a[:, i : i + high, None], b[:, None, j : j + wide])
            at = np.flatnonzero(d <= self.bound[cols_][:, None])
            d, c, r = d.ravel()[at], cols_[at // len(rows_)], rows_[at % len(rows_)]
        else:
            at = _few(close)
            c, r = cols_[at // len(rows_)], rows_[at % len(rows_)]
            d = np.concatenate([self.sign * _scores(self.name, self.q[c[i : i + PAIRS]].T, self.x[r[i : i + PAIRS]].T) for i in range(0, len(c), PAIRS)] or [np.empty(0)])
        ok = (d < self.bound[c]) | (d == self.bound[c]) & (r <= self.last[c] if self.tied else True)
        self.found.append((c[ok], d[ok], r[ok]))
        self.waiting += int(ok.sum())
        if self.waiting > self.room:
            self.trim()

    def trim(self):
        """(query, score, row, rank), the k best of each query only, in order."""
        c, d, r = (np.concatenate([f[i] for f in self.found]) if self.found else np.empty(0, t) for i, t in enumerate((int, float, int)))
        order = np.lexsort((r, d, c))
        c, d, r = c[order], d[order], r[order]
        if len(c):  # a pair may come from several tables
            fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (r[1:] != r[:-1])])
            c, d, r = c[fresh], d[fresh], r[fresh]
        first = np.searchsorted(c, np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        at = first[full] + self.k[full] - 1
        self.bound[full], self.last[full] = d[at], r[at]
        rank = np.arange(len(c)) - first[c]
        keep = rank < self.k[c] if self.tied else d <= self.bound[c]
        c, d, r = c[keep], d[keep], r[keep]
        self.found, self.waiting = [(c, d, r)], 0
        return c, d, r, rank[keep] + 1


def _nearest(name: str, sign: int, x: np.ndarray, q: np.ndarray, radius: np.ndarray, k: np.ndarray, tied: bool, tables: list | None = None, codes: np.ndarray | None = None):
    """(row of x, row of q, distance, rank) of what is inside the radius and among the k nearest, block by block.

    Rows of ``x`` are in the order that decides ties, if ``tied``; else all ties of the last one are passed on. With
    ``tables`` (of x) and ``codes`` (of q) only rows that share a code are compared.
    """
    if not len(x) or not len(q):
        return
    screen = _screen(name, x, q)
    many = np.minimum(k, len(x)) * 8 > len(x)
    for wanted in (False, True):  # queries that want most rows, apart
        own = np.flatnonzero(many == wanted)
        least = max(1, HELD // len(x))  # of these all entries may match
        step, at = least if wanted else BLOCK, 0
        while at < len(own):
            part = own[at : at + step]
            of = None if screen is None else (screen[0], screen[1][part], lambda c, w, p=part: screen[2](p[c], w))
            best = _Best(name, sign, x, q[part], of, radius[part], k[part], tied)
            if tables is None:
                size, start = 64, 0  # small blocks first: they bring the bounds for the others
                over = False
                while start < len(x) and not over:
                    size = max(1, TILE // len(part)) if wanted else min(size, max(64, TILE // len(part)))
                    best.feed(slice(None), slice(start, start + size))
                    start, size = start + size, size * 2
                    over = wanted and best.waiting > HELD and len(part) > least
                if over:  # more match than may be held: fewer queries at once
                    step = least
                    continue
            else:
                for (names, starts, rows), asked in zip(tables, codes[part].T):
                    order = np.argsort(asked, kind="stable")
                    values, firsts = np.unique(asked[order], return_index=True)
                    for value, cols in zip(values, np.split(order, firsts[1:])):
                        i = np.searchsorted(names, value)
                        if i < len(names) and names[i] == value:
                            bucket = rows[starts[i] : starts[i + 1]]
                            width = max(64, TILE // len(cols))
                            for j in range(0, len(bucket), width):
                                best.feed(cols, bucket[j : j + width])
            at += len(part)
            if wanted and tables is None and best.waiting * 4 < HELD:  # a radius leaves few: more queries at once
                step = min(max(least, BLOCK), step * 2)
            c, d, r, rank = best.trim()
            yield r, part[c], sign * d, rank


class Lsh:
    """Locality-sensitive hashing: equal codes in any table make a pair, which is measured exactly.

    Families: random hyperplanes (cosine), p-stable projections (L2 Gaussian, L1 Cauchy) and bit sampling (Hamming).
    """

    def __init__(self, dim: int, tables: int = 8, bits: int = 8, width: float = 1.0, seed: int = 1, word_bits: int = 32):
        self.dim, self.tables, self.bits, self.width, self.seed, self.word_bits = dim, tables, bits, width, seed, word_bits

    def planes(self, measure: Similarity) -> list[list]:
        """For each table: sampled bits (Hamming), or (projection, shift) pairs."""
        rng = random.Random(self.seed)
        draw = (lambda: math.tan(math.pi * (rng.random() - 0.5))) if measure.name == "l1" else (lambda: rng.gauss(0, 1))
        if measure.name in ("hamming", "type_hamming"):
            return [[rng.randrange(self.dim * self.word_bits) for _ in range(self.bits)] for _ in range(self.tables)]
        return [[([round(draw(), 4) for _ in range(self.dim)], round(rng.random() * self.width, 4)) for _ in range(self.bits)] for _ in range(self.tables)]

    def signature(self, feature, measure: Similarity):
        """For each table, the array of whole numbers that equal features share. The projections are one literal."""
        every = [x for table in self.planes(measure) for x in table]
        if measure.name in ("hamming", "type_hamming"):
            word = lambda at: F.element_at(feature, (F.floor(at / self.word_bits) + 1).cast("int"))
            parts = F.transform(F.array(*map(F.lit, every)), lambda at: F.floor(word(at) / F.pow(F.lit(2.0), at % self.word_bits)) % 2)
        else:
            plane = F.from_json(F.lit(json.dumps([{"p": p, "s": s} for p, s in every])), "array<struct<p:array<double>,s:double>>")
            if measure.name == "cosine":
                parts = F.transform(plane, lambda x: (dot(feature, x["p"], None) > 0).cast("long"))
            else:
                parts = F.transform(plane, lambda x: F.floor((dot(feature, x["p"], None) + x["s"]) / self.width))
        first = F.sequence(F.lit(0), F.lit(self.tables - 1))
        parts = parts.cast("array<long>")
        return F.transform(first, lambda t: F.slice(parts, t * self.bits + 1, self.bits))

    def codes(self, feature, measure: Similarity):
        """One code for each table."""
        return F.transform(self.signature(feature, measure), lambda parts: F.xxhash64(parts))

    def matrix_codes(self, measure: Similarity):
        """A function from a matrix of features to their codes, a column for each table, by the sums of ``signature``."""
        tables, bits, width, words, name = self.tables, self.bits, self.width, self.word_bits, measure.name
        every = [x for table in self.planes(measure) for x in table]
        if name not in ("hamming", "type_hamming"):
            plane, shift = np.array([p for p, _ in every]).T, np.array([s for _, s in every])

        def run(x: np.ndarray) -> np.ndarray:
            if name in ("hamming", "type_hamming"):
                parts = np.stack([np.fmod(np.floor(x[:, at // words] / 2.0 ** (at % words)), 2) for at in every], axis=1)
            else:
                parts = np.zeros((len(x), len(every)))
                for i in range(x.shape[1]):
                    parts += x[:, i : i + 1].astype(np.float64) * plane[i]
                parts = (parts > 0) | np.isnan(parts) if name == "cosine" else np.nan_to_num(np.floor((parts + shift) / width))
            parts = parts.astype(np.int64).astype(np.uint64).reshape(len(x), tables, bits)
            code = np.zeros((len(x), tables), np.uint64)
            for i in range(bits):  # whole numbers mixed to one of 64 bits
                code = (code ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            return code.view(np.int64)

        return run

    def table(self, entries: DataFrame, measure: Similarity) -> DataFrame:
        """(table, code, object, dtag, feature)."""
        return entries.select("object", "dtag", "feature", F.posexplode(self.codes(F.col("feature"), measure)).alias("table", "code"))

    def search(self, queries: DataFrame, entries: DataFrame, measure: Similarity) -> DataFrame:
        queries, entries = queries.where("feature is not null"), entries.where("feature is not null")
        if measure.name in MEASURED and entries.count() * self.dim <= ENTRY_NUMBERS and unique(entries, "object", "dtag") and unique(queries, "qid", "qtag"):
            return _resident(queries, entries, measure, self.dim, queries.count(), self.matrix_codes(measure))
        asked = queries.withColumnRenamed("feature", "qfeature")
        asked = asked.select("*", F.posexplode(self.codes(F.col("qfeature"), measure)).alias("table", "code"))
        pairs = self.table(entries, measure).join(asked, ["table", "code"]).drop("table", "code").dropDuplicates(["qid", "qtag", "object", "dtag"])
        return hint_topk(_measured(pairs, measure, self.dim), measure.polarity)


class Inverted:
    """Postings of words; all postings of a query's word are matches, with the word's document frequency as distance."""

    @staticmethod
    def postings(entries: DataFrame) -> DataFrame:
        return entries.select(F.col("feature").alias("value"), "object", "dtag")

    @staticmethod
    def frequencies(entries: DataFrame) -> DataFrame:
        return entries.groupBy(F.col("feature").alias("value")).agg(F.count("*").alias("df"))

    @staticmethod
    def total(counts: DataFrame) -> DataFrame:
        """Document frequencies from counted words (object, value, n)."""
        return counts.groupBy("value").agg(F.sum("n").alias("df"))

    def search(self, queries: DataFrame, entries: DataFrame, measure: Similarity | None = None) -> DataFrame:
        asked = queries.withColumnRenamed("feature", "value")
        # only the queried words' postings are counted and joined
        wanted = asked.select("value").distinct()
        some = self.postings(entries).join(wanted, "value", "left_semi")
        df = some.groupBy("value").agg(F.count("*").cast("double").alias("distance"))
        found = some.join(asked.join(df, "value"), "value").drop("value")
        # hint_K does not count here; a rank orders the matches of one object only, so its tag will do
        return found.withColumn("rank", F.col("dtag") + 1)


def word_counts(texts: DataFrame, key: str, text: str, pattern: bytes = rb"[a-z]+") -> DataFrame:
    """(object, value, n): the distinct words of each text (lower-cased) with their counts.

    A text is one row, so its words are counted where it is, and nothing is shuffled.
    """

    def run(batches):
        find = re.compile(pattern).findall
        for batch in batches:
            keys, values, counts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(find(t.as_py().lower().encode())) if t.is_valid else {}
                keys += [k] * len(found)
                values += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(values, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["object", "value", "n"])

    return texts.select(F.col(key).alias("object"), F.col(text).alias("text")).mapInArrow(run, f"object {texts.schema[key].dataType.simpleString()}, value string, n long")


def counted_hits(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, object, score): for each query the ``k`` objects with most hints, a hint being a word of the query that
    meets an equal word of the object. Both sides are word counts (object, value, n).

    Where the queries' distinct words times the queries are few (checked), they are broadcast as a matrix; a batch of
    entries holds whole objects, so it passes on only its best of each query. Else both sides are joined by word.
    """
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "object"))
    size = queries.agg(F.count_distinct("value").alias("words"), F.count_distinct("object").alias("queries")).first()
    if size["words"] * size["queries"] > QUERY_NUMBERS:
        asked = queries.select(F.col("object").alias("qid"), "value", F.col("n").alias("m"))
        found = entries.join(asked, "value").groupBy("qid", "object").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("score"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
    rows = queries.toArrow().combine_chunks()  # QUERY_NUMBERS at most
    words, ids = pc.unique(rows["value"].combine_chunks()), pc.unique(rows["object"].combine_chunks())
    matrix = np.zeros((len(words), len(ids)))
    if len(rows):
        np.add.at(matrix, (pc.index_in(rows["value"], words).to_numpy(), pc.index_in(rows["object"], ids).to_numpy()), rows["n"].to_numpy())
    shared = queries.sparkSession.sparkContext.broadcast((words, ids, matrix))

    def best(objects: list, owner: list, word: list, n: list):
        _, ids, matrix = shared.value
        owner, word, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owner, word, n))
        scores = np.zeros((len(objects), len(ids)))
        for at in range(0, len(owner), 1 << 14):  # the entries of an object follow one another
            part = slice(at, at + (1 << 14))
            first = np.flatnonzero(np.diff(owner[part], prepend=-1))
            scores[owner[part][first]] += np.add.reduceat(matrix[word[part]] * n[part, None], first, axis=0)
        top = min(k, len(objects))
        bound = np.partition(scores, len(objects) - top, axis=0)[len(objects) - top] if len(objects) else 0
        row, col = np.nonzero((scores >= bound) & (scores > 0))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(col)), pa.array(objects).take(pa.array(row)), pa.array(scores[row, col])], ["qid", "object", "score"])

    def run(batches):
        words = shared.value[0]
        objects, owner, word, n = [], [], [], []
        for batch in batches:
            at = pc.index_in(batch.column(1), words)
            here = pc.is_valid(at)
            keys = batch.column(0).filter(here)
            if not len(keys):
                continue
            names = keys.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(names))))
            number += len(objects) - (1 if objects and objects[-1] == names[0] else 0)
            objects += names[starts].tolist()[1 if objects and objects[-1] == names[0] else 0 :]
            owner.append(number)
            word.append(at.filter(here).to_numpy().astype(np.int64))
            n.append(batch.column(2).filter(here).to_numpy())
            if len(objects) > OBJECTS:  # the last one may go on in the next batch
                last = len(objects) - 1
                cut = [o < last for o in owner]
                yield best(objects[:-1], [o[c] for o, c in zip(owner, cut)], [w[c] for w, c in zip(word, cut)], [x[c] for x, c in zip(n, cut)])
                objects, owner, word, n = objects[-1:], [np.zeros((~c).sum(), np.int64) for c in cut], [w[~c] for w, c in zip(word, cut)], [x[~c] for x, c in zip(n, cut)]
        if objects:
            yield best(objects, owner, word, n)

    qid, object_ = queries.schema["object"].dataType.simpleString(), entries.schema["object"].dataType.simpleString()
    found = entries.select("object", "value", "n").mapInArrow(run, f"qid {qid}, object {object_}, score double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class KGraph:
    """Graph-navigated search over a k-nearest-neighbour graph, with a linear scan of what isn't indexed yet.

    The graph is a table (src, pos, dst, dist). Below ``minimum`` entries there is no graph and search is linear.
    """

    def __init__(self, dim: int | None = None, minimum: int = 10_000, K: int = 25, L: int = 50, S: int = 10, iterations: int = 12, delta: float = 0.002, P: int = 100, T: int = 1, steps: int | None = None, seed: int = 1, recall: float = 0.99, controls: int = 400):
        self.recall, self.controls = recall, controls
        self.dim, self.minimum, self.K, self.L, self.S, self.iterations, self.delta = dim, minimum, K, L, S, iterations, delta
        self.P, self.T, self.steps, self.seed = P, T, steps, seed

    def exact_graph(self, entries: DataFrame, measure: Similarity) -> DataFrame:
        """Exact graph: every entry queried against all, without itself."""
        asked = entries.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), F.col("feature"), F.lit(self.K + 1).alias("hint_K"), F.lit(-measure.polarity * 3.4e38).alias("hint_R"), F.lit(1).alias("K"), F.lit(0.0).alias("R"))
        found = Linear(self.dim).search(asked, entries, measure).where("qid <> object or qtag <> dtag")
        pos = F.row_number().over(W.partitionBy("qid").orderBy(F.col("distance") * F.lit(-measure.polarity), "object"))
        return found.select(F.col("qid").alias("src"), F.col("object").alias("dst"), F.col("distance").alias("dist"), (pos - 1).alias("pos")).where(F.col("pos") < self.K)

    def descent(self, entries: DataFrame, measure: Similarity) -> DataFrame:
        """Approximate graph by NN-descent: neighbours of neighbours are tried, round by round, until few change.

        Reverse lists and new neighbours are sampled (S of each), so a popular node is no hot key. Old neighbours all take
        part: a new one is compared with them once, so one that was left out then would never meet it. Where the graph then
        falls short of ``recall``, every entry is searched for in it (see ``_completed``).
        """
        features = entries.select(F.col("object").alias("id"), "feature")
        n = features.count()
        spark = entries.sparkSession
        near = lambda d: d * F.lit(-measure.polarity)

        def with_distance(pairs: DataFrame) -> DataFrame:
            a = features.select(F.col("id").alias("src"), F.col("feature").alias("fa"))
            b = features.select(F.col("id").alias("dst"), F.col("feature").alias("fb"))
            return pairs.join(a, "src").join(b, "dst").select("src", "dst", near(measure.apply(F.col("fa"), F.col("fb"), self.dim).cast("double")).alias("dist"), F.lit(True).alias("new"))

        held = _held(entries, measure, self.dim)
        local = None if held is None else _LocalJoins(spark, held, measure, self.L)

        def best(pool: DataFrame) -> DataFrame:
            one = pool.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
            pos = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
            return one.withColumn("pos", pos).where(F.col("pos") <= self.L)

        # first neighbours: each entry with S or more that are near it in several random orders
        first = None
        for r in range(4):
            g = F.pmod(F.xxhash64("id", F.lit(self.seed + 97 * r)), F.lit(max(1, n // GROUP)))
            row = F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("id", F.lit(self.seed + r)), "id")) - 1
            size = F.count("*").over(W.partitionBy("g"))
            tiles = F.greatest(F.lit(1), F.floor(F.col("size") / (self.S + 1)))  # of the group's own size
            dealt = features.select("id", g.alias("g")).select("id", "g", row.alias("row"), size.alias("size")).select("id", "g", F.floor(F.col("row") * tiles / F.col("size")).alias("slot"))
            pairs = dealt.alias("a").join(dealt.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
            first = pairs if first is None else first.unionByName(pairs)
        pool = materialize(best(with_distance(first.distinct()) if local is None else local.measured(first.distinct())), "graph")
        for turn in range(self.iterations):
            some = self._lists(pool, turn)
            # only neighbours that were drawn are no longer new
            drawn = some.where("own and new").select("src", "dst", F.lit(True).alias("drawn"))
            old = pool.join(drawn, ["src", "dst"], "left").select("src", "dst", "dist", (F.col("new") & F.col("drawn").isNull()).alias("new"))
            if local is not None:
                pool = materialize(best(old.unionByName(local.joined(some, pool))), "graph")
                if pool.where("new").count() < self.delta * n * self.K:
                    break
                continue
            left, right = some.alias("a"), some.alias("b")
            pairs = left.join(right, F.col("a.src") == F.col("b.src")).where("a.new and a.dst <> b.dst").select(F.col("a.dst").alias("src"), F.col("b.dst").alias("dst"))
            pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
            fresh = with_distance(pairs.join(pool.select("src", "dst"), ["src", "dst"], "left_anti"))
            pool = materialize(best(old.unionByName(fresh)), "graph")
            if pool.where("new").count() < self.delta * n * self.K:
                break
        del spark
        if local is not None:
            pool = self._completed(pool, entries, measure, held)
        pos = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
        return pool.select("src", "dst", near(F.col("dist")).alias("dist"), (pos - 1).alias("pos")).where(F.col("pos") < self.K)

    def _completed(self, pool: DataFrame, entries: DataFrame, measure: Similarity, held) -> DataFrame:
        """The pool with what a search of it finds for every entry, where it holds too few of the exact neighbours.

        Control entries tell (their neighbours are found by a scan): they may miss half of what ``recall`` allows, as they
        are a sample. The search's pool is doubled until they do; with a pool of all entries it is exact.
        """
        asked = entries.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), "feature", F.lit(self.K + 1).alias("hint_K"), F.lit(-measure.polarity * FLT_MAX).alias("hint_R")).where("feature is not null")
        some = materialize(asked.orderBy(F.xxhash64("qid", F.lit(self.seed)), "qid").limit(self.controls), "controls")

        def nearest(found: DataFrame) -> DataFrame:
            near = F.col("distance") * F.lit(-measure.polarity)
            pairs = found.where("qid <> object").select(F.col("qid").alias("src"), F.col("object").alias("dst"), near.alias("dist"))
            return pairs.withColumn("pos", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))).where(F.col("pos") <= self.K)

        exact = materialize(nearest(Linear(self.dim).search(some, entries, measure)).select("src", "dst"), "controls")
        most = exact.count() * (1 - self.recall) / 2
        missed = lambda graph: exact.join(graph.where(F.col("pos") <= self.K).select("src", "dst"), ["src", "dst"], "left_anti").count()
        if missed(pool) <= most:
            return pool
        n, P = entries.count(), self.L
        edges = pool.where(F.col("pos") <= 2 * self.K)  # they go through the driver

        def searched(queries: DataFrame) -> DataFrame:
            if n <= P:
                return nearest(Linear(self.dim).search(queries, entries, measure))
            return nearest(KGraph(self.dim, P=P, seed=self.seed)._walk(queries, entries, edges, measure, held))

        while P < n and missed(searched(some)) > most:
            P *= 2
        both = pool.select("src", "dst", "dist").unionByName(searched(asked).select("src", "dst", "dist"))
        return materialize(both.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "graph")

    def _lists(self, pool: DataFrame, turn: int) -> DataFrame:
        """The lists that a round joins (src, dst, new, own), as in the paper: all old neighbours of an entry and S new
        ones, then S old and S new of the entries that have it in those. Every round draws anew."""
        draw = F.row_number().over(W.partitionBy("src", "new").orderBy(F.xxhash64("src", "dst", F.lit(self.seed + turn)), "dst"))
        numbered = lambda lists: lists.withColumn("n", draw)
        few = F.col("n") <= self.S
        fresh = numbered(pool.where("new").select("src", "dst", "new")).where(few).drop("n")
        own = pool.where("not new").select("src", "dst", "new").unionByName(fresh)
        back = numbered(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new")).where(few).drop("n")
        return own.withColumn("own", F.lit(True)).unionByName(back.withColumn("own", F.lit(False)))

    def build(self, entries: DataFrame, measure: Similarity) -> DataFrame | None:
        """Graph of single-feature entries, or None for a small collection."""
        return None if entries.count() < self.minimum else self.descent(entries, measure)

    def search_graph(self, queries: DataFrame, entries: DataFrame, graph: DataFrame, measure: Similarity) -> DataFrame:
        """Best-first expansion as joins: a pool of the P best per query grows by its members' neighbours.

        Every trial starts from P seeded entries; each step expands the pool's members that haven't been expanded,
        until there are none (a caller may set a bound, ``steps``).
        Where P reaches the number of entries, search is linear.
        """
        if self.P >= entries.count():
            return Linear(self.dim).search(queries, entries, measure)
        if queries.count() * 20 > entries.count() and unique(queries, "qid", "qtag"):
            held = _held(entries, measure, self.dim)
            if held is not None:
                return hint_topk(self._walk(queries, entries, graph, measure, held), measure.polarity)
        asked = queries.withColumnRenamed("feature", "qfeature")
        edges = graph.select(F.col("src").alias("object"), "dst")
        found = None
        for trial in range(self.T):
            order = F.xxhash64("object", F.lit(self.seed + trial))
            seeds = entries.orderBy(order, "object").limit(self.P).select("object", "dtag", "feature")  # P rows
            pool = _measured_all(seeds.crossJoin(asked), measure, self.dim).withColumn("open", F.lit(True))
            for _ in itertools.count() if self.steps is None else range(self.steps):
                near = F.col("distance") * F.lit(-measure.polarity)
                rank = F.row_number().over(W.partitionBy("qid", "qtag").orderBy(near, "object"))
                pool = materialize(pool.withColumn("rank", rank).where(F.col("rank") <= F.col("hint_K") + self.P).drop("rank"), "pool")
                step = pool.where("open").select("qid", "qtag", "object").join(edges, "object").select("qid", "qtag", F.col("dst").alias("object")).distinct()
                step = step.join(pool.select("qid", "qtag", "object"), ["qid", "qtag", "object"], "left_anti")
                if step.isEmpty():
                    break
                fresh = _measured_all(step.join(entries, "object").join(asked, ["qid", "qtag"]), measure, self.dim).withColumn("open", F.lit(True))
                pool = pool.withColumn("open", F.lit(False)).unionByName(fresh.select(pool.columns))
            found = pool.drop("open") if found is None else found.unionByName(pool.drop("open"))
        found = found.dropDuplicates(["qid", "qtag", "object", "dtag"]).where(within(F.col("distance"), F.col("hint_R"), measure.polarity))
        return hint_topk(found, measure.polarity)

    def _walk(self, queries: DataFrame, entries: DataFrame, graph: DataFrame, measure: Similarity, held) -> DataFrame:
        """The same expansion for a batch of queries, with entries and edges broadcast (few, checked)."""
        ids, x, own = held
        rows = graph.select("src", "dst").toArrow()
        src, dst = (np.minimum(np.searchsorted(ids, rows[c].to_numpy()), len(ids) - 1) for c in ("src", "dst"))
        real = (ids[src] == rows["src"].to_numpy()) & (ids[dst] == rows["dst"].to_numpy())
        order = np.argsort(src[real], kind="stable")
        src, dst = src[real][order], dst[real][order].astype(np.int32)
        starts = np.searchsorted(src, np.arange(len(ids) + 1))
        seeds = []
        for trial in range(self.T):
            picked = entries.orderBy(F.xxhash64("object", F.lit(self.seed + trial)), "object").limit(self.P).select("object").toArrow()["object"].to_numpy()
            seeds.append(np.searchsorted(ids, picked))
        shared = entries.sparkSession.sparkContext.broadcast((x, own, starts, dst, seeds))
        kind, dim, sign, name, P, steps = _numbers(entries), x.shape[1], -measure.polarity, measure.name, self.P, self.steps
        rest = [c for c in queries.columns if c != "feature"]

        def walk(x, q, starts, dst, seeds, size, screen):
            """(query, row, score) of the pools."""
            n, seen = len(x), np.zeros((len(q), len(x)), bool)
            c, r = np.repeat(np.arange(len(q)), len(seeds)), np.tile(seeds, len(q))
            bound = np.full(len(q), np.inf)
            pool = (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, bool))
            for step in itertools.count():
                seen[c, r] = True
                if screen is not None and step:
                    with np.errstate(over="ignore"):
                        limit = np.nextafter(screen[2](np.arange(len(q)), np.minimum(bound, FLT_MAX)).astype(np.float32), np.float32(np.inf))
                    near = np.concatenate([np.einsum("ij,ij->i", screen[1][c[i : i + PAIRS]], screen[0][r[i : i + PAIRS]]) for i in range(0, len(c), PAIRS)] or [np.empty(0)])
                    c, r = c[near <= limit[c]], r[near <= limit[c]]
                d = np.concatenate([sign * _scores(name, q[c[i : i + PAIRS]].T, x[r[i : i + PAIRS]].T) for i in range(0, len(c), PAIRS)] or [np.empty(0)])
                ok = d <= bound[c]
                pc_, pr, pd, po = (np.concatenate([a, b]) for a, b in zip(pool, (c[ok], r[ok], d[ok], np.ones(int(ok.sum()), bool))))
                if steps is not None and step >= steps:
                    return pc_, pr, pd
                order = np.lexsort((pr, pd, pc_))
                pc_, pr, pd, po = pc_[order], pr[order], pd[order], po[order]
                first = np.searchsorted(pc_, np.arange(len(q) + 1))
                keep = np.arange(len(pc_)) - first[pc_] < size[pc_]
                full = np.flatnonzero(np.diff(first) >= size)
                bound[full] = pd[first[full] + size[full] - 1]
                pool = pc_[keep], pr[keep], pd[keep], np.zeros(int(keep.sum()), bool)
                oc, node = pc_[keep & po], pr[keep & po]
                count = starts[node + 1] - starts[node]
                c = np.repeat(oc, count)
                at = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[node], count)
                r = dst[at].astype(int)
                fresh = ~seen[c, r]
                c, r = np.divmod(np.unique(c[fresh] * n + r[fresh]), n)
                if not len(c):
                    return pool[:3]

        def run(batches):
            x, own, starts, dst, seeds = shared.value
            for batch in batches:
                q = feature_matrix(batch["feature"], kind, dim)
                radius, k = batch["hint_R"].to_numpy(zero_copy_only=False).astype(float), np.minimum(batch["hint_K"].to_numpy(), 1 << 30).astype(int)
                screen = _screen(name, x, q)
                for at in range(0, len(q), 128):
                    part = np.arange(at, min(at + 128, len(q)))
                    of = None if screen is None else (screen[0], screen[1][part], lambda c, w, p=part: screen[2](p[c], w))
                    found = [walk(x, q[part], starts, dst, s, k[part] + P, of) for s in seeds]
                    c, r, d = (np.concatenate([f[i] for f in found]) for i in range(3))
                    _, once = np.unique(c * len(x) + r, return_index=True)
                    c, r, d = c[once], r[once], d[once]
                    order = np.lexsort((r, d, c))
                    c, r, d = c[order], r[order], d[order]
                    ok = (d <= sign * radius[part][c]) & (np.arange(len(c)) - np.searchsorted(c, c) < k[part][c])
                    yield from _pairs(own, batch.select(rest), r[ok], part[c[ok]], sign * d[ok])

        parts = max(entries.sparkSession.sparkContext.defaultParallelism * 4, math.ceil(queries.count() / QUERY_BLOCK))
        asked = queries.where("feature is not null").repartition(parts).select(*rest, "feature")
        return asked.mapInArrow(run, _pair_schema(entries, queries))

    def search(self, queries: DataFrame, entries: DataFrame, measure: Similarity, graph: DataFrame | None = None) -> DataFrame:
        """Indexed entries by graph, the rest (column ``indexed`` false) by scan, merged and cut to hint_K."""
        if graph is None:
            return Linear(self.dim).search(queries, entries, measure)
        if "indexed" not in entries.columns:
            return self.search_graph(queries, entries, graph, measure)
        old = self.search_graph(queries, entries.where("indexed").drop("indexed"), graph, measure)
        tail = Linear(self.dim).search(queries, entries.where("not indexed").drop("indexed"), measure)
        return hint_topk(old.drop("rank").unionByName(tail.drop("rank").select(old.drop("rank").columns)), measure.polarity)


def _held(entries: DataFrame, measure: Similarity, dim: int | None):
    """(ids in order, features, objects and tags) of few entries (checked) that are told apart by whole numbers; else None."""
    kind = entries.schema["object"].dataType.simpleString()
    if dim is None or measure.name not in MEASURED or kind not in ("int", "bigint"):
        return None
    if entries.count() * dim > ENTRY_NUMBERS or not unique(entries, "object"):
        return None
    rows = entries.where("feature is not null").select("object", "dtag", "feature").orderBy("object").toArrow().combine_chunks()
    return rows["object"].to_numpy(), feature_matrix(rows["feature"], _numbers(entries), dim), rows.select(["object", "dtag"])


class _LocalJoins:
    """Distances and local joins of NN-descent with all features broadcast."""

    def __init__(self, spark: SparkSession, held, measure: Similarity, L: int):
        self.ids, x, _ = held
        self.name, self.sign, self.L = measure.name, -measure.polarity, L
        self.spark = spark
        self.shared = self.spark.sparkContext.broadcast((self.ids, x))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, dist, new) of pairs."""
        shared, name, sign = self.shared, self.name, self.sign

        def run(batches):
            ids, x = shared.value
            for batch in batches:
                a, b = (np.searchsorted(ids, batch[c].to_numpy()) for c in ("src", "dst"))
                d = np.concatenate([sign * _scores(name, x[a[i : i + PAIRS]].T, x[b[i : i + PAIRS]].T) for i in range(0, len(a), PAIRS)] or [np.empty(0)])
                yield pa.RecordBatch.from_arrays([batch["src"], batch["dst"], pa.array(d), pa.array(np.ones(len(d), bool))], ["src", "dst", "dist", "new"])

        return pairs.select("src", "dst").mapInArrow(run, self.schema(pairs))

    @staticmethod
    def schema(pairs: DataFrame) -> str:
        kind = pairs.schema["src"].dataType.simpleString()
        return f"src {kind}, dst {kind}, dist double, new boolean"

    def joined(self, some: DataFrame, pool: DataFrame) -> DataFrame:
        """Pairs of one source's neighbours, one of them new at least, that are nearer than the worst of a full pool."""
        worst = pool.groupBy("src").agg(F.max("dist").alias("d"), F.count("*").alias("n")).where(F.col("n") >= self.L).toArrow()
        bound = np.full(len(self.ids), np.inf)
        bound[np.searchsorted(self.ids, worst["src"].to_numpy())] = worst["d"].to_numpy()
        limits = self.spark.sparkContext.broadcast(bound)
        shared, name, sign, L = self.shared, self.name, self.sign, self.L

        def run(batches):
            ids, x = shared.value
            bound, screen = limits.value, _screen(name, x, x)
            rows = [b for b in batches if len(b)]
            if not rows:
                return
            rows = pa.Table.from_batches(rows)
            src, dst, new = (rows[c].to_numpy() for c in ("src", "dst", "new"))
            dst = np.searchsorted(ids, dst)
            first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))  # sorted by source
            ends = np.append(first[1:], len(src))
            place = np.arange(len(src)) - np.repeat(first, ends - first)
            group = np.repeat(np.arange(len(first)), ends - first)
            width = int(place.max()) + 1
            kept, waiting = [], 0

            def trim():
                a, b, d = (np.concatenate([f[i] for f in kept]) for i in range(3))
                if not len(a):
                    return a, b, d
                order = np.lexsort((b, d, a))
                a, b, d = a[order], b[order], d[order]
                fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                a, b, d = a[fresh], b[fresh], d[fresh]
                ok = np.arange(len(a)) - np.searchsorted(a, a) < L
                return a[ok], b[ok], d[ok]

            for at in range(0, len(first), 256):
                here = slice(first[at], ends[min(at + 256, len(first)) - 1])
                g = group[here] - at
                node = np.full((g[-1] + 1, width), -1)
                node[g, place[here]] = dst[here]
                young = np.zeros(node.shape, bool)
                young[g, place[here]] = new[here]
                ok = (young[:, :, None] | young[:, None, :]) & (node[:, :, None] != node[:, None, :]) & (node[:, :, None] >= 0) & (node[:, None, :] >= 0)
                if screen is not None:
                    with np.errstate(over="ignore"):
                        limit = np.nextafter(screen[2](node.ravel(), np.minimum(bound[node.ravel()], FLT_MAX)).astype(np.float32), np.float32(np.inf)).reshape(node.shape)
                    ok &= screen[1][node] @ screen[0][node].transpose(0, 2, 1) <= limit[:, :, None]
                u, i, j = np.nonzero(ok)
                key = np.unique(node[u, i] * len(ids) + node[u, j])
                a, b = np.divmod(key, len(ids))
                d = np.concatenate([sign * _scores(name, x[a[k : k + PAIRS]].T, x[b[k : k + PAIRS]].T) for k in range(0, len(a), PAIRS)] or [np.empty(0)])
                near = d <= bound[a]
                kept.append((a[near], b[near], d[near]))
                waiting += int(near.sum())
                if waiting > 4_000_000:
                    kept = [trim()]
                    waiting = 0
            a, b, d = trim()
            kind = rows.schema.field("src").type
            for k in range(0, len(a), OUT_ROWS):
                part = slice(k, k + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[part]], kind), pa.array(ids[b[part]], kind), pa.array(d[part]), pa.array(np.ones(len(d[part]), bool))], ["src", "dst", "dist", "new"])

        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(len(self.ids) / CELL))
        dealt = some.select("src", "dst", "new").repartition(parts, "src").sortWithinPartitions("src")
        return dealt.mapInArrow(run, self.schema(some))


def _measured_all(pairs: DataFrame, measure: Similarity, dim: int | None) -> DataFrame:
    return pairs.withColumn("distance", measure.apply(F.col("feature"), F.col("qfeature"), dim).cast("double")).drop("feature", "qfeature")


#: algorithm name -> index
ALGORITHMS = {"linear": Linear, "lsh": Lsh, "kgraph": KGraph, "kgraph_lite": KGraph, "inverted": Inverted}
