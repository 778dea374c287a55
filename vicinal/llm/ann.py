"""Approximate nearest neighbours by learned partitions.

Fitting works on a bounded sample (``SAMPLE`` vectors for each ``PARTS`` parts, by a hash of id and vector): its
exact neighbour graph is cut into balanced parts with few cut edges, and a small classifier learns which part a
vector belongs to. The number of parts grows with the table, from ``PARTS`` to ``MAX_PARTS``. Every vector is
indexed under its most probable part. A query goes to the parts that the classifier finds most probable for it;
their vectors are reranked exactly. How many parts that takes is measured on vectors of the sample that the fit
did not see: as few as find ``TARGET`` of their nearest neighbours. Where neighbours lie close together that is a
few; where vectors are spread evenly over many dimensions it is most of them, and no partition does better.

Parts are dealt to tasks in groups of a bounded number of vectors and queries, so a part that holds a
third of all vectors is only more groups. Equal vectors are compared once, and the smallest ids stand
for them (one more than the neighbours asked for, as a query leaves itself out); no result changes.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and those
without an id, take no part, as queries or candidates. Ties go to the smaller id. Empty tables give no rows. Rows
that repeat an id are one candidate each; a query leaves out every row with its own id. An id that is asked
several times is asked once (of different vectors under it, the first in order). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import append_columns, materialize

SAMPLE = 4000
PARTS = 16
MAX_PARTS = 64
#: Vectors of a part, from which on there are more parts.
PART_VECTORS = 50_000
#: Share of the sample's unseen neighbours that the probed parts must hold.
TARGET = 0.95
GRAPH_K = 10
#: Vectors and queries of a task's group.
GROUP_VECTORS = 20_000
GROUP_QUERIES = 2_000


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Ids of each vector's k nearest others (exact, in blocks)."""
    norm = (x * x).sum(axis=1)
    out = []
    for at in range(0, len(x), 512):
        d = norm[None] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Parts of equal size with few cut edges.

    Starts from balanced centroids; then, round by round, every vertex counts its neighbours in each
    part, and pairs of vertices that both gain by it change places, the largest gains first.
    """
    n = len(x)
    room = -(-n // parts)
    centre = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(12):
        cost = (centre * centre).sum(axis=1) - 2 * x @ centre.T
        label[:] = -1
        left = np.full(parts, room)
        order = np.argsort((cost - np.sort(cost, axis=1)[:, 1:2]).min(axis=1), kind="stable")
        ranked = np.argsort(cost, axis=1, kind="stable")
        for i in order:
            for p in ranked[i]:
                if left[p]:
                    label[i] = p
                    left[p] -= 1
                    break
        centre = np.stack([x[label == p].mean(axis=0) if (label == p).any() else centre[p] for p in range(parts)])
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    for _ in range(rounds):
        near = np.zeros((n, parts))
        np.add.at(near, (a, label[b]), 1)
        np.add.at(near, (b, label[a]), 1)
        gain = near - near[np.arange(n), label][:, None]
        moved = np.zeros(n, bool)
        changed = 0
        for p in range(parts):
            for q in range(p + 1, parts):
                ps = np.flatnonzero((label == p) & ~moved)
                qs = np.flatnonzero((label == q) & ~moved)
                ps, qs = ps[np.argsort(-gain[ps, q], kind="stable")], qs[np.argsort(-gain[qs, p], kind="stable")]
                m = min(len(ps), len(qs))
                good = gain[ps[:m], q] + gain[qs[:m], p] > 2  # an edge between the two would count twice
                k = int(np.argmin(good)) if not good.all() else m
                k = min(k, max(1, m // 4))
                if k and good[0]:
                    label[ps[:k]], label[qs[:k]] = q, p
                    moved[ps[:k]] = moved[qs[:k]] = True
                    changed += k
        if not changed:
            break
    return label


class Router:
    """Small classifier (one hidden layer) from vectors to parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 64, epochs: int = 30, smooth: np.ndarray | None = None):
        dim = x.shape[1]
        self.mean, self.scale = x.mean(axis=0), x.std() or 1.0
        self.w = [rng.normal(0, 1 / np.sqrt(dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts), np.zeros((dim, parts))]
        target = np.eye(parts)[label] if smooth is None else smooth
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        z = (x - self.mean) / self.scale
        for epoch in range(epochs):
            rate = 0.003 * (1 - epoch / epochs)
            order = rng.permutation(len(z))
            for at in range(0, len(z), 128):
                i = order[at : at + 128]
                h = np.maximum(z[i] @ self.w[0] + self.w[1], 0)
                g = (self._soft(h @ self.w[2] + self.w[3] + z[i] @ self.w[4]) - target[i]) / len(i)
                gh = (g @ self.w[2].T) * (h > 0)
                grads = [z[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0), z[i].T @ g]
                t += 1
                for k, grad in enumerate(grads):
                    grad = grad + 1e-3 * self.w[k] * (k in (0, 2, 4))
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self._soft(np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3] + z @ self.w[4])


def fit(x: np.ndarray, parts: int = PARTS, seed: int = 5, target: float = TARGET, k: int = GRAPH_K) -> tuple[Router, int]:
    """A router for the vectors ``x`` (a bounded sample), and how many parts a query must probe.

    A sixth of the sample is kept from the fit, and asked for its neighbours among the rest.
    """
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(x, np.zeros(len(x), np.int64), 1, rng, epochs=0), 1
    mixed = rng.permutation(len(x))
    asked, x = x[mixed[: len(x) // 6]], x[mixed[len(x) // 6 :]]
    graph = neighbour_graph(x, min(GRAPH_K, len(x) - 1))
    label = balanced_parts(x, graph, parts, rng)
    # a vector's target is where it and its neighbours lie, so that routing knows of neighbours across a cut
    share = np.eye(parts)[label] * 0.5 + np.eye(parts)[label[graph]].mean(axis=1) * 0.5
    router = Router(x, label, parts, rng, smooth=share)
    place = router.probabilities(x).argmax(axis=1)
    order = np.argsort(np.argsort(-router.probabilities(asked), axis=1, kind="stable"), axis=1, kind="stable")
    needed = []
    for at in range(0, len(asked), 512):
        some = asked[at : at + 512]
        d = (x * x).sum(axis=1)[None] - 2 * some @ x.T
        near = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
        needed.append(order[at : at + 512][np.arange(len(some))[:, None], place[near]].ravel())
    needed = np.sort(np.concatenate(needed))
    return router, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def fit_router(rows: DataFrame, sample: int = SAMPLE, parts: int | None = None) -> tuple[Router, int] | None:
    """A router and its number of probes, fitted on ``sample`` rows for each ``PARTS`` parts at most; None without rows."""
    n = rows.count()
    if not n:
        return None
    parts = parts or min(MAX_PARTS, max(PARTS, n // PART_VECTORS))
    sample = max(sample, sample * parts // PARTS)
    draw = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30))
    picked = rows.withColumn("__draw", draw).where(F.col("__draw") < int((1 << 30) * min(1.0, 1.2 * sample / n))).orderBy("__draw", "vec_id").limit(sample)
    x = np.unique(_matrix(picked.select("embedding").toArrow()["embedding"]), axis=0)  # ``sample`` rows at most
    return fit(x, parts)


def _with_parts(rows: DataFrame, router: Router, probes: int, name: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(router)  # a few thousand numbers

    def compute(inputs):
        x = _matrix(inputs[0])
        best = np.argsort(-shared.value.probabilities(x), axis=1, kind="stable")[:, :probes] if len(x) else np.empty((0, probes), np.int64)
        return [pa.array(best.tolist(), pa.list_(pa.int32()))]

    return append_columns(rows, None, [F.col("embedding")], compute, f"{name} array<int>")


def build_index(rows: DataFrame, router: Router, copies: int) -> DataFrame:
    """(vec_id, embedding, part) of every vector; of equal vectors the ``copies`` smallest ids (cut in the map tasks already)."""
    least = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    distinct = rows.withColumn("__n", least).where(F.col("__n") <= copies).drop("__n")
    parts = _with_parts(distinct, router, 1, "part")
    return materialize(parts.select("vec_id", "embedding", F.get("part", F.lit(0)).alias("part")), "vectors")


def _rerank(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = _matrix(left["embedding"]), _matrix(right["embedding"])
        ids, qids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        out = ([], [], [])
        if len(x) and len(q):
            norm = (x * x).sum(axis=1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                own = (part * part).sum(axis=1)
                d = norm[None] - 2 * part @ x.T + own[:, None]
                d[qids[at : at + 256, None] == ids[None]] = np.inf
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
                slack = 1e-9 * (own + norm.max())
                r, c = np.nonzero((d <= (bound + slack)[:, None]) & (d < np.inf))
                score = np.sqrt(((x[c] - part[r]) ** 2).sum(axis=1))
                order = np.lexsort((ids[c], score, r))
                r, c, score = r[order], c[order], score[order]
                first = np.searchsorted(r, np.arange(len(part)))
                near = np.arange(len(r)) - first[r] < k
                out[0].append(qids[at + r[near]])
                out[1].append(ids[c[near]])
                out[2].append(score[near])
        cols = [np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, float))]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, router: Router, k: int = 10, probes: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, embedding)."""
    asked = _with_parts(queries, router, probes, "parts").select(F.col("vec_id").alias("query_id"), "embedding", F.explode("parts").alias("part"))
    n_parts = len(router.w[3])
    vectors, wanted = ({r["part"]: r["count"] for r in df.groupBy("part").count().collect()} for df in (index, asked))  # a number per part

    def sizes(counts: dict, each: int) -> Column:
        return F.element_at(F.array(*(F.lit(max(1, -(-counts.get(p, 0) // each))) for p in range(n_parts))), F.col("part") + 1)

    salts, blocks = sizes(vectors, GROUP_VECTORS), sizes(wanted, GROUP_QUERIES)
    left = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    key = [F.col("part"), F.col("salt").cast("int").alias("salt"), F.col("block").cast("int").alias("block")]
    left, right = left.select("vec_id", "embedding", *key), right.select("query_id", "embedding", *key)
    found = left.groupBy("part", "salt", "block").cogroup(right.groupBy("part", "salt", "block")).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest others of every vector whose id is divisible by ``every``; ``probes`` as measured, if not given."""
    rows = usable(vectors, id_col, vector_col)
    fitted = fit_router(rows)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, needed = fitted
    index = build_index(rows, router, k + 1)
    # a query that is there several times is asked once; of different vectors with one id, the first in order
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(index, asked, router, k, min(probes or needed, len(router.w[3])))
