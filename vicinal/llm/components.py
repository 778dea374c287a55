"""Connected components of a link table, as DataFrame rounds (large-star and small-star steps).

Links are never collected. Each round is written to the shared folder, so lineage stays short and a
lost executor costs one round at most. A node with very many links is a key of grouped minima (found in the
map tasks first); its links meet its minimum by broadcast, not by a shuffle on that node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget
from .common import materialize

MAX_ROUNDS = 60


#: A key with more than this share of the rows is joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 2000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and the key's number of left rows.

    Keys of very many rows never meet in one task: their few right rows are broadcast.
    """
    hot = F.broadcast(right.where(F.col(count) > HOT * total))
    cold = right.where(F.col(count) <= HOT * total)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_counted(both.where("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_counted(down, least, "u", "n", total)
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (u long, v long), no nulls. Returns (node, root) for every node that has a link to another; root is the smallest node reachable."""
    edges = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            break
        last = state
        star = materialize(_large_star(edges, state["n"]), "star")
        before, edges = edges, materialize(_small_star(star, state["n"]), "links")
        forget(before)
        forget(star)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
