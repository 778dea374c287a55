"""Incremental insert and continuous metrics with Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import Store


def stream_insert(stream: DataFrame, store: Store, checkpoint: str, once: bool = True):
    """Runs a stream of (db, seq, key, meta, ...) into the store: each micro-batch is deduplicated on key and against
    the store, then appended. A batch that is run again finds its keys there, so it adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        store.insert(batch, strict=False)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_keys(stream: DataFrame, key: str = "key") -> DataFrame:
    """Uniqueness as stream state."""
    return stream.dropDuplicates([key])


def interval_rates(events: DataFrame, ts: str, duration: str, error, latency: str, watermark: str | None = None, miss=None) -> DataFrame:
    """Queries, errors, misses and mean latency by interval; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return (
        rows.groupBy(F.window(ts, duration).alias("w"))
        .agg(F.count("*").alias("queries"), flag(error).alias("errors"), flag(miss if miss is not None else F.lit(False)).alias("misses"), F.avg(latency).alias("mean_ms"))
        .select(F.col("w.start").alias("start"), "queries", "errors", "misses", "mean_ms")
    )


def cumulative(rates: DataFrame, columns: list[str], chunk: str = "1 day") -> DataFrame:
    """Totals from the first interval to each (``total_...``), for tables.

    Summed inside chunks of time and over the chunks, so that no task orders all intervals.
    """
    rows = rates.withColumn("__chunk", F.window("start", chunk)["start"])
    inside = W.partitionBy("__chunk").orderBy("start")
    chunks = rows.groupBy("__chunk").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    year = F.year("__chunk")
    earlier = W.partitionBy("__year").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    within = chunks.withColumn("__year", year).select("__chunk", "__year", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    years = chunks.groupBy(year.alias("__of")).agg(*(F.sum(f"__{c}").alias(f"__y_{c}") for c in columns))  # a row a year
    base = within.select("__year").distinct().join(F.broadcast(years), F.col("__of") < F.col("__year"), "left").groupBy("__year").agg(*(F.coalesce(F.sum(f"__y_{c}"), F.lit(0)).alias(f"__y_{c}") for c in columns))
    out = rows.join(within, "__chunk").join(F.broadcast(base), "__year")
    return out.select(*rates.columns, *((F.sum(rows[c]).over(inside) + F.col(f"__{c}") + F.col(f"__y_{c}")).alias(f"total_{c}") for c in columns))


def stress_totals(events: DataFrame, server, error, miss, latency: str) -> DataFrame:
    """Queries, errors, misses and latency of each server of a load test."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return events.groupBy(server.alias("server")).agg(F.count("*").alias("queries"), flag(error).alias("errors"), flag(miss).alias("misses"), F.sum(latency).alias("latency_ms"))


def last_keys(stream: DataFrame, n: int = 500):
    """The last n keys of each database as stream state: (db, last) whenever a database gets new ones.

    ``stream`` has db, seq and key; n keys a database are kept between batches.
    """

    def ring(key, batches, state):
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            kept += zip(pdf["seq"].tolist(), pdf["key"].tolist())
        kept = sorted(kept)[-n:]
        state.update(([k[0] for k in kept], [k[1] for k in kept]))
        yield pd.DataFrame({"db": [key[0]], "last": [[k[1] for k in kept]]})

    return stream.groupBy("db").applyInPandasWithState(ring, "db int, last array<string>", "seq array<long>, key array<string>", "update", "NoTimeout")
