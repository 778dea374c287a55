"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes and rows are summed per slot; a versioned
slot-to-shard map, stored as a table, says which shard holds a slot. Rebalancing edits the last stored
version and never rehashes a record, so only the slots whose entry changed move.

Laws
----
* ``bytes``: after a rebalance the shards' bytes are near equal (as near as whole slots allow).
* Rows that are equal in id and text share one hash. Where such rows are many (more than ``HOT_SHARE`` of a slot's
  mean bytes), each takes the slot of its hash and of a random number of its own, so they spread over all slots;
  that number comes from the row's place in the table, so a retried task gives it again.
* Nulls: a null text has no bytes (size 8), a null id hashes like any value.
* Texts of any length count by their bytes; one text larger than a shard's share leaves that shard the fullest.
* Empty tables give empty results; repeated rows are rows of their own; ties in a slot go by id, checksum and size.
* Only id and text are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_folder, text_bytes

#: Bytes that a record takes besides its text.
ROW_OVERHEAD = 8
DEFAULT_SLOTS = 4096
#: Equal rows with more than this share of a slot's mean bytes are dealt over all slots.
HOT_SHARE = 0.25


@dataclass
class SlotMap:
    """Slot-to-shard map. ``history`` keeps the edits (version, slot, from, to)."""

    shards: list[int]
    n_shards: int
    version: int = 1
    history: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([s % n_shards for s in range(n_slots)], n_shards)

    def _edited(self, shards: np.ndarray, n_shards: int) -> SlotMap:
        version = self.version + 1
        edits = [(version, s, a, int(b)) for s, (a, b) in enumerate(zip(self.shards, shards)) if a != b]
        return SlotMap([int(x) for x in shards], n_shards, version, self.history + edits)

    def rebalanced(self, slot_bytes: np.ndarray) -> SlotMap:
        """The next version, with shard loads near equal.

        Shards over the mean give up their smallest sufficient slots, which go, largest first, to
        the emptiest shards; then single moves and swaps between the fullest and the emptiest shard
        go on while they narrow the gap. The work depends on the number of slots only.
        """
        size = np.asarray(slot_bytes, np.int64)
        shard = np.array(self.shards)
        load = np.bincount(shard, size, self.n_shards).astype(np.int64)
        mean = load.sum() / self.n_shards
        loose: list[int] = []
        for s in range(self.n_shards):
            own = np.flatnonzero((shard == s) & (size > 0))
            for slot in own[np.argsort(-size[own], kind="stable")]:
                if load[s] <= mean:
                    break
                load[s] -= size[slot]
                loose.append(int(slot))
        for slot in sorted(loose, key=lambda x: (-size[x], x)):
            to = int(np.argmin(load))
            shard[slot] = to
            load[to] += size[slot]
        for _ in range(4 * len(size)):
            hi, lo = int(np.argmax(load)), int(np.argmin(load))
            gap = load[hi] - load[lo]
            a, b = np.flatnonzero((shard == hi) & (size > 0)), np.flatnonzero(shard == lo)
            # moving x and taking back y changes the gap by 2 (x - y); y may be nothing
            give = np.sort(size[a])
            best, pick = 0, None
            for y_slot, y in [(-1, 0), *((int(j), int(size[j])) for j in b[:256])]:
                i = np.searchsorted(give, y + gap / 2)
                for k in (i - 1, i):
                    if 0 <= k < len(give) and 0 < (d := int(give[k]) - y) < gap and min(d, gap - d) > best:
                        best, pick = min(d, gap - d), (int(give[k]), y_slot)
            if pick is None or best * 1000 < mean:
                break
            x_slot = int(a[np.flatnonzero(size[a] == pick[0])[0]])
            shard[x_slot] = lo
            load[hi] -= size[x_slot]
            load[lo] += size[x_slot]
            if pick[1] >= 0:
                shard[pick[1]] = hi
                load[hi] += size[pick[1]]
                load[lo] -= size[pick[1]]
        return self._edited(shard, self.n_shards)

    def grown(self, slot_bytes: np.ndarray) -> SlotMap:
        """One shard more: slots move only into the new one, taken from the fullest shards."""
        size = np.asarray(slot_bytes, np.int64)
        shard = np.array(self.shards)
        new = self.n_shards
        load = np.bincount(shard, size, new + 1).astype(np.int64)
        mean = load.sum() / (new + 1)
        for slot in np.argsort(-size, kind="stable"):
            s = shard[slot]
            if s != new and load[s] - size[slot] >= mean * 0.98 and load[new] + size[slot] <= mean:
                shard[slot] = new
                load[s] -= size[slot]
                load[new] += size[slot]
        return self._edited(shard, new + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, vslot, shard, moved_from): one row for each slot."""
        moved = {slot: was for version, slot, was, _ in self.history if version == self.version}
        return spark.createDataFrame([(self.version, self.n_shards, i, s, moved.get(i)) for i, s in enumerate(self.shards)], f"version int, {MAP}")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map; a version is never written twice."""
        if (last := SlotMap.load(spark, path)) is not None and last.version >= self.version:
            raise ValueError(f"version {self.version} is stored already")
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The last stored version (or the one asked for); None if there is none."""
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        rows = spark.read.schema(f"{MAP}, version int").parquet(path)
        last = rows.where(F.col("version") <= version) if version else rows
        last = last.agg(F.max("version")).first()[0]
        if last is None:
            return None
        own = rows.where(F.col("version") == last).orderBy("vslot").collect()  # one row for each slot
        edits = [(last, r["vslot"], r["moved_from"], r["shard"]) for r in own if r["moved_from"] is not None]
        return cls([r["shard"] for r in own], own[0]["n_shards"], last, edits)


MAP = "n_shards int, vslot int, shard int, moved_from int"


def with_slots(docs: DataFrame, n_slots: int = DEFAULT_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each record; all built-in functions, text is read once and dropped.

    Equal rows that are too many for one slot are found first, by bytes summed in the map tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (text_bytes(text_col) + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("hash"),
    )
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "records")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # at most n_slots / HOT_SHARE hashes hold so many bytes
    hot = rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > HOT_SHARE * total / n_slots))
    rows = rows.join(F.broadcast(hot.select("hash", F.lit(True).alias("hot"))), "hash", "left")
    key = F.when(F.col("hot"), F.xxhash64("hash", "place")).otherwise(F.col("hash"))
    return rows.select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(n_slots)).cast("int").alias("vslot"))


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot (summed in the map tasks first, so a slot is a few numbers per task)."""
    return slotted.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def place(slotted: DataFrame, totals: list, slot_map: SlotMap) -> DataFrame:
    """Shard and position of each record: the slots of a shard follow one another, and the position
    inside a slot is a row number over that slot alone."""
    spark = slotted.sparkSession
    rows = {r["vslot"]: r["rows"] for r in totals}
    at = [0] * slot_map.n_shards
    base = []
    for slot, shard in enumerate(slot_map.shards):
        base.append((slot, shard, at[shard]))
        at[shard] += rows.get(slot, 0)
    # one row per virtual slot: a fixed number, safe to broadcast
    placed = spark.createDataFrame(base, "vslot int, shard int, first long")
    in_slot = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("in_slot", F.row_number().over(in_slot).cast("long") - 1)
        .join(F.broadcast(placed), "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("in_slot")).alias("slot"), F.col("vslot").alias("virtual_slot"))
    )


def slot_bytes(totals: list, n_slots: int) -> np.ndarray:
    sizes = np.zeros(n_slots, np.int64)
    for r in totals:
        sizes[r["vslot"]] = r["bytes"]
    return sizes


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = DEFAULT_SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Place all documents into shards 0..n_shards-1 under the law ``bytes``; returns the rows and the map.

    The map at ``map_path`` (a folder of its own in the shared one, if not given) is loaded; its last version is
    rebalanced for these documents, and the edited version is stored. A map that needs no edit stays as it is.
    More shards than the map has are added one by one; fewer can't be had from a stored map.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/vicinal-slots-{uuid.uuid4().hex}"
    slotted = with_slots(docs, n_slots, id_col, text_col)
    totals = slot_totals(slotted).collect()  # at most n_slots rows
    sizes = slot_bytes(totals, n_slots)
    last = SlotMap.load(spark, path)
    if last is None:
        last = SlotMap.initial(n_slots, n_shards)
        last.store(spark, path)
    if len(last.shards) != n_slots or last.n_shards > n_shards:
        raise ValueError(f"the stored map has {len(last.shards)} slots and {last.n_shards} shards")
    while last.n_shards < n_shards:
        last = last.grown(sizes)
        last.store(spark, path)
    new = last.rebalanced(sizes)
    if new.shards != last.shards:
        new.store(spark, path)
        last = new
    return place(slotted, totals, SlotMap.load(spark, path)).withColumn("map_version", F.lit(last.version)), last
