"""Record stores: append-only Parquet tables of records by database, with key lookups and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KeyExistsError, PermissionDenied
from ..sources import formats
from ..storage import exists, forget, materialize, remove, subfolders

LAST_SIZE = 500
MAX_DBS = 256


def split_insert(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicting) rows of a batch (db, seq, key, ...): the first of a key in the batch that the database hasn't yet."""
    first = incoming.withColumn("__n", F.row_number().over(W.partitionBy("db", "key").orderBy("seq")))
    known = existing.select("db", "key").distinct()
    new = first.where("__n = 1").drop("__n").join(known, ["db", "key"], "left_anti")
    again = first.where("__n > 1").drop("__n").unionByName(first.where("__n = 1").drop("__n").join(known, ["db", "key"], "left_semi"))
    return new.select(incoming.columns), again.select(incoming.columns)


def fetch(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of (pos, key) requests, in request order; missing keys are skipped, repeated ones repeated."""
    return keys.join(records.select("key", "meta"), "key").select("pos", "key", "meta")


def stat_size(records: DataFrame) -> DataFrame:
    return records.groupBy("db").agg(F.count("*").alias("size"))


def stat_last(records: DataFrame, n: int = LAST_SIZE) -> DataFrame:
    """The last n keys inserted into each database, oldest first (``pos`` from 0)."""
    back = F.row_number().over(W.partitionBy("db").orderBy(F.col("seq").desc()))
    last = records.select("db", "seq", "key").withColumn("back", back).where(F.col("back") <= n)
    return last.select("db", (F.row_number().over(W.partitionBy("db").orderBy("seq")) - 1).alias("pos"), "key")


def journal_stat(objects: DataFrame, parts: str = "parts") -> DataFrame:
    """Objects, features and features per object of each database."""
    return objects.groupBy("db").agg(F.count("*").alias("objects"), F.sum(F.size(parts)).cast("long").alias("features")).withColumn("per_object", F.col("features") / F.col("objects"))


def database_of(requests: DataFrame, idmap: DataFrame, strict: bool = False) -> DataFrame:
    """Requests with the internal id of their database; an unknown one has none, or ends the query if ``strict``."""
    found = requests.join(F.broadcast(idmap.limit(MAX_DBS)), requests["db"] == idmap["outer_id"], "left")
    if not strict:
        return found
    checked = F.when(F.col("dbid").isNull(), F.raise_error(F.concat(F.lit("unknown database "), requests["db"].cast("string"))).cast("int")).otherwise(F.col("dbid"))
    return found.withColumn("dbid", checked)


def load_idmap(spark: SparkSession, path: str) -> dict[int, int]:
    """Outer to internal ids, from the last version below ``path``; MAX_DBS entries or so."""
    versions = sorted(p for p in subfolders(spark, path) if exists(spark, f"{p}/_SUCCESS"))
    return {r["outer_id"]: r["dbid"] for r in formats.idmap(spark, versions[-1]).collect()} if versions else {}


def save_idmap(spark: SparkSession, path: str, dbs: dict[int, int]) -> None:
    """Writes a new version; the last but one stays for readers that have it open."""
    formats.save_idmap(spark.createDataFrame([(i, o) for o, i in dbs.items()], "dbid int, outer_id int"), f"{path}/{len(dbs):06d}")
    for old in sorted(subfolders(spark, path))[:-2]:
        remove(spark, old)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``__n``, from 0 in each db: in order of ``seq`` if they have one, else in no particular order.

    Rows are ranked inside buckets, whose sizes are summed first, so that no task orders a whole database.
    """
    in_order = "seq" in rows.columns
    bucket = F.floor(F.col("seq") / (1 << 16)) if in_order else F.pmod(F.xxhash64("key"), F.lit(1024))
    rows = materialize(rows.withColumn("__b", bucket), "batch")
    sizes = rows.groupBy("db", "__b").agg(F.count("*").alias("__size"))
    before = W.partitionBy("db").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("db", "__b", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))
    at = F.row_number().over(W.partitionBy("db", "__b").orderBy(*(["seq"] if in_order else []), "key")) - 1
    return rows.withColumn("__n", at).join(first, ["db", "__b"]).withColumn("__n", F.col("__n") + F.col("__first")).drop("__b", "__first")


class Store:
    """Tables below a folder: records (by db), and clears as overwritten partitions."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "key string, meta string, feature array<float>", readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        self.schema = f"{schema}, seq long, db int"
        if not readonly and not exists(spark, self.path):
            spark.createDataFrame([], self.schema).write.partitionBy("db").mode("append").parquet(self.path)

    @property
    def columns(self) -> list[str]:
        return T._parse_datatype_string(self.schema).names

    @property
    def path(self) -> str:
        return f"{self.root}/records"

    def records(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _writable(self) -> None:
        if self.readonly:
            raise PermissionDenied("read only")

    def insert(self, batch: DataFrame, strict: bool = True) -> int:
        """Appends new keys; a conflict raises before anything is written if ``strict``. Returns how many."""
        self._writable()
        batch = materialize(batch, "batch")
        # of what is stored, only the keys that the batch has
        known = self.records().select("db", "key").join(batch.select("db", "key").distinct(), ["db", "key"], "left_semi")
        new, again = split_insert(batch, known)
        if strict and (bad := again.select("key").first()) is not None:
            raise KeyExistsError(bad["key"])
        new = materialize(new.select(self.columns), "new")
        n = new.count()
        if n:
            new.write.partitionBy("db").mode("append").parquet(self.path)
        forget(new)
        forget(batch)
        return n

    def clear(self, db: int) -> None:
        """Empties a database, for good."""
        self._writable()
        remove(self.spark, f"{self.path}/db={int(db)}")
        self.spark.catalog.refreshByPath(self.path)
