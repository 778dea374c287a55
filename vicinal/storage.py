"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where a local session has none (tests), a temporary folder is set once; on a cluster
    it must be set, as executors don't see the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir is not set")
        folder = getattr(spark, "_vicinal_shared", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="vicinal-")
            spark._vicinal_shared = folder
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Spark setting that removes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, list] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """The setting holds while any thread of the session writes, and is then as before."""
    session = str(spark._jsparkSession.sessionUUID())
    with _lock:
        state = _writing.setdefault(session, [0, spark.conf.get(CLEANUP, "false")])
        state[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, state[1])
                del _writing[session]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later jobs, and retries after a lost executor, start from the files. The
    writing job's shuffle files go when it ends, the table itself when the driver's JVM ends or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vicinal-{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "lz4").parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._vicinal_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned; nothing may read it any more."""
    path = getattr(df, "_vicinal_path", None)
    if path:
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in a folder; none if it isn't there."""
    fs, p = _path(spark, path)
    return [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
