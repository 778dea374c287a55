"""Binary formats of features, objects, journals and graphs, as Arrow-batched functions.

All numbers are little-endian. A single object is its vector; a multi-part object is a 16-bit count and,
for each part, weight, data and vector as far as the domain has them; a text object is a 32-bit count and
packed words. A journal record is a head {magic 32, reserved 16, key size 16, meta size 32}, key, meta, object.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..domain import Domain
from ..errors import PluginError
from ..functions.text import is_url

# Marks of the binary formats.
JOURNAL_MAGIC = 0xDEADFACE
JOURNAL_HEAD = "<IHHI"
GRAPH_MAGIC = b"KNNGRAPH"
GRAPH_VERSION = 2
MAX_PARTS = 65535
MAX_RAW = 128 << 20


def _parts(domain: Domain, raw: bytes, at: int = 0) -> tuple[list[dict], int]:
    if domain.kind == "single":
        end = at + domain.feature_bytes
        if end > len(raw):
            raise PluginError("short feature")
        return [{"feature": np.frombuffer(raw, domain.dtype, domain.dim, at).tolist()}], end
    (n,) = struct.unpack_from("<H" if domain.kind == "multi" else "<I", raw, at)
    at += 2 if domain.kind == "multi" else 4
    out = []
    for _ in range(n):
        part: dict = {}
        if domain.weighted:
            (part["weight"],) = struct.unpack_from("<f", raw, at)
            at += 4
        if domain.part_data:
            part["data"] = dict(zip(domain.part_data, struct.unpack_from(f"<{len(domain.part_data)}f", raw, at)))
            at += 4 * len(domain.part_data)
        end = at + domain.feature_bytes
        if end > len(raw):
            raise struct.error("short object")
        v = np.frombuffer(raw, domain.dtype, domain.dim, at).tolist()
        part["feature"] = v[0] if domain.kind == "text" else v
        out.append(part)
        at = end
    return out, at


def decode_parts(domain: Domain, raw: bytes) -> list[dict]:
    """Parts of one encoded object; broken bytes are an error."""
    try:
        return _parts(domain, raw)[0]
    except (struct.error, ValueError) as e:
        raise PluginError(f"broken object: {e}") from e


def encode_parts(domain: Domain, parts: list[dict]) -> bytes:
    if domain.kind == "single":
        return np.asarray(parts[0]["feature"], domain.dtype).tobytes()
    if domain.kind == "multi" and len(parts) > MAX_PARTS:
        raise PluginError("too many parts")
    out = [struct.pack("<H" if domain.kind == "multi" else "<I", len(parts))]
    for p in parts:
        if domain.weighted:
            out.append(struct.pack("<f", p["weight"]))
        if domain.part_data:
            out.append(struct.pack(f"<{len(domain.part_data)}f", *(p["data"][k] for k in domain.part_data)))
        out.append(np.asarray([p["feature"]] if domain.kind == "text" else p["feature"], domain.dtype).tobytes())
    return b"".join(out)


def parts_type(domain: Domain) -> T.ArrayType:
    if domain.kind == "single":
        return T.ArrayType(T.StructType([T.StructField("feature", domain.feature_type)]))
    return domain.schema["parts"].dataType


def decode(domain: Domain, content: Column) -> Column:
    """Parts of an encoded object; null for null or broken bytes."""

    @F.pandas_udf(parts_type(domain))
    def run(raw: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else _parts(domain, bytes(b))[0]
            except (struct.error, ValueError, PluginError):
                return None

        return raw.map(one)

    return run(content)


def encode(domain: Domain, parts: Column) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else encode_parts(domain, list(r)))

    return run(parts)


def enumerate_parts(objects: DataFrame, key: str = "object", parts: str = "parts") -> DataFrame:
    """(key, dtag, feature) of every part, numbered from 0."""
    return objects.select(key, F.posexplode(parts).alias("dtag", "part")).select(key, "dtag", F.col("part.feature").alias("feature"))


# journals


def journal_record(key: str, meta: str, body: bytes, reserved: int = 0) -> bytes:
    if reserved:
        raise PluginError("the reserved field of a record must be 0")
    k, m = key.encode(), meta.encode()
    return struct.pack(JOURNAL_HEAD, JOURNAL_MAGIC, reserved, len(k), len(m)) + k + m + body


def read_journal(raw: bytes, domain: Domain, seek: int = 0) -> tuple[list[tuple[str, str, list[dict], int]], int]:
    """Records (key, meta, parts, offset) up to the first bad magic or short read, and the last good offset.

    Writers leave the reserved field 0; readers take a record whatever it holds.
    """
    out, at, head = [], seek, struct.calcsize(JOURNAL_HEAD)
    while at + head <= len(raw):
        magic, _, nk, nm = struct.unpack_from(JOURNAL_HEAD, raw, at)
        if magic != JOURNAL_MAGIC or at + head + nk + nm > len(raw):
            break
        body = at + head + nk + nm
        try:
            parts, end = _parts(domain, raw, body)
        except (struct.error, ValueError, PluginError):
            break
        out.append((raw[at + head : at + head + nk].decode(errors="replace"), raw[at + head + nk : body].decode(errors="replace"), parts, at))
        at = end
    return out, at


def scan_journals(files: DataFrame, domain: Domain, seek: int = 0) -> DataFrame:
    """(path, seq, key, meta, parts, good_upto) of journal files given as (path, content); a file is read in order by one task."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("meta", T.StringType()), T.StructField("parts", parts_type(domain)), T.StructField("good_upto", T.LongType())])

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                found, upto = read_journal(bytes(content), domain, seek)
                yield pd.DataFrame([(path, i, k, m, p, upto) for i, (k, m, p, _) in enumerate(found)], columns=schema.names)

    return files.select("path", "content").mapInPandas(run, schema)


def scan_local_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files of at most 128 MiB; a missing path gives no rows."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as e:  # analysis error of a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, content binary")
    return files.where(F.col("length") <= MAX_RAW).select("path", "content")


def resolve_urls(requests: DataFrame, contents: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """``requests`` with the content of their URLs, from a table (url, content); of several contents the least counts.

    Every URL must be an http, https or ftp one and have a content; another ends the query with an error.
    """
    known = contents.groupBy(F.col(url).alias("__url")).agg(F.min(content).alias("__content"))
    found = requests.join(known, requests[url] == F.col("__url"), "left")
    failed = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col(url))).cast(contents.schema[content].dataType)
    value = F.when(~F.coalesce(is_url(F.col(url)), F.lit(False)), failed("not a URL")).when(F.col("__url").isNull(), failed("unresolved")).otherwise(F.col("__content"))
    return found.select(*(requests[c] for c in requests.columns if c != content), value.alias(content))


def truncate_journal(path: str, domain: Domain) -> int:
    """Cuts a journal file after its last whole record; returns the offset."""
    with open(path, "r+b") as f:
        _, upto = read_journal(f.read(), domain)
        f.truncate(upto)
    return upto


# graphs


#: Set in a graph file's flags if neighbours are ids only; else each is an id, a distance and a mark, 12 bytes with padding.
GRAPH_IDS_ONLY = 1
GRAPH_HEAD = "<III"
_NEIGHBOUR = np.dtype([("id", "<u4"), ("dist", "<f4"), ("mark", "u1"), ("pad", "V3")])


def write_graph(neighbours: list[list[int]], degrees: list[int] | None = None, distances: list[list[float]] | None = None) -> bytes:
    """A graph file; without distances (as snapshots are), its flag says so."""
    out = [GRAPH_MAGIC, struct.pack(GRAPH_HEAD, GRAPH_VERSION, 0 if distances else GRAPH_IDS_ONLY, len(neighbours))]
    for i, ids in enumerate(neighbours):
        out.append(struct.pack("<II", (degrees or [len(x) for x in neighbours])[i], len(ids)))
        if distances is None:
            out.append(np.array(ids, "<u4").tobytes())
        else:
            rows = np.zeros(len(ids), _NEIGHBOUR)
            rows["id"], rows["dist"], rows["mark"] = ids, distances[i], 1
            out.append(rows.tobytes())
    return b"".join(out)


def read_graph(raw: bytes) -> list[tuple[int, int, int]]:
    """(src, pos, dst) edges of a graph file."""
    if raw[: len(GRAPH_MAGIC)] != GRAPH_MAGIC:
        raise PluginError("not a graph")
    at = len(GRAPH_MAGIC)
    try:
        version, flags, n = struct.unpack_from(GRAPH_HEAD, raw, at)
        if version != GRAPH_VERSION:
            raise PluginError(f"graph version {version}")
        at += struct.calcsize(GRAPH_HEAD)
        kind = np.dtype("<u4") if flags & GRAPH_IDS_ONLY else _NEIGHBOUR
        out = []
        for src in range(n):
            _, k = struct.unpack_from("<II", raw, at)
            rows = np.frombuffer(raw, kind, k, at + 8)
            out += [(src, pos, int(dst)) for pos, dst in enumerate(rows if flags & GRAPH_IDS_ONLY else rows["id"])]
            at += 8 + k * kind.itemsize
    except (struct.error, ValueError) as e:
        raise PluginError(f"short graph: {e}") from e
    return out


def load_graph(files: DataFrame) -> DataFrame:
    """(path, src, pos, dst) of graph files given as (path, content)."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(path, *e) for e in read_graph(bytes(content))], columns=["path", "src", "pos", "dst"])

    return files.select("path", "content").mapInPandas(run, "path string, src long, pos int, dst long")


def actual_degree(wanted: Column, m: Column, degree: Column) -> Column:
    """Neighbours that search looks at: max of the node's and the query's, up to what there is."""
    return F.least(F.greatest(m, wanted), degree)
