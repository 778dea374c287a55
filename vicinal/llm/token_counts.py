"""Token counts of the documents in flat token files that have no index.

A flat file is a run of ids in which an end-of-document id closes each document. It is read in blocks
that know nothing of documents. Each block is searched for the end id in one vectorised pass; a prefix
scan over the blocks' summaries (tokens, ends, place of the last end) then stitches the documents that
cross blocks. The scan has two steps, inside chunks of ``CHUNK`` blocks and over the chunks, so a single
huge stream is many tasks; only summaries are ordered, lengths and token data never move.

Blocks may be empty; a stream without an end id holds no finished document and is reported as one open
document (``closed`` false). A broken id at the end of a block or file (fewer bytes than an id has) is left
out. Empty input gives no rows. Documents without a text have no tokens and count 0. A text that spells
out the end marker is tokenized as ordinary text, so it stays one document. Repeated rows are documents of
their own; texts of any length are read whole; ties don't arise, as blocks are numbered. Only the columns
named are read, whatever others are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import encoder, tokenizer_path

END_ID = 50256
#: Bytes of a block.
BLOCK_BYTES = 1 << 20
#: Blocks that one task of the prefix scan orders.
CHUNK = 4096
#: Files over this size are read in ranges.
WHOLE_FILE = 256 << 20
BLOCK_SCHEMA = "stream long, block long, tokens binary, names array<long>"


def write_streams(docs: DataFrame, path: str | None = None, end_id: int = END_ID, text_col: str = "text", id_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token streams of all texts, one per input partition, as unsigned 16-bit ids cut into equal blocks.

    Beside each block stand the ids (``names``) of the documents that end in it, if ``id_col`` is given; the
    search for ends doesn't read them.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(text_col).alias("text"), (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("name"))
    schema = pa.schema([("stream", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("names", pa.list_(pa.int64()))])

    def run(batches):
        ids_of = encoder(path)
        stream, block, held, size, names = TaskContext.get().partitionId(), 0, [], 0, []
        end = np.array([end_id], "<u2").tobytes()

        def out(data, n_names):
            nonlocal block, names
            mine, names = names[:n_names], names[n_names:]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([block - 1], pa.int64()), pa.array([data], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], schema=schema)

        def ends_in(data):
            return int(np.count_nonzero(np.frombuffer(data, "<u2") == end_id))

        for batch in batches:
            for part in slices(batch, "text"):
                for text, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = ids_of.ordinary(text).astype("<u2").tobytes() + end
                    names.append(name)
                    held.append(data)
                    size += len(data)
                    if size >= block_bytes:
                        joined = b"".join(held)
                        whole = len(joined) // block_bytes * block_bytes
                        for at in range(0, whole, block_bytes):
                            some = joined[at : at + block_bytes]
                            yield out(some, ends_in(some))
                        held, size = [joined[whole:]], len(joined) - whole
        if size:
            yield out(b"".join(held), len(names))

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def read_token_files(spark: SparkSession, path: str, range_bytes: int = BLOCK_BYTES, whole_file: int = WHOLE_FILE) -> DataFrame:
    """Flat files below ``path`` as blocks: a folder is one stream, its files in order of their names.

    Small files are a block each. Larger ones are read in ranges, by as many tasks as they have splits; ranges are
    the largest power of two that divides the file's size, ``range_bytes`` at most. (A large file that ends in a
    broken id can't be cut so, and is refused.)
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    # a row per file; the place of a file in its folder leaves room for the ranges of each
    ordered = listed.withColumn("stream", F.xxhash64(folder)).withColumn("file", F.row_number().over(W.partitionBy("stream").orderBy("path")) - 1)
    place = (F.col("file").cast("long") * (1 << 32)).alias("block")
    none = F.array().cast("array<long>").alias("names")
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= whole_file).select("path", "content")
    found = small.join(ordered, "path").select("stream", place, F.col("content").alias("tokens"), none)
    for r in ordered.where(F.col("length") > whole_file).collect():  # a row per large file
        width = min(range_bytes, r["length"] & -r["length"])
        if width < 2:
            raise ValueError(f"{r['path']} ends in a broken id")
        kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
        records = spark.sparkContext.newAPIHadoopFile(r["path"], kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(width)})
        rows = spark.createDataFrame(records.map(lambda kv: (kv[0], bytearray(kv[1]))), "at long, tokens binary")
        base = r["file"] << 32
        found = found.unionByName(rows.select(F.lit(r["stream"]).alias("stream"), (F.lit(base) + F.col("at")).alias("block"), "tokens", none))
    return found


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Per block: its tokens, its ends, tokens before the first end and after the last, and the lengths of
    the documents that lie inside it."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            for part in slices(batch, "tokens"):
                n, ends, head, tail, inner = [], [], [], [], []
                for data in part.column(2):
                    raw = data.as_buffer() if data.is_valid else b""
                    ids = np.frombuffer(raw, dtype, len(raw) // width)
                    at = np.flatnonzero(ids == end_id)
                    n.append(len(ids))
                    ends.append(len(at))
                    head.append(int(at[0]) if len(at) else len(ids))
                    tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                    inner.append(np.diff(at) - 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in inner])]), pa.int32()), pa.array(np.concatenate(inner), pa.int64()))
                small = [pa.array(c, pa.int64()) for c in (n, ends, head, tail)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *small, lists, part.column(3)], ["stream", "block", "n", "ends", "head", "tail", "inner", "names"])

    names = F.col("names") if "names" in blocks.columns else F.array().cast("array<long>").alias("names")
    return blocks.select("stream", "block", "tokens", names).mapInArrow(run, "stream long, block long, n long, ends long, head long, tail long, inner array<long>, names array<long>")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2", chunk: int = CHUNK) -> DataFrame:
    """(stream, doc_no, n_tokens, closed, name) of every document; the end id itself isn't counted."""
    scan = materialize(scan_blocks(blocks, end_id, dtype), "scan")  # the tokens are read once
    slim = scan.select("stream", "block", "n", "ends", "tail", _chunk_of(chunk).alias("chunk"))
    before = W.partitionBy("stream", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # inside a chunk: tokens and ends before a block, and where the last end before it stands
    inside = (
        slim.withColumn("tokens_in", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ends_in", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("end_at", F.when(F.col("ends") > 0, F.col("tokens_in") + F.col("n") - F.col("tail")))
        .withColumn("last_in", F.max("end_at").over(before))
    )
    # over the chunks: a row for each
    chunks = inside.groupBy("stream", "chunk").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("end_at").alias("end_at"))
    earlier = W.partitionBy("stream").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("tokens_base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("ends_base", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    chunks = chunks.withColumn("last_base", F.coalesce(F.max(F.col("tokens_base") + F.col("end_at")).over(earlier), F.lit(0)))
    s = inside.join(chunks.select("stream", "chunk", "tokens_base", "ends_base", "last_base"), ["stream", "chunk"]).select(
        "stream",
        "block",
        (F.col("ends_base") + F.col("ends_in")).alias("first_doc"),
        # tokens open when the block begins: those since the last end in any earlier block
        (F.col("tokens_base") + F.col("tokens_in") - F.coalesce(F.col("tokens_base") + F.col("last_in"), F.col("last_base"))).alias("open"),
    )
    found = scan.where(F.col("ends") > 0).join(s, ["stream", "block"])
    lengths = F.concat(F.array(F.col("open") + F.col("head")), "inner")
    docs = F.transform(lengths, lambda n, i: F.struct((F.col("first_doc") + i).alias("doc_no"), n.alias("n_tokens"), F.lit(True).alias("closed"), F.get("names", i.cast("int")).alias("name")))
    closed = found.select("stream", F.explode(docs).alias("d"))
    total = chunks.groupBy("stream").agg(F.sum("ends").alias("doc_no"), (F.sum("n") - F.coalesce(F.max(F.col("tokens_base") + F.col("end_at")), F.lit(0))).alias("n_tokens"))
    rest = total.where("n_tokens > 0").select("stream", F.struct("doc_no", "n_tokens", F.lit(False).alias("closed"), F.lit(None).cast("long").alias("name")).alias("d"))
    return closed.unionByName(rest).select("stream", "d.doc_no", "d.n_tokens", "d.closed", "d.name")


def _chunk_of(chunk: int) -> F.Column:
    """Chunk of a block: files of a folder never share one, and blocks of a file fill one after another."""
    return F.struct(F.shiftright("block", 32).alias("file"), F.floor(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) / chunk).cast("long").alias("part"))
