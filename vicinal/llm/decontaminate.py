"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into words and stored as index segments: for each word of a segment the
list of positions where it stands (postings), and where each document's words begin. A segment holds
whole documents, so phrases never cross segments and searching needs no shuffle.

Test items become windows of ``WINDOW`` words. In a segment, a window starts from its rarest word: its
postings, moved back by the word's offset, are the candidate starts; they are intersected with the
moved lists of the next rarest words in turn (binary search in the sorted lists, for many windows at a
time), so that most candidates are gone after one step.

Items are packed into blocks of ``BLOCK_BYTES`` of text by the executors. One block is broadcast at a time;
where there are several, each one's finds are written before the next is taken, and put together by document.

Nulls and texts without a word have no words, no window and no hit. An item without an id still marks
words. Repeated documents and repeated items are treated one by one (an id counts once per document).
Very long texts are read in parts that end between words. Ties don't arise. Empty tables give no rows, or rows
without hits. Other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, run_starts, slices, spread

# Fixed value: what a word is.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Bytes of item texts in a block (one item at least).
BLOCK_BYTES = 8 << 20
#: Windows that are looked up at once.
WINDOWS = 1 << 16
SEGMENT_BYTES = 4 << 20
CANDIDATES = 1 << 21

_find = re.compile(WORD).findall
SEGMENT = "doc_ids array<long>, n_words array<long>, terms binary, list_lengths binary, positions binary"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return _find(text.lower())


def _blocks(text: bytes, size: int = 1 << 22):
    """Parts of a very long text, cut where no word is open."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        m = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, cut)
        cut = m.end() if m else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index segments of all texts, every word's postings included."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", segment_bytes):
                known: dict[bytes, int] = {}
                ids, n_words = [], []
                for text in part.column(1).to_pylist():
                    n = 0
                    for block in _blocks((text or "").encode()):
                        found = words(block)
                        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
                        n += len(found)
                    n_words.append(n)
                every = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([n_words], pa.list_(pa.int64())),
                        pa.array([b" ".join(known)], pa.binary()),
                        pa.array([np.bincount(every, minlength=len(known)).astype("<i4").tobytes()], pa.binary()),
                        pa.array([np.argsort(every, kind="stable").astype("<i4").tobytes()], pa.binary()),
                    ],
                    ["doc_ids", "n_words", "terms", "list_lengths", "positions"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEGMENT)


def pack_items(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of items (item_id, text): vocabulary, word numbers of all items one after another, their lengths and ids."""

    def run(batches):
        known: dict[bytes, int] = {}
        names, ids, size = [], [], 0

        def out():
            every = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([b" ".join(known)], pa.binary()), pa.array([every.astype("<i4").tobytes()], pa.binary()), pa.array([[len(i) for i in ids]], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.string()))],
                ["terms", "ids", "n_words", "names"],
            )

        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for_item = [np.fromiter((known.setdefault(w, len(known)) for w in words(block)), np.int32) for block in _blocks((text or "").encode())]
                    ids.append(np.concatenate(for_item))
                    names.append(name)
                    size += len(text or "") + 8
                    if size >= block_bytes:
                        yield out()
                        known, names, ids, size = {}, [], [], 0
        if names:
            yield out()

    return items.select("item_id", "text").mapInArrow(run, "terms binary, ids binary, n_words array<long>, names array<string>")


class Windows:
    """The windows of a block of test items, by length, as numbers of the block's vocabulary."""

    def __init__(self, terms: bytes, ids: bytes, n_words: list[int], names: list[str | None], width: int = WINDOW):
        self.vocabulary = {t: i for i, t in enumerate(terms.split(b" "))} if ids else {}
        self.names, self.width = names, width
        self.ids, self.n = np.frombuffer(ids, "<i4"), np.array(n_words, np.int64)

    def groups(self):
        """(windows of one length, item of each) in pieces of a bounded size."""
        first = np.cumsum(self.n) - self.n
        for length in np.unique(np.minimum(self.n[self.n > 0], self.width)).tolist():
            items = np.flatnonzero((np.minimum(self.n, self.width) == length))
            count = self.n[items] - length + 1
            start, owner = spread(first[items], count), np.repeat(items, count)
            for at in range(0, len(start), WINDOWS):
                yield self.ids[start[at : at + WINDOWS, None] + np.arange(length)], owner[at : at + WINDOWS]


class Segment:
    """One index segment, reduced to the words of a block's vocabulary."""

    def __init__(self, n_words, terms: bytes, list_lengths: bytes, positions: bytes, vocabulary: dict[bytes, int]):
        n = np.asarray(n_words, np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.total = int(self.first[-1])
        lengths = np.frombuffer(list_lengths, "<i4").astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        get = vocabulary.get
        local = np.array([get(t, -1) for t in terms.split(b" ")], np.int64) if len(lengths) else np.empty(0, np.int64)
        here = np.flatnonzero(local >= 0)
        self.length = np.zeros(len(vocabulary), np.int64)
        self.begin = np.zeros(len(vocabulary), np.int64)
        self.length[local[here]] = lengths[here]
        self.begin[local[here]] = np.cumsum(lengths[here]) - lengths[here]
        self.postings = np.frombuffer(positions, "<i4")[spread(begin[here], lengths[here])].astype(np.int64)
        #: the lists in one sorted array: a list's number times the segment's size, plus the position
        self.rank = np.zeros(len(vocabulary), np.int64)
        self.rank[local[here]] = np.arange(len(here))
        self.listed = np.repeat(np.arange(len(here)), lengths[here]) * self.total + self.postings

    def has(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Is each position in its word's list? (The words have lists.)"""
        wanted = self.rank[word] * self.total + position
        at = np.searchsorted(self.listed, wanted)
        return self.listed[np.minimum(at, len(self.listed) - 1)] == wanted

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window row, start position) of every occurrence of the windows as a phrase inside one document."""
        width = windows.shape[1]
        lists = self.length[windows]
        live = np.flatnonzero((lists > 0).all(axis=1))
        found_w, found_s = [], []
        order = np.argsort(lists[live], axis=1, kind="stable")
        rarest = lists[live, order[:, 0]] if len(live) else np.empty(0, np.int64)
        at = 0
        while at < len(live):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(rarest[at:]), CANDIDATES)) + at)
            w, o, n = live[at:stop], order[at:stop], rarest[at:stop]
            row = np.repeat(np.arange(len(w)), n)
            start = self.postings[spread(self.begin[windows[w, o[:, 0]]], n)] - o[row, 0]
            ok = (start >= 0) & (start + width <= self.total)
            row, start = row[ok], start[ok]
            for k in range(1, width):
                if not len(row):
                    break
                off = o[row, k]
                ok = self.has(windows[w[row], off], start + off)
                row, start = row[ok], start[ok]
            same = self.doc_of(start) == self.doc_of(start + width - 1)
            found_w.append(w[row[same]])
            found_s.append(start[same])
            at = stop
        none = np.empty(0, np.int64)
        return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (none, none)

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window row, start) of spans of ``width + slop`` words that hold all the window's words, in any order.

        A span starts at an occurrence of one of the words and ends with its document at the latest; spans may overlap.
        """
        span = windows.shape[1] + slop
        out_w, out_s = [], []
        for w in np.flatnonzero((self.length[windows] > 0).all(axis=1)):
            terms = sorted(np.unique(windows[w]), key=lambda t: self.length[t])
            lists = {t: self.postings[self.begin[t] : self.begin[t] + self.length[t]] for t in terms}
            starts = np.sort(np.concatenate(list(lists.values())))
            end = np.minimum(starts + span, self.first[self.doc_of(starts) + 1])
            # only starts that have the rarest word in reach, then the other words one by one
            for t in terms:
                i = np.searchsorted(lists[t], starts)
                ok = (i < len(lists[t])) & (lists[t][np.minimum(i, len(lists[t]) - 1)] < end)
                starts, end = starts[ok], end[ok]
            out_w.append(np.full(len(starts), w))
            out_s.append(starts)
        none = np.empty(0, np.int64)
        return (np.concatenate(out_w), np.concatenate(out_s)) if out_w else (none, none)


def _search(shared, slop: int | None):
    def run(batches):
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):  # a segment at a time
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                seg = Segment(row["n_words"], row["terms"], row["list_lengths"], row["positions"], block.vocabulary)
                starts, ends, owners = [], [], []
                for windows, owner in block.groups():
                    w, s = seg.exact(windows) if slop is None else seg.near(windows, slop)
                    starts.append(s)
                    ends.append(s + windows.shape[1] + (slop or 0))
                    owners.append(owner[w])
                start, end, item = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends, owners))
                doc = seg.doc_of(start)
                # words under any occurrence, as maximal runs
                edge = np.zeros(seg.total + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(end, seg.first[doc + 1]), -1)
                covered = np.cumsum(edge[:-1]) > 0
                split = np.zeros(seg.total + 1, bool)
                split[seg.first] = True
                begins = np.flatnonzero(covered & (np.concatenate([[True], ~covered[:-1]]) | split[:-1]) if len(covered) else covered)
                stops = np.flatnonzero(covered & (np.concatenate([~covered[1:], [True]]) | split[1:]) if len(covered) else covered) + 1
                spans: list[list] = [[] for _ in row["doc_ids"]]
                own = seg.doc_of(begins)
                for d, a, b in zip(own.tolist(), (begins - seg.first[own]).tolist(), (stops - seg.first[own]).tolist()):
                    spans[d].append({"start": a, "stop": b})
                items: list[list] = [[] for _ in row["doc_ids"]]
                pair = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
                for d, i in pair.T.tolist():
                    items[d].append(block.names[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["n_words"], pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(np.arange(len(spans)), pa.int64()),
                        pa.array([row["segment"]] * len(spans), pa.int64()),
                    ],
                    ["doc_id", "n_words", "spans", "items", "ordinal", "segment"],
                )

    return run


FOUND = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, ordinal long, segment long"


def _covered(spans: Column) -> Column:
    """Words under sorted spans that may overlap."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["stop"]).alias("upto"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["upto"], x["start"]))).alias("n")),
        lambda s: s["n"],
    )


def match(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document: its words, the spans of words that occur in test windows, the items' ids, and how many words are hit.

    ``slop`` None finds the windows as exact phrases; a number finds them in any order inside a span of that many words more.
    """
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 8 * F.count("*")).first()[0]
    blocks = materialize(pack_items(items.coalesce(max(1, -(-size // BLOCK_BYTES))), BLOCK_BYTES).withColumn("block", F.monotonically_increasing_id()), "items")
    numbers = sorted(r["block"] for r in blocks.select("block").collect())  # a number per block
    found = None
    for number in numbers or [None]:
        row = blocks.where(F.col("block") == number).first() if numbers else None  # one block
        shared = spark.sparkContext.broadcast(Windows(bytes(row["terms"]), bytes(row["ids"]), row["n_words"], row["names"], width) if row else Windows(b"", b"", [], [], width))
        part = index.mapInArrow(_search(shared, slop), FOUND)
        if len(numbers) > 1:
            part = materialize(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if len(numbers) > 1:
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.select("doc_id", "n_words", "spans", F.array_distinct("items").alias("items"), _covered(F.col("spans")).alias("n_hit"), "segment", "ordinal")


def stored_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents, written to the shared folder."""
    return materialize(build_index(docs, id_col, text_col).withColumn("segment", F.monotonically_increasing_id()), "postings")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
