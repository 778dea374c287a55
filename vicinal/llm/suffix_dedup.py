"""Removal of byte strings that also start in a document with a smaller id, by suffix arrays.

A string of ``LENGTH`` bytes goes if an earlier document has it too; the bytes that such strings cover
are removed. Everything is judged on the input.

1. Every window of ``LENGTH`` bytes is named by the least hash of the shorter strings inside it. Equal
   windows get equal names, wherever they are, so windows need comparing with those of one name only.
   Neighbouring windows of one name form a span; spans, as numbers, go to buckets by name.
2. In a bucket, a name seen under one id only is done. A name whose spans are all the same string is
   done too: the least id keeps it. Of the rest, the bytes of one span of each different content are
   fetched (by one pass over the documents, dealt to parts by id).
3. The different spans of a name form one text, whose suffix array is built by linear grouping
   (``gsaca``); equal windows stand next to each other in it, and the least id of each run is the one
   that keeps them. A name with more than ``TEXT_SPANS`` spans is named again by longer strings, until
   the name is the whole window.
4. The removals go back to the documents' parts, where they are merged and the texts are cut.

What tasks exchange are packed arrays; buckets and parts are sized by bytes, so their number grows
with the input. A span that stands more than ``FOLLOWERS`` times in what a task emits at once is sent to its bucket
twice only, under its least and its greatest id; the others wait in a group of their task's (``home``), to which the
bucket sends the answer. So a line that very many documents share is a few entries for each task, not one for
each document. Documents of equal id and text are cut once, and documents without an id not at all.

Equal strings are told by a name of 64 bits (bucket and rest) and a content hash of 56; a false match needs both to
agree, which for 10 ** 13 spans has a probability under 2 ** -25. Names that agree alone do no harm: the bytes decide.

Nulls and empty texts have no bytes. Documents without an id, or with equal ids, take nothing from each other, and
those without one keep everything. Texts shorter than ``LENGTH`` stay. Very long texts are read whole; long runs of
one name are cut into spans of ``SPAN_WINDOWS`` windows. Ties don't arise: of equal windows the least id's stay,
all of them. Empty tables give no rows. Extra columns pass through (names with two underscores in front are the
operator's own).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, materialize, release, run_starts, slices, spread, text_bytes
from .components import join_counted
from .gsaca import suffix_arrays

LENGTH = 50
#: Lengths of the strings that name a window, from one naming to the next.
NAMES = (20, 32, 42, 50)
TEXT_SPANS = 16
#: Windows of a span at most.
SPAN_WINDOWS = 64
BUCKET_BYTES = 6 << 20
PART_BYTES = 4 << 20
AT_LEAST = 32
#: Equal spans in one emission, from which on most of them wait at home.
FOLLOWERS = 256
#: Characters that a call of the suffix array construction takes.
CALL = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ROOT = np.uint64(0xD6E8FEB86659FD93)
_NAME_BITS, _CONTENT_BITS = 32, 56


# packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes (small and slowly changing numbers cost little)."""
    head, body = [struct.pack("<i", len(arrays))], []
    for a in arrays:
        kind = a.dtype.str.encode()
        head.append(struct.pack("<i4sq", len(kind), kind.ljust(4), len(a)))
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = b"".join(body)
    return b"".join(head) + struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    (k,) = struct.unpack_from("<i", blob, 0)
    at, spec = 4, []
    for _ in range(k):
        n_kind, kind, n = struct.unpack_from("<i4sq", blob, at)
        spec.append((np.dtype(kind[:n_kind].decode()), n))
        at += struct.calcsize("<i4sq")
    (size,) = struct.unpack_from("<q", blob, at)
    raw = np.frombuffer(pa.decompress(blob[at + 8 :], decompressed_size=size, codec="zstd") if size else b"", np.uint8)
    out, at = [], 0
    for dtype, n in spec:
        planes = raw[at : at + n * dtype.itemsize].reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel() if n else np.empty(0, dtype))
        at += n * dtype.itemsize
    return out


def merged(blobs) -> list[np.ndarray]:
    """The arrays of several packs, joined one by one."""
    return [np.concatenate(x) for x in zip(*map(unpack, blobs))]


def _released(function):
    """A group's function that gives free memory back when it is done; it keeps its number of arguments."""

    def one(key, rows):
        try:
            return function(key, rows)
        finally:
            release()

    def two(key, left, right):
        try:
            return function(key, left, right)
        finally:
            release()

    return one if function.__code__.co_argcount == 2 else two


# naming windows


def _slide(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def _string_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (4 or more over a multiple of 8 allowed) at each position."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(raw),), "<u8", buffer=padded.data, strides=(1,))
    h = np.full(n, np.uint64(width))
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        h ^= wide[at : at + n]
        h *= _A
        h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        step = base
        while have < n:
            out[have : 2 * have] = out[: min(have, n - have)] * step
            step = step * step
            have *= 2
    return out


_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))


def spans_of(raw: np.ndarray, offsets: np.ndarray, width: int, length: int = LENGTH):
    """(document, start in ``raw``, bytes, name, content hash) of the spans of all documents.

    A window is named by the least hash of its strings of ``width`` bytes; a span is a run of windows of one name.
    """
    none = np.empty(0, np.int64)
    h = _string_hashes(raw, width)
    n = len(raw) - length + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    name = _slide(h, length - width + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    ok = np.arange(n) + length <= offsets[1:][doc]
    where = np.flatnonzero(ok)
    if not len(where):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    begin = run_starts(name[where], doc[where])
    windows = np.diff(np.append(begin, len(where)))
    begin = where[begin]
    pieces = -(-windows // SPAN_WINDOWS)  # runs of repetitive text are cut
    begin, windows, k = np.repeat(begin, pieces), np.repeat(windows, pieces), spread(np.zeros(len(pieces), np.int64), pieces)
    begin, windows = begin + k * SPAN_WINDOWS, np.minimum(SPAN_WINDOWS, windows - k * SPAN_WINDOWS)
    size = windows + length - 1
    # content: a polynomial over the hashes of the span's strings
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_ROOT, len(h)))])
        content = (total[begin + size - width + 1] - total[begin]) * _powers(_INVERSE, len(h))[begin]
        content = (content ^ (content >> np.uint64(31)) ^ size.astype(np.uint64)) * _B
        content ^= content >> np.uint64(32)
    # least hashes crowd at the low end; names are spread out again, for buckets of like size
    spread_out = name[begin] * _C
    spread_out = (spread_out ^ (spread_out >> np.uint64(32))) * _A
    return doc[begin], begin, size, spread_out ^ (spread_out >> np.uint64(29)), content


# 1. spans of documents to buckets


def _split_followers(id_: np.ndarray, name: np.ndarray, content: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(spans that wait, spans that speak for them) where one content stands very often."""
    mixed = (content ^ (name * _A)) * _B
    order = np.argsort(mixed, kind="stable")
    starts = run_starts(mixed[order])
    count = np.diff(np.append(starts, len(order)))
    waits, speaks = np.zeros(len(id_), bool), np.zeros(len(id_), bool)
    for a, n in zip(starts[count > limit], count[count > limit]):
        i = order[a : a + n]
        if (name[i] == name[i[0]]).all() and (content[i] == content[i[0]]).all():
            least, most = i[np.argmin(id_[i])], i[np.argmax(id_[i])]
            waits[i] = True
            waits[[least, most]] = False
            speaks[least] = True
    return waits, speaks


def _emit_spans(n_buckets: int, followers: int):
    """Spans to the buckets 0 .. n_buckets - 1; those that wait, to the homes after them."""

    def rows(parts, *arrays):
        order = np.argsort(parts, kind="stable")
        cuts = np.append(run_starts(parts[order]), len(parts))
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = order[a:b]
            ids, at = _unique_pairs(arrays[0][i], arrays[1][i])
            yield int(parts[i[0]]), pack(ids[0], ids[1], at.astype(np.uint32), *(x[i] for x in arrays[2:]))

    def out(found):
        key, id_, check, start, size, name, content = (np.concatenate(x) for x in zip(*found))
        waits, speaks = _split_followers(id_, name ^ (key.astype(np.uint64) << np.uint64(_NAME_BITS)), content, followers)
        home = np.full(len(key), -1, np.int32)
        if waits.any():
            at_home = n_buckets + int((np.uint64(id_[0]) ^ content[0]) % np.uint64(n_buckets))
            home[speaks] = at_home
        sent = list(rows(key[~waits], *(x[~waits] for x in (id_, check, start, size, name, content, home))))
        if waits.any():
            w = np.flatnonzero(waits)
            sent += rows(np.full(len(w), at_home, np.int32), *(x[w] for x in (id_, check, start, size, name, content, key)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in sent], pa.int32()), pa.array([r[1] for r in sent], pa.binary())], ["part", "pack"])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                id_ = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                check = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                raw, off = buffers(part.column(2))
                doc, start, size, name, content = spans_of(raw, off, NAMES[0])
                if not len(doc):
                    continue
                key = (((name >> np.uint64(_NAME_BITS)) * np.uint64(n_buckets)) >> np.uint64(64 - _NAME_BITS)).astype(np.int32)
                found.append((key, id_[doc], check[doc].astype(np.uint32), (start - off[doc]).astype(np.uint32), size.astype(np.uint8), name & np.uint64((1 << _NAME_BITS) - 1), content & np.uint64((1 << _CONTENT_BITS) - 1)))
                held += len(doc)
                if held > 1 << 19:
                    yield out(found)
                    found, held = [], 0
        if found:
            yield out(found)
        release()

    return run


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (a, b) in order, and where each row's pair is."""
    order = np.lexsort((b, a))
    starts = run_starts(a[order], b[order])
    at = np.empty(len(a), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
    first = order[starts]
    return (a[first], b[first]), at


# 2. in a bucket: which names are shared


REMOVE, FETCH, OPEN, WAIT, ANSWER = range(5)


def _part_of(id_: np.ndarray, check: np.ndarray, n_parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (id_.astype(np.uint64) * _A) ^ (check.astype(np.uint64) * _B)
        h = (h ^ (h >> np.uint64(32))) * _C
    return ((h >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int32)


def _dealt(kind: int, part: np.ndarray, *arrays):
    """(kind, part, pack) rows, one for each part."""
    order = np.argsort(part, kind="stable")
    cuts = np.append(run_starts(part[order]), len(part))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i = order[a:b]
        yield kind, int(part[i[0]]), pack(*(x[i] for x in arrays))


def _table(rows) -> pa.Table:
    kinds, parts, blobs = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "part", "pack"])


def _answers(bucket: int, home: np.ndarray, name: np.ndarray, content: np.ndarray, size: np.ndarray, values: np.ndarray):
    """Rows for the homes of spans: the least id of each of a span's windows (``values``, span by span)."""
    windows = size.astype(np.int64) - LENGTH + 1
    first = np.cumsum(windows) - windows
    order = np.argsort(home, kind="stable")
    cuts = np.append(run_starts(home[order]), len(home))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i = order[a:b]
        yield ANSWER, int(home[i[0]]), pack(np.full(len(i), bucket, np.int32), name[i], content[i], size[i], values[spread(first[i], windows[i])])


def _removals(least: np.ndarray, first: np.ndarray, windows: np.ndarray, which: np.ndarray, id_: np.ndarray, check: np.ndarray, start: np.ndarray, n_parts: int):
    """Rows of what goes from spans whose windows' least ids are ``least[first[which]:][:windows[which]]``."""
    for lo in range(0, len(which), 1 << 18):
        w = which[lo : lo + (1 << 18)]
        n = windows[w]
        gone = least[spread(first[w], n)] < np.repeat(id_[lo : lo + (1 << 18)], n)
        owner = np.repeat(np.arange(len(w)), n)[gone]
        at = spread(np.zeros(len(w), np.int64), n)[gone]
        if not len(owner):
            continue
        jump = np.ones(len(owner), bool)
        jump[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        a = np.flatnonzero(jump)
        b = np.append(a[1:], len(owner)) - 1
        i = lo + owner[a]
        yield from _dealt(REMOVE, _part_of(id_[i], check[i], n_parts), id_[i], check[i], (start[i] + at[a]).astype(np.uint32), (at[b] - at[a] + LENGTH).astype(np.uint16))


def _unpacked(blobs) -> list[np.ndarray]:
    """id, check, start, size, name, content and the last column of packed spans."""
    cols = [[] for _ in range(7)]
    for blob in blobs:
        ids, checks, at, *rest = unpack(blob)
        for c, x in zip(cols, (ids[at], checks[at], *rest)):
            c.append(x)
    return [np.concatenate(c) for c in cols]


def _shared_names(n_parts: int, n_buckets: int):
    def run(key, rows):
        bucket = key[0].as_py()
        blobs = rows["pack"].to_pylist()
        if bucket >= n_buckets:  # a home: its spans wait for answers
            return _table([(WAIT, bucket, blob) for blob in blobs])
        id_, check, start, size, name, content, home = _unpacked(blobs)
        order = np.lexsort((id_, content, name))
        id_, check, start, size, name, content, home = (x[order] for x in (id_, check, start, size, name, content, home))
        by_name = run_starts(name)
        count = np.diff(np.append(by_name, len(name)))
        least, most = np.minimum.reduceat(id_, by_name), np.maximum.reduceat(id_, by_name)
        by_content = run_starts(name, content)
        contents = np.add.reduceat(np.isin(np.arange(len(name)), by_content, assume_unique=True).astype(np.int64), by_name)
        shared = least < most
        alone = np.repeat(shared & (contents == 1), count)
        keeps = np.repeat(least, count)
        several = np.repeat(shared & (contents > 1), count)
        out = []
        p = _part_of(id_, check, n_parts)
        gone = alone & (id_ > keeps)
        if gone.any():
            out += _dealt(REMOVE, p[gone], id_[gone], check[gone], start[gone], size[gone].astype(np.uint16))
        asked = np.flatnonzero(alone & (home >= 0))
        if len(asked):
            out += _answers(bucket, home[asked], name[asked], content[asked], size[asked], np.repeat(keeps[asked], size[asked].astype(np.int64) - LENGTH + 1))
        if several.any():
            # the first row of each content has its least id, and its bytes stand for all
            rep = np.zeros(len(name), bool)
            rep[by_content] = True
            rep &= several
            where = np.full(int(rep.sum()), bucket, np.int32)
            out += _dealt(FETCH, p[rep], id_[rep], check[rep], start[rep], size[rep], name[rep], content[rep], where)
            out.append((OPEN, bucket, pack(id_[several], check[several], start[several], size[several], name[several], content[several], home[several])))
        return _table(out)

    return run


# 3. bytes of different spans, and their suffix arrays


def _rows_of(docs: pa.Table, id_: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Row of ``docs`` (columns __id, __check) that each (id, check) names."""
    own = docs["__id"].to_numpy().astype(np.int64), docs["__check"].to_numpy().astype(np.int64)
    (a, b), at = _unique_pairs(np.concatenate([own[0], id_]), np.concatenate([own[1], check.astype(np.int64)]))
    row = np.full(len(a), -1, np.int64)
    row[at[: len(own[0])]] = np.arange(len(own[0]))
    return row[at[len(own[0]) :]]


def _fetch(key, docs, wanted):
    if not len(docs) or not len(wanted):
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "pack"])
    id_, check, start, size, name, content, bucket = merged(wanted["pack"].to_pylist())
    raw, off = buffers(docs["__text"])
    at = off[_rows_of(docs, id_, check)] + start
    rows = []
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(run_starts(bucket[order]), len(bucket))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i = order[a:b]
        rows.append((int(bucket[i[0]]), pack(id_[i], size[i], name[i], content[i]), raw[spread(at[i], size[i])].tobytes()))
    head = [struct.pack("<q", len(p)) + p + pa.compress(t, codec="zstd", asbytes=True) + struct.pack("<q", len(t)) for _, p, t in rows]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array(head, pa.binary())], names=["part", "pack"])


def least_ids(raw: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray, id_: np.ndarray, level: int = 0, length: int = LENGTH) -> np.ndarray:
    """The least id among equal windows of one name, for every window of the spans in order.

    Spans of one name differ in content. ``name`` holds small numbers, sorted.
    """
    windows = size - length + 1
    first = np.cumsum(windows) - windows
    out = np.repeat(id_, windows)
    if not len(start):
        return out
    by_name = run_starts(name)
    count = np.diff(np.append(by_name, len(name)))
    per_span = np.repeat(count, count)
    few = np.flatnonzero((per_span > 1) & (per_span <= TEXT_SPANS))
    many = np.flatnonzero(per_span > TEXT_SPANS)
    # texts of one name each: spans with a separator between them and the end symbol last
    if len(few):
        lane_of = np.cumsum(np.concatenate([[1], name[few][1:] != name[few][:-1]])) - 1
        # names of like size go through the construction together
        lane_size = np.bincount(lane_of, size[few] + 1).astype(np.int64)
        rank = np.empty(len(lane_size), np.int64)
        rank[np.argsort(lane_size, kind="stable")] = np.arange(len(lane_size))
        few = few[np.argsort(rank[lane_of], kind="stable")]
        lane_size = np.sort(lane_size, kind="stable")
        ends = np.cumsum(np.bincount(rank[lane_of]))
        volume = np.cumsum(lane_size)
        lane = 0
        while lane < len(lane_size):
            stop = max(lane + 1, int(np.searchsorted(volume, volume[lane] - lane_size[lane] + CALL, side="right")))
            stop = min(stop, len(lane_size))
            spans = few[(ends[lane - 1] if lane else 0) : ends[stop - 1]]
            _one_call(raw, start, size, name, id_, first, spans, out, length)
            lane = stop
    if len(many) and level + 1 < len(NAMES):
        # longer strings give finer names
        off = np.concatenate([[0], np.cumsum(size[many])])
        part = raw[spread(start[many], size[many])]
        doc, begin, sub_size, sub_name, content = spans_of(part, off, NAMES[level + 1], length)
        parent = many[doc]
        order = np.lexsort((id_[parent], content, sub_name, name[parent]))
        doc, begin, sub_size, parent = doc[order], begin[order], sub_size[order], parent[order]
        names = np.cumsum(np.concatenate([[1], (name[parent][1:] != name[parent][:-1]) | (sub_name[order][1:] != sub_name[order][:-1])])) - 1
        n = sub_size - length + 1
        if level + 2 == len(NAMES):  # the name is the window: each span is a run of it (of one byte), whatever its length
            new = run_starts(names)
            found = np.minimum.reduceat(id_[parent], new)
            answer = np.repeat(np.repeat(found, np.diff(np.append(new, len(names)))), n)
        else:
            new = run_starts(names, content[order])
            found = least_ids(part, begin[new], sub_size[new], names[new], id_[parent[new]], level + 1, length)
            found_first = np.cumsum(n[new]) - n[new]
            which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(names))))
            answer = found[spread(found_first[which], n)]
        to = first[parent] + begin - off[doc]
        np.minimum.at(out, spread(to, n), answer)
    return out


def _one_call(raw, start, size, name, id_, first, spans, out, length) -> None:
    n = size[spans]
    at = np.cumsum(n + 1) - (n + 1)
    text = np.ones(int((n + 1).sum()), np.int64)
    body = spread(at, n)
    text[body] = raw[spread(start[spans], n)].astype(np.int64) + 2
    last = np.flatnonzero(np.append(name[spans][1:] != name[spans][:-1], True))
    text[at[last] + n[last]] = 0
    lanes = np.concatenate([[0], at[last] + n[last] + 1])
    array = suffix_arrays(text, lanes)
    # windows in suffix order
    is_window = np.zeros(len(text), bool)
    is_window[spread(at, n - length + 1)] = True
    order = array[is_window[array]]
    span = np.searchsorted(at, order, side="right") - 1
    lane = np.searchsorted(lanes, order, side="right") - 1
    new = np.ones(len(order), bool)
    for lo in range(1, len(order), 1 << 18):
        i = np.arange(lo, min(lo + (1 << 18), len(order)))
        i = i[lane[i] == lane[i - 1]]
        same = np.ones(len(i), bool)
        for k in range(length):
            same[same] = text[order[i[same]] + k] == text[order[i[same] - 1] + k]
        new[i[same]] = False
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(id_[spans][span], starts)
    out[first[spans][span] + order - at[span]] = np.repeat(least, np.diff(np.append(starts, len(order))))


def _resolve(n_parts: int):
    def run(key, spans, occurrences):
        if not len(spans) or not len(occurrences):
            return _table([])
        heads, texts = [], []
        for blob in spans["pack"].to_pylist():
            (n,) = struct.unpack_from("<q", blob, 0)
            heads.append(blob[8 : 8 + n])
            (m,) = struct.unpack("<q", blob[-8:])
            texts.append(pa.decompress(blob[8 + n : -8], decompressed_size=m, codec="zstd", asbytes=True))
        id_, size, name, content = merged(heads)
        size = size.astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        start = np.cumsum(size) - size
        order = np.lexsort((content, name))
        id_, size, name, content, start = (x[order] for x in (id_, size, name, content, start))
        names = np.cumsum(np.concatenate([[1], name[1:] != name[:-1]])) - 1
        least = least_ids(raw, start, size, names, id_)
        windows = size - LENGTH + 1
        first = np.cumsum(windows) - windows
        # every occurrence of a span takes the span's answer; both sides are in order of name and content
        oid, ocheck, ostart, osize, oname, ocontent, ohome = merged(occurrences["pack"].to_pylist())
        change = np.zeros(len(oname), np.int64)
        change[run_starts(oname, ocontent)[1:]] = 1
        which = np.cumsum(change)
        out = list(_removals(least, first, windows, which, oid, ocheck, ostart, n_parts))
        asked = np.flatnonzero(ohome >= 0)
        if len(asked):
            w = which[asked]
            out += _answers(key[0].as_py(), ohome[asked], oname[asked], ocontent[asked], osize[asked], least[spread(first[w], windows[w])])
        return _table(out)

    return run


def _answered(n_parts: int):
    """Removals from the spans that wait at a home."""

    def run(key, waiting, answers):
        if not len(waiting) or not len(answers):
            return _table([])
        id_, check, start, size, name, content, bucket = _unpacked(waiting["pack"].to_pylist())
        abucket, aname, acontent, asize, values = merged(answers["pack"].to_pylist())
        code = lambda b, n: (b.astype(np.int64) << _NAME_BITS) | n.astype(np.int64)
        (a, _), at = _unique_pairs(np.concatenate([code(abucket, aname), code(bucket, name)]), np.concatenate([acontent, content]).astype(np.int64))
        row = np.full(len(a), -1, np.int64)
        row[at[: len(aname)]] = np.arange(len(aname))
        which = row[at[len(aname) :]]
        windows = asize.astype(np.int64) - LENGTH + 1
        known = np.flatnonzero(which >= 0)
        return _table(list(_removals(values, np.cumsum(windows) - windows, windows, which[known], id_[known], check[known], start[known], n_parts)))

    return run


# 4. cutting the texts


def _counted(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each position (one position more than flags)."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _widen(gone: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
    """Adds to the removed bytes what is left of the characters at their edges (a character has four bytes at most)."""
    inner = lambda at: at[(raw[at] & 0xC0) == 0x80]  # noqa: E731  bytes inside a character
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    begin = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]])) if len(raw) else off[:0]
    stop = np.flatnonzero(~gone & np.concatenate([[False], gone[:-1]])) if len(raw) else off[:0]
    for _ in range(3):
        begin = inner(begin)
        begin = begin[~first[begin]] - 1
        gone[begin] = True
        stop = inner(stop[~first[stop]])
        gone[stop] = True
        stop = stop[stop + 1 < len(raw)] + 1


def _cut(columns: list[str], whole_characters: bool):
    def run(key, docs, removals):
        n = len(docs)
        raw, off = buffers(docs["__text"])
        edge = np.zeros(len(raw) + 1, np.int32)
        if len(removals) and n:
            id_, check, start, size = merged(removals["pack"].to_pylist())
            row = _rows_of(docs, id_, check)
            at = off[row] + start
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
        np.cumsum(edge, out=edge)
        gone = edge[:-1] > 0
        del edge
        bytes_ = np.diff(off)
        total = _counted(gone)
        removed = total[off[1:]] - total[off[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = off[:-1][(bytes_ > 0)]
        begins[inner] = gone[inner]
        count = _counted(begins)
        spans = (count[off[1:]] - count[off[:-1]]).astype(np.int64)
        removed = removed.astype(np.int64)
        del count, total, begins
        if whole_characters:
            _widen(gone, raw, off)
        kept = raw[~gone]
        left = _counted(~gone)[off]
        data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
        found = [data, pa.array(bytes_), pa.array(removed), pa.array(spans)]
        return pa.table([*(docs[c] for c in columns), *found], names=[*columns, "__kept", "__n_bytes", "__n_removed", "__n_spans"])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, whole_characters: bool = False, followers: int = FOLLOWERS) -> DataFrame:
    """The kept columns (all but the text, if not given), and ``__kept`` (remaining bytes), ``__n_bytes``, ``__n_removed``, ``__n_spans``.

    With ``whole_characters``, ``__kept`` leaves out characters of which a byte is removed (the counts are as without).
    """
    columns = [c for c in docs.columns if c != text_col] if keep is None else keep
    check = F.xxhash64(text_col).bitwiseAND(F.lit(0xFFFFFFFF))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), check.alias("__check"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in columns))
    total = docs.agg(F.coalesce(F.sum(text_bytes("__text")), F.lit(0))).first()[0]
    # rows that repeat an id and text are cut once
    times = docs.where(F.col("__id").isNotNull()).groupBy("__id", "__check").agg(F.count("*").alias("__n")).where("__n > 1")
    if times.isEmpty():
        return _cut_distinct(docs, columns, total, whole_characters, followers)
    one = docs.where(F.col("__id").isNotNull()).select("__id", "__check", "__text").dropDuplicates(["__id", "__check"])
    cut = materialize(_cut_distinct(one, ["__id", "__check"], total, whole_characters, followers), "cut")
    counted = cut.join(times, ["__id", "__check"], "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    named = docs.drop("__text").where(F.col("__id").isNotNull()).withColumn("__row", F.struct("__id", "__check"))
    counted = counted.select(F.struct("__id", "__check").alias("__row"), "__n", *NEW)
    found = join_counted(named, counted, "__row", "__n", named.count()).select(*(F.col(f"`{c}`") for c in columns), *NEW)
    none = docs.where(F.col("__id").isNull())
    return found.unionByName(_cut_distinct(none, columns, total, whole_characters, followers))


NEW = ("__kept", "__n_bytes", "__n_removed", "__n_spans")


def _cut_distinct(docs: DataFrame, columns: list[str], total: int, whole_characters: bool, followers: int) -> DataFrame:
    """``cut_repeats`` of (__id, __check, __text, columns) without repeated rows, other than those without an id."""
    n_buckets = max(AT_LEAST, -(-total // BUCKET_BYTES))
    n_parts = max(AT_LEAST, -(-total // PART_BYTES))
    # documents without an id are never cut and cut nothing
    named = docs.where(F.col("__id").isNotNull() & (F.octet_length("__text") >= LENGTH)).select(F.col("__id").alias("id"), F.col("__check").alias("check"), F.col("__text").alias("text"))
    packs = "kind int, part int, pack binary"
    spans = named.mapInArrow(_emit_spans(n_buckets, followers), "part int, pack binary")
    shared = materialize(spans.groupBy("part").applyInArrow(_released(_shared_names(n_parts, n_buckets)), packs), "shared")
    kind = lambda df, k, part="part": df.where(F.col("kind") == k).select(F.col("part").alias(part), "pack").groupBy(part)
    # those without an id get keys of their own, which no removal has, and which spread them
    place = F.when(F.col("__id").isNull(), F.monotonically_increasing_id() + F.lit(1 << 33)).otherwise(F.col("__check"))
    # (the columns are numbered inside, as their names may clash)
    slim = [F.coalesce("__id", F.lit(0)).alias("__id"), place.alias("__check"), F.coalesce(F.col("__text").cast("binary"), F.lit(b"")).alias("__text")]
    dealt = _deal_documents(docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)), *slim), n_parts)
    bytes_ = dealt.select("__part", "__id", "__check", "__text").groupBy("__part").cogroup(kind(shared, FETCH, "__part")).applyInArrow(_released(_fetch), "part int, pack binary")
    solved = materialize(bytes_.groupBy("part").cogroup(kind(shared, OPEN)).applyInArrow(_released(_resolve(n_parts)), packs), "solved")
    both = shared.where(F.col("kind") == REMOVE).unionByName(solved.where(F.col("kind") == REMOVE))
    waiting = kind(shared, WAIT)
    answered = materialize(waiting.cogroup(kind(shared.unionByName(solved), ANSWER)).applyInArrow(_released(_answered(n_parts)), packs), "answered")
    removals = both.unionByName(answered).select(F.col("part").alias("__part"), "pack")
    out = "".join(f"`__c{i}` {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(columns))
    cut = dealt.groupBy("__part").cogroup(removals.groupBy("__part")).applyInArrow(_released(_cut([f"__c{i}" for i in range(len(columns))], whole_characters)), out + "__kept binary, __n_bytes long, __n_removed long, __n_spans long")
    return cut.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)), *NEW)


def _deal_documents(rows: DataFrame, n_parts: int) -> DataFrame:
    """Adds ``__part``, by the same rule as ``_part_of``."""

    @F.pandas_udf("int")
    def part(a, b):
        import pandas as pd

        return pd.Series(_part_of(a.to_numpy().astype(np.int64), b.to_numpy().astype(np.int64), n_parts))

    return rows.withColumn("__part", part("__id", "__check"))
