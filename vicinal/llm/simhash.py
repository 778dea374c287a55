"""SimHash near-duplicates, with pivot distance tables.

A text's fingerprint is the bitwise majority of the hashes of its shingles. Two fingerprints link if
they differ in at most ``RADIUS`` bits. The Hamming distances to ``PIVOTS`` reference fingerprints are
tabulated for each fingerprint; as distances obey the triangle inequality, a pair whose tables differ
by more than ``RADIUS`` in any coordinate can't link and is discarded; survivors are verified.

So that no task compares all fingerprints, they are first dealt to groups: of five runs of bits two
are equal in any linked pair (three bits can spoil three runs), which gives ten groups for each
fingerprint and loses no pair. A group of more than ``GROUP`` fingerprints is dealt again by the bits
that are still free, until it is small: with ``GROUP`` = 8192 that ends at 13 free bits at the latest.
Inside a large group, members are absorbed into clusters, so the links that leave a task are as many
as its members, not its pairs.

Copies share a fingerprint, and only distinct fingerprints are compared. Nulls and texts without a
word have fingerprint zero and link like any other. A null id takes part, but never names a
component unless all ids in it are null. Repeated rows stay. Empty tables give no rows. Texts of any length
are read whole, in parts. Ties: of equal ids in a component the text with the least checksum stays. A column
called like a new one gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialize, run_starts, spread
from .components import connected_components, join_counted

SHINGLE = 3
SEED = 42
RADIUS = 3
PIVOTS = 16
RUNS = RADIUS + 2
GROUP = 8192
#: Groups up to this size are compared pair by pair.
SMALL = 16

#: Reference fingerprints.
REFERENCES = np.random.default_rng(20240601).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
#: byte -> its bits as eight byte-wide counters
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _blocks(text: bytes, size: int = 1 << 22):
    """Word lists of a text; very long texts come in parts."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut].split()
        at = cut
    yield (text[at:] if at else text).split()


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included."""
    digest, out, carry, seen = xxhash.xxh64_intdigest, [], [], 0
    for words in _blocks((text or "").encode().lower()):
        seen += len(words)
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            out.append(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - width + 1))
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not out and seen:
        out.append(np.array([digest(b" ".join(carry), SEED)], np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprint of each hash list: the bits set in over half of it; zero for an empty list."""
    n = np.array([len(h) for h in hashes], np.int64)
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    # byte-wide counters hold 255 at most, so lists are summed in parts
    parts = -(-n // 255)
    begin = np.repeat(np.cumsum(n) - n, parts) + 255 * spread(np.zeros(len(n), np.int64), parts)
    owner = np.repeat(np.arange(len(n)), parts)
    counts = np.zeros((len(n), 64), np.int64)
    if len(begin):
        first = run_starts(owner)
        octets = every.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(_SPREAD[octets[:, b]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts[owner[first], 8 * b : 8 * b + 8] = np.add.reduceat(lanes, first, axis=0)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, width: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The kept columns (all, if not given) and the fingerprint as a signed 64-bit number."""

    def compute(inputs):
        return [pa.array(majority([shingle_hashes(t, width) for t in inputs[0].to_pylist()]).view(np.int64))]

    return append_columns(docs, keep, [F.col(text_col)], compute, f"{name} long", 2 << 20)


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def group_masks(fixed: int) -> list[int]:
    """Bits that are equal in each group of the next level, given the bits already equal."""
    free = [b for b in range(64) if not fixed >> b & 1]
    runs = [sum(1 << b for b in r.tolist()) for r in np.array_split(np.array(free, np.int64), RUNS)]
    return [fixed | runs[i] | runs[j] for i in range(RUNS) for j in range(i + 1, RUNS)]


def _deal(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        fixed = batch.column(1).to_numpy().view(np.uint64)
        for mask in np.unique(fixed):
            own = fp[fixed == mask]
            for m in group_masks(int(mask)):
                key = (own & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(m)
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(own), m, np.uint64).view(np.int64)), pa.array(own.view(np.int64))], ["key", "fixed", "fp"])


def _table(fp: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the references."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES).astype(np.int8)


def _small_groups(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Linked pairs of many small groups at once."""
    found = []
    for n in np.unique(sizes):
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        for lo in range(0, len(at), 1 << 14):
            rows = at[lo : lo + (1 << 14), None]
            a, b = (rows + i).ravel(), (rows + j).ravel()
            ok = np.ones(len(a), bool)
            for r in REFERENCES:  # largest coordinate difference, one reference at a time
                ok[ok] = np.abs(np.bitwise_count(fp[a[ok]] ^ r).astype(np.int8) - np.bitwise_count(fp[b[ok]] ^ r).astype(np.int8)) <= radius
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            found.append(np.stack([fp[a[ok]], fp[b[ok]]]))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.uint64)


def _large_group(fp: np.ndarray, radius: int) -> np.ndarray:
    """Links that join the clusters of one group: as many as members at most."""
    table = _table(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first = table[:, 0]
    open_ = np.ones(len(fp), bool)
    a, b = [], []
    for seed in range(len(fp)):
        if not open_[seed]:
            continue
        open_[seed] = False
        todo = [seed]
        while todo:
            x = todo.pop()
            lo, hi = np.searchsorted(first, [first[x] - radius, first[x] + radius + 1])
            near = lo + np.flatnonzero(open_[lo:hi])
            near = near[np.abs(table[near] - table[x]).max(axis=1) <= radius] if len(near) else near
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
            if len(near):
                open_[near] = False
                a.append(np.full(len(near), fp[x]))
                b.append(fp[near])
                todo.extend(near.tolist())
    return np.stack([np.concatenate(a), np.concatenate(b)]) if a else np.empty((2, 0), np.uint64)


def _link(radius: int, limit: int):
    """Links inside groups that come sorted by key; members of groups over the limit come back instead."""

    def rows(kind, u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["kind", "u", "v"])

    def groups(pieces):
        pieces = [p for p in pieces if len(p[0])]
        if not pieces:
            return
        key, fixed, fp = (np.concatenate(x) for x in zip(*pieces))
        starts = run_starts(key)
        sizes = np.diff(np.append(starts, len(key)))
        few = (sizes > 1) & (sizes <= SMALL)
        yield rows(0, *_small_groups(fp, starts[few], sizes[few], radius))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            if n <= limit:
                yield rows(0, *_large_group(fp[s : s + n], radius))
            else:
                yield rows(1, fp[s : s + n], fixed[s : s + n])

    def run(batches):
        open_key, held, size = None, [], 0  # the group that the last batch ended in; over the limit, only its size is kept
        for batch in batches:
            cols = [batch.column(i).to_numpy().view(np.uint64) for i in range(3)]
            key, n = cols[0], batch.num_rows
            if not n:
                continue
            same = 0 if open_key is None else n if (key == open_key).all() else int(np.argmax(key != open_key))
            last = max(same, int(run_starts(key)[-1]))
            for begin, stop in ((0, same), (last, n)):
                if begin == last and stop > begin:  # the open group is whole
                    yield from groups([*held, [c[same:last] for c in cols]])
                    open_key, held, size = key[-1], [], 0
                if stop > begin:
                    held.append([c[begin:stop] for c in cols])
                    size += stop - begin
                    if size > limit:
                        for _, fixed, fp in held:
                            yield rows(1, fp, fixed)
                        held = []
        yield from groups(held)

    return run


def links(distinct_fp: DataFrame, radius: int = RADIUS, limit: int = GROUP) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all whose distance is at most ``radius``."""
    if radius != RADIUS:
        raise ValueError(f"groups are laid out for a radius of {RADIUS}")
    level = distinct_fp.select("fp", F.lit(0).cast("long").alias("fixed"))
    found = None
    while True:
        dealt = level.mapInArrow(_deal, "key long, fixed long, fp long")
        sorted_ = dealt.repartition("key").sortWithinPartitions("key", "fp")
        out = materialize(sorted_.mapInArrow(_link(radius, limit), "kind int, u long, v long"), "simhash")
        part = out.where("kind = 0").select("u", "v")
        found = part if found is None else found.unionByName(part)
        level = out.where("kind = 1").select(F.col("u").alias("fp"), F.col("v").alias("fixed")).distinct()
        if level.isEmpty():
            return found


def components(prints: DataFrame, id_col: str = "doc_id", limit: int = GROUP) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``prints`` (id, fp): the smallest id reachable by links."""
    own = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")), "distinct")
    roots = connected_components(links(own.select("fp"), limit=limit))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return join_counted(named, least, "root", "n", named.count()).select("fp", "root", "component_id", "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"]), "prints")
    return join_counted(prints, materialize(components(prints), "components"), "fp", "rows", prints.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (of rows that repeat it, one)."""
    check = F.xxhash64(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), check.alias("check"))
    prints = materialize(fingerprints(slim, keep=["doc_id", "check"]), "prints")
    # the row that stays, by id and checksum of its text, rows without an id last
    found = join_counted(prints, materialize(components(prints), "components"), "fp", "rows", prints.count())
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check")).alias("b"))
    kept = materialize(best.select(F.col("b.doc_id").alias("__id"), F.col("b.check").alias("__kept")), "kept")
    rows = docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (check.eqNullSafe(F.col("__kept"))), "left_semi")
    if prints.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("check") == F.col("__kept")), "left_semi").count() > kept.count():
        # one of each set of repeated rows, put together in the map tasks first
        rows = rows.withColumn("__check", check).dropDuplicates([id_col, "__check"])
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
