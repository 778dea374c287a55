"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row per hash position and one bit per language in each row. The
AND of an n-gram's rows is the set of all languages that contain it. The bits are counted per
language over a text's n-grams, the expected false positives of that language's slice are taken
out, and the largest corrected count decides.

Learning uses about ``SAMPLE`` labelled texts of each language (picked by a hash of id and text; at most
twice as many; the bound is a parameter), of every language, and keeps all n-grams that ``MIN_TEXTS`` of them
share, or all of a language with few texts; prediction reads whole texts. The filter has a word of bits for every 64 languages, and rows by the language with the most
n-grams, so its size follows from the sample and the number of languages.

Nulls, empty texts and texts without a letter get ``und`` with score 0. Without labelled rows every text does.
A text whose letters make no known n-gram gets the commonest language with score 0. Repeated rows and rows with
equal ids are predicted one by one. Equal counts go to the language that sorts first. Empty tables give no rows.
A column of the table that is called like a new one gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import append_columns, buffers, slices

SAMPLE = 2000
#: Languages in a word of a row.
WORD = 64
#: Rows at least; there are more where a language has over an eighth as many n-grams.
ROWS_LOG2 = 22
HASHES = 3
GRAM = 5
#: An n-gram belongs to a language if so many of its sampled texts have it; any one will do if it has under MANY_TEXTS.
MIN_TEXTS = 3
MANY_TEXTS = 50
UNKNOWN = "und"
#: Bytes of text that are worked on at once; each byte takes some 50 in between.
BATCH_BYTES = 1 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LETTER = np.full(256, 32, np.uint8)
for _b in [*range(ord("a"), ord("z") + 1), *range(128, 256)]:
    _LETTER[_b] = _b


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, n-gram as 64-bit number) of all texts: lower-cased words with one space around each."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    raw, off = buffers(pc.binary_join_element_wise(space, low, space, none))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
    x = _LETTER[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    wide = np.ndarray((n,), "<u8", buffer=padded.data, strides=(1,)) & np.uint64((1 << (8 * GRAM)) - 1)
    whole = doc[:n] == doc[GRAM - 1 :]
    return doc[:n][whole], wide[whole]


def positions(gram: np.ndarray, k: int, rows_log2: int = ROWS_LOG2) -> np.ndarray:
    mixed = gram * _M[k]
    return ((mixed ^ (mixed >> np.uint64(31))) * _M[(k + 1) % 3]) >> np.uint64(64 - rows_log2)


class LanguageFilter:
    """Bit-sliced Bloom filter over languages, in words of 64 of them.

    ``mask`` has bits of the languages of one word; ``word`` says which (the first, if not given).
    """

    def __init__(self, languages: list[str], gram: np.ndarray, mask: np.ndarray, common: int = 0, word: np.ndarray | None = None):
        self.languages = languages
        self.common = common
        word = np.zeros(len(gram), np.int64) if word is None else word
        parts = [(languages[at : at + WORD], gram[word == at // WORD], mask[word == at // WORD]) for at in range(0, len(languages), WORD)]
        most = max(int(np.count_nonzero(m & np.uint64(1 << b))) for some, _, m in parts for b in range(len(some)))
        self.rows_log2 = max(ROWS_LOG2, (8 * most - 1).bit_length())
        self.words, self.false_rate = [], []
        for some, g, m in parts:
            kind = np.uint8 if len(some) <= 8 else np.uint16 if len(some) <= 16 else np.uint32 if len(some) <= 32 else np.uint64
            rows = np.zeros(1 << self.rows_log2, kind)
            for k in range(HASHES):
                np.bitwise_or.at(rows, positions(g, k, self.rows_log2), m.astype(kind))
            self.words.append(rows)
            self.false_rate += [float(np.mean((rows >> kind(b)) & kind(1))) ** HASHES for b in range(len(some))]

    def contained(self, gram: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the word's languages that contain each n-gram."""
        rows = self.words[word]
        found = rows[positions(gram, 0, self.rows_log2)]
        for k in range(1, HASHES):
            found = found & rows[positions(gram, k, self.rows_log2)]
        return found

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of each text; the commonest language, with score 0, where no n-gram is known."""
        doc, gram = grams(texts)
        n = len(texts)
        total = np.bincount(doc, minlength=n).astype(float)
        counts = np.zeros((n, len(self.languages)))
        for i, rate in enumerate(self.false_rate):
            w, b = divmod(i, WORD)
            if b == 0:
                found = self.contained(gram, w)
            seen = np.bincount(doc[((found >> found.dtype.type(b)) & found.dtype.type(1)).astype(bool)], minlength=n)
            counts[:, i] = np.maximum(0.0, (seen - rate * total) / max(1e-9, 1 - rate))
        best = counts.argmax(axis=1)
        top = counts[np.arange(n), best]
        score = np.divide(top, total, out=np.zeros(n), where=total > 0)
        return np.where(top > 0, best, self.common), np.clip(score, 0, 1)


def _count(languages: list[str]):
    index = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                lang = np.array([index[x] for x in part.column(part.schema.get_field_index("lang")).to_pylist()], np.int64)
                doc, gram = grams(part.column(part.schema.get_field_index("text")))
                # an n-gram has 40 bits: with the text's number, and then the language's (23 bits), it fits one key
                pair = np.unique((gram.astype(np.int64) << 20) | doc)
                key, n = np.unique(((pair >> 20) << 23) | lang[pair & 0xFFFFF], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 23, pa.int64()), pa.array((key & 0x7FFFFF).astype(np.int32), pa.int32()), pa.array(n.astype(np.int64), pa.int64())], ["gram", "lang", "n"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter | None:
    """A filter learned from a bounded sample of the rows that are not held out; None without such rows."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return None
    commonest = sizes[0]["lang"]
    sizes.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in sizes]
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)), F.lit(1 << 30))
    share = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, sample / r["count"]))) for r in sizes], "lang string, below long")
    drawn = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw")).join(F.broadcast(share), "lang").where(F.col("draw") < F.col("below"))
    # copies of a row are drawn together, so the number of rows is cut as well (in the map tasks already)
    drawn = drawn.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("n") <= 2 * sample)
    counted = drawn.select("text", "lang").mapInArrow(_count(languages), "gram long, lang int, n long")
    known = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    enough = F.array(*(F.lit(MIN_TEXTS if r["count"] >= MANY_TEXTS else 1) for r in sizes))
    found = known.where(F.col("n") >= F.element_at(enough, F.col("lang") + 1)).select("gram", "lang").toArrow()  # of the sampled texts
    lang = found["lang"].to_numpy().astype(np.int64)
    return LanguageFilter(languages, found["gram"].to_numpy().astype(np.uint64), np.uint64(1) << (lang % WORD).astype(np.uint64), languages.index(commonest), lang // WORD)


def predict(docs: DataFrame, model: LanguageFilter | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns (all, if not given), the predicted language and its score; lang, source and id play no part."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def compute(inputs):
        filt, some = shared.value, np.asarray(inputs[1])
        if filt is None:
            best, score = np.full(len(some), -1), np.zeros(len(some))
        else:
            best, score = filt.decide(inputs[0])
        found = [filt.languages[b] if s and filt else UNKNOWN for b, s in zip(best.tolist(), some)]
        return [pa.array(found, pa.string()), pa.array(np.where(some & (best >= 0), score, 0.0), pa.float64())]

    return append_columns(docs, keep, [F.col(text_col), letters], compute, f"{names[0]} string, {names[1]} double", BATCH_BYTES)
