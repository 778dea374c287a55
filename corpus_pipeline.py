"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import decontaminate, langid, packing, simhash, suffix_dedup
from vicinal.llm.common import materialize, table
from vicinal.shipping import ship


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or not one letter) go."""
    ship(spark)
    rows = langid.predict(docs, langid.learn(docs), names=("__lang", "__score"))
    return _columns(rows.where(F.col("__lang") != langid.UNKNOWN), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    ship(spark)
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts.

    A cut may fall inside a character; what is left of such a character goes too, and nothing else.
    """
    ship(spark)
    cut = suffix_dedup.cut_repeats(docs.withColumn("__none", F.col("text").isNull()), whole_characters=True)
    rows = cut.withColumn("text", F.when(~F.col("__none"), F.col("__kept").cast("string")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(rows, docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    items = table(spark, sf_dir, "benchmark")
    key = F.xxhash64("doc_id", "text")  # rows that share an id are told apart by text; rows that share both are equal
    index = decontaminate.stored_index(docs.select(key.alias("doc_id"), "text"))
    found = decontaminate.match(index, items)
    bad = materialize(found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return _columns(docs.withColumn("__row", key).join(bad, F.col("__row") == F.col("__key"), "left_anti"), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]

#: No SQL: the stages hash, tokenize and compare bytes in ways that SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
