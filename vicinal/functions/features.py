"""Feature extractors over pixel, region and descriptor tables, and array functions on descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multipliers of the 14 region features (9 colour moments, 5 box features).
DIMENSION_WEIGHTS = [6.0, 3.0, 1.5, 4.0, 2.0, 1.0, 4.0, 2.0, 1.0, 0.2, 0.4, 0.04, 0.007, 0.007]
HISTOGRAM_BINS = 16
TOPK_RANK = 90


def binarify(v: Column, first_rank: int = TOPK_RANK, word_bits: int = 32) -> Column:
    """Bits of the components whose ascending rank is ``first_rank`` or more, packed into words (ties by index)."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    top = F.transform(F.slice(ranked, F.lit(first_rank + 1), F.greatest(F.size(v) - first_rank, F.lit(0))), lambda s: s["i"])
    words = F.sequence(F.lit(0), ((F.size(v) + word_bits - 1) / word_bits).cast("int") - 1)
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.filter(top, lambda i: F.floor(i / word_bits) == w),
            F.lit(0).cast("long"),
            # bits are distinct, so adding sets them
            lambda s, i: s + F.pow(F.lit(2.0), i % word_bits).cast("long"),
        ),
    )


def entropy(v: Column) -> Column:
    """Shannon entropy (bits) of the 256-bin histogram of round(255 x)."""
    bins = F.filter(F.transform(v, lambda x: F.floor(x.cast("double") * 255 + 0.5)), lambda b: (b >= 0) & (b < 256))
    n = F.size(v).cast("double")
    counts = F.transform(F.array_distinct(bins), lambda b: F.size(F.filter(bins, lambda c: c == b)).cast("double") / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)).cast("float")


def sign_words(v: Column, word_bits: int = 32) -> Column:
    """Sign bits packed into words, bit i of a word for its i-th component."""
    words = F.sequence(F.lit(0), ((F.size(v) + word_bits - 1) / word_bits).cast("int") - 1)
    return F.transform(
        words,
        lambda w: F.aggregate(
            F.transform(F.slice(v, w * word_bits + 1, F.lit(word_bits)), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda s, b: s + b,
        ),
    )


def weighted(v: Column, weights=None) -> Column:
    """Components times fixed multipliers."""
    return F.zip_with(v, F.array(*(F.lit(w) for w in weights or DIMENSION_WEIGHTS)), lambda x, w: x * w)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def limited_size(width: Column, height: Column, largest: int = 400, smallest: int = 80) -> Column:
    """(width, height, scale) that keeps the aspect: not over ``largest``, then not under ``smallest``."""
    down = F.least(F.lit(1.0), largest / F.greatest(width, height))
    up = F.greatest(F.lit(1.0), smallest / (F.least(width, height) * down))
    scale = down * up
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"), scale.alias("scale"))


def descriptor_scale(v: Column) -> Column:
    """Doubled, at most 1."""
    return F.transform(v, lambda x: F.least(x * 2, F.lit(1.0)))


def color_histogram(pixels: DataFrame, key: str, channels: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(key, channel, bin, value): uniform bins over [0, 256) for each channel, scaled to length 1 over all of a key's bins."""
    long = pixels.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias("x")) for i, c in enumerate(channels)))).alias("s")).select(key, "s.channel", F.floor(F.col("s.x") / (256 / bins)).cast("int").alias("bin"))
    counts = long.where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(key, "channel", "bin").agg(F.count("*").cast("double").alias("n"))
    # one row per key: bins x channels entries at most
    packed = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.collect_list(F.struct("channel", "bin", "n")).alias("b"))
    return packed.select(key, "norm", F.explode("b").alias("e")).select(key, "e.channel", "e.bin", (F.col("e.n") / F.col("norm")).alias("value"))


def color_moments(pixels: DataFrame, key: list[str], channels: list[str]) -> DataFrame:
    """Mean, root of the variance and cube root of the third central moment of x / 255, per channel."""
    aggs = []
    for c in channels:
        x = F.col(c) / 255.0
        aggs += [F.avg(x).alias(f"{c}_m1"), F.avg(x * x).alias(f"{c}_m2"), F.avg(x * x * x).alias(f"{c}_m3")]
    out = pixels.groupBy(*key).agg(*aggs)
    cols = []
    for c in channels:
        m1, m2, m3 = (F.col(f"{c}_m{i}") for i in (1, 2, 3))
        cols += [m1.alias(f"{c}_mean"), F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0))).alias(f"{c}_sigma"), F.cbrt(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1).alias(f"{c}_skew")]
    return out.select(*key, *cols)


def box_features(pixels: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Of each region: log aspect, share of its box that it fills, log box area, and the sums of x and y."""
    b = pixels.groupBy(*key).agg((F.max(x) - F.min(x) + 1).alias("dx"), (F.max(y) - F.min(y) + 1).alias("dy"), F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"))
    area = F.col("dx") * F.col("dy")
    return b.select(*key, F.log(F.col("dy") / F.col("dx")).alias("log_aspect"), (F.col("n") / area).alias("fill"), F.log(area).alias("log_area"), "sum_x", "sum_y")


def region_weights(pixels: DataFrame, key: str, region: str) -> DataFrame:
    """Root of a region's pixels, as a share of its object's."""
    n = pixels.groupBy(key, region).agg(F.sqrt(F.count("*")).alias("w"))
    total = n.groupBy(key).agg(F.sum("w").alias("total"))
    return n.join(total, key).select(key, region, (F.col("w") / F.col("total")).alias("weight"))


def float_vector(content: Column, dim: int) -> Column:
    """Vector of ``dim`` floats from text; null if there are fewer or one can't be read."""
    v = F.transform(F.slice(F.filter(F.split(content, r"\s+"), lambda t: t != ""), 1, dim), lambda t: t.try_cast("float"))
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v)


def word_vector(content: Column, dim: int = 32) -> Column:
    """Vector of ``dim`` unsigned 32-bit words from text; null if there are fewer."""
    v = F.transform(F.slice(F.filter(F.split(content, r"\s+"), lambda t: t != ""), 1, dim), lambda t: t.try_cast("long"))
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | (x < 0) | (x > 0xFFFFFFFF)), v)
