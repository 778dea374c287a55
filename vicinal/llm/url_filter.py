"""URL filter: allow/block rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame and SQL functions, training included:

* a URL becomes counts of hashed 3- and 4-grams of ``host + path``, scaled to length 1;
* the labelled table is small (a parameter, at most ``MAX_LABELLED`` rows); it is fitted with the
  DataFrame-based logistic regression of Spark ML, on count vectors whose index is the bucket;
* scoring looks the buckets up in that array of ``BUCKETS`` weights (a fixed size).

Nulls and URLs without ``://`` have an empty host and path, fit no rule and get the model's verdict
for "no n-gram" (its intercept). Repeated rows are scored alike; an empty table gives no rows; other columns
of the table, whatever their names, are not read. URLs of any length are read whole. Of rules of equal length
the one with the longer host wins, then the one that sorts first.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
GRAMS = (3, 4)
MAX_LABELLED = 3000
#: URLs that an n-gram must stand in to have a weight.
MIN_URLS = 6

# The rules (host, path, verdict) of the standard filter.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The vocabulary of the small labelled table. Block: the kinds of sites that public block lists
# name (gambling, sex, medicine, money, fraud, fakes, advertising). Allow: what ordinary sites are named after.
BLOCK_WORDS = """
poker roulette blackjack jackpot slot gambling betting lottery bingo wager sportsbook
porn xxx sex escort webcam nude milf fetish dating singles
viagra cialis pharmacy meds tramadol steroid slimming diet keto
payday loan debt forex bitcoin crypto profit cash rich
phish verify account-update password invoice prize reward giveaway survey
replica rolex fake warez crack keygen serial torrent cheat hack
adserver banner popup popunder affiliate click traffic seo backlink pixel telemetry spyware malware
""".split()
ALLOW_WORDS = """
news journal daily post times press radio review magazine letter
school college library museum archive academy lesson science physics history
garden forest river mountain island harbour weather travel railway airport
music theatre cinema painting poetry novel recipe kitchen bakery coffee
city council police hospital doctor church parliament law bank insurance
software data network engine compiler robot camera phone hardware wiki
football tennis cycling hiking chess sailing swimming runner horse bird
family children house furniture bicycle market tools paper clothing shoes
""".split()
LABELLED_SITES = ("{}.com", "www.{}.org", "{}.info", "my{}.net", "{}.co.uk", "the{}.eu")
LABELLED_PATHS = ("", "/", "/index.php", "/articles/{}", "/archive/{}/view", "/item-{}.htm")
INVENTED = 800
#: Distances between words of a list that make pairs.
PAIRED = (1, 3, 7, 11, 17, 19, 23, 29, 31, 37)


def _invented(rng: random.Random) -> str:
    """A name of two to four syllables that is no word: most sites are called like that."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(("", "", "h", "r", "l")) + rng.choice("aeiouy") + rng.choice(("", "n", "r", "s", "t")) for _ in range(rng.randint(2, 4)))


def labelled_urls(spark: SparkSession, pairs=lambda a, b: True) -> DataFrame:
    """The built-in labelled table (url, label); 1 is block.

    Each word of a vocabulary stands alone and in pairs with others of its list; ``pairs`` says which pairs to use, so
    that others can be kept for testing. Invented names are allowed.
    """
    rng = random.Random(2024)
    rows = []

    def add(name: str, label: int) -> None:
        site, path = rng.choice(LABELLED_SITES), rng.choice(LABELLED_PATHS)
        rows.append((f"http://{site.format(name)}{path.format(rng.randrange(1000))}", label))

    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, a in enumerate(words):
            add(a, label)
            for step in PAIRED:
                b = words[(i + step) % len(words)]
                add(rng.choice((f"{a}-{b}", f"{a}{b}", f"{b}{a}", f"{a}.{b}")), label)
                if not pairs(a, b):
                    rows.pop()
    for _ in range(INVENTED):
        add(_invented(rng), 0)
    return spark.createDataFrame(rows, "url string, label int")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(text: Column) -> Column:
    """Hashed n-grams of a text, repeats included."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        hashed = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
        return F.when(F.length(text) >= n, hashed).otherwise(F.array().cast("array<int>"))

    return F.concat(*map(of_length, GRAMS))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", decay: float = 0.001, rounds: int = 100) -> list[float]:
    """Weights of the buckets, the intercept last. Rows without a label are left out; a URL with both labels is blocked.

    Of a table over ``MAX_LABELLED`` distinct URLs, half that many of each label are fitted, those whose hashes are
    least. A table without rows, or with one label only, gives weights that decide for that label (or allow).
    """
    host, path = host_path(F.col(url_col))
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.concat(host, path).alias("t"), (F.col(label_col) > 0).cast("double").alias("label"))
    rows = rows.groupBy("t").agg(F.max("label").alias("label"))
    share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(share) < 2:
        return [0.0] * BUCKETS + [5.0 if 1.0 in share else -5.0]
    drawn = [rows.where(F.col("label") == label).orderBy(F.xxhash64("t"), "t").limit(MAX_LABELLED // 2) for label in (0.0, 1.0)]
    rows = drawn[0].unionByName(drawn[1]).coalesce(1)
    rows = rows.select("label", buckets(F.col("t")).cast("array<string>").alias("grams"), F.when(F.col("label") > 0, 1 / share[1.0]).otherwise(1 / share[0.0]).alias("weight"))
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], inputCol="grams", outputCol="counts")
    rows = Normalizer(inputCol="counts", outputCol="features").transform(counts.transform(rows))
    # an n-gram of a few URLs says nothing of others
    often = rows.select(F.explode(F.array_distinct("grams")).alias("b")).groupBy("b").count().where(F.col("count") >= MIN_URLS)
    kept = {int(r["b"]) for r in often.collect()}  # BUCKETS rows at most
    rows = VectorSlicer(inputCol="features", outputCol="known", indices=sorted(kept)).transform(rows)
    model = LogisticRegression(featuresCol="known", weightCol="weight", regParam=decay, maxIter=rounds, standardization=False).fit(rows)
    weights = [0.0] * BUCKETS
    for b, w in zip(sorted(kept), model.coefficients.toArray()):
        weights[b] = round(float(w), 9)
    return [*weights, round(float(model.intercept), 9)]


def probability(text: Column, weights: list[float]) -> Column:
    """Probability of "block" for a host-and-path text."""
    table = F.split(F.lit(",".join(map(repr, weights[:BUCKETS]))), ",").cast("array<double>")  # folded to one literal
    grams = buckets(text)
    # counts scaled to length 1: the sum of squared counts comes from the sorted list's runs
    runs = F.aggregate(
        F.array_sort(grams),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot")),
        lambda s, b: F.struct(
            b.alias("last"),
            F.when(b == s["last"], s["run"] + 1).otherwise(1.0).alias("run"),
            # (r + 1)^2 - r^2 = 2 r + 1
            (s["sq"] + F.when(b == s["last"], 2 * s["run"] + 1).otherwise(1.0)).alias("sq"),
            (s["dot"] + F.element_at(table, b + 1)).alias("dot"),
        ),
        lambda s: F.when(s["sq"] > 0, s["dot"] / F.sqrt(s["sq"])).otherwise(0.0),
    )
    return 1 / (1 + F.exp(-(runs + F.lit(weights[BUCKETS]))))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host/path`` text) and its verdict; null if none does."""
    name = verdict = None
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, rule_verdict) if verdict is None else verdict.when(fits, rule_verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def judge_urls(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) of every row; the model is asked only where no rule fits."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    p = F.when(F.col("rule").isNull(), probability(F.concat("host", "path"), weights))
    rows = rows.withColumn("block_probability", p)
    verdict = F.coalesce("by_rule", F.when(F.col("block_probability") >= threshold, "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_probability")
