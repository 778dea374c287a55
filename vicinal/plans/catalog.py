"""The catalogue: one query per operator over the driver's tables, with its DuckDB twin where SQL has one.

Every query reads its whole tables. Objects are built from the tables: vectors from ``embeddings``, word
objects from ``documents``, weighted parts from ``lineitem``, record logs from ``customer`` and ``events``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..domain import DOMAINS, Domain
from ..functions import features, text
from ..functions.similarity import SIMILARITIES, weighted_l1
from ..operators import store
from ..operators.indexes import Inverted, KGraph, Linear, Lsh, counted_hits, word_counts
from ..operators.matchers import Counting, Earthmover, Trivial
from ..shipping import ship
from ..sources import codec, formats
from ..storage import materialize, shared_folder
from ..streaming.ingest import cumulative, interval_rates, stress_totals
from .search import final_topk, search, with_limits

DIM = 64
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def entries(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("object"), F.lit(0).alias("dtag"), F.col("embedding").alias("feature"))


def asked(spark, sf, **limits) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), F.lit(0).alias("qtag"), F.col("embedding").alias("feature"), *((v if not isinstance(v, (int, float)) else F.lit(v)).alias(k) for k, v in limits.items()))


def sketches(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", features.sign_words(F.col("embedding")).alias("words"))


def score6(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 6)


def hits(found: DataFrame, name: str = "score") -> DataFrame:
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "object", score6(name).alias("score"))


# distances and top K

_D = {
    "l2": "cast(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1]-z[2] as double)*cast(z[1]-z[2] as double)))) as float)",
    "l1": "cast(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(abs(z[1]-z[2]) as double))) as float)",
}
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: cast(z[1] as double)*cast(z[2] as double)))"
_COS = f"{_DOT.format('a.embedding', 'b.embedding')} / nullif(sqrt({_DOT.format('a.embedding', 'a.embedding')})*sqrt({_DOT.format('b.embedding', 'b.embedding')}), 0)"
_NORMAL = "({0} is not null and not isnan({0}) and abs({0}) >= 1.17549435e-38 and abs({0}) <= 3.4028235e38)"
_D["cosine"] = f"cast((case when {_NORMAL.format('(' + _COS + ')')} then ({_COS}) else -1 end) as float)"
_WORD = "cast(list_sum(list_transform(embedding[{0}:{1}], lambda x, i: case when x > 0 then cast(1 as bigint) << cast(i-1 as int) else 0 end)) as bigint)"
_SKETCH = f"s as (select vec_id, {_WORD.format(1, 32)} as w0, {_WORD.format(33, 64)} as w1 from embeddings)"


def _topk_sql(d: str, k: int, order: str = "d", where: str = "") -> str:
    return f"""with p as (select a.vec_id as qid, b.vec_id as object, {d} as d from embeddings a, embeddings b),
    r as (select *, row_number() over (partition by qid order by {order}, object) as rank from p {where})
    select qid, rank, object, round(cast(d as double), 6) as score from r where rank <= {k}"""


def _topk(name: str, k: int):
    measure = SIMILARITIES[name]

    def run(spark, sf):
        return hits(search(asked(spark, sf, K=k, hint_K=k), entries(spark, sf), measure, Trivial(measure.polarity), Linear(DIM)))

    return run


query("l2_topk", _topk_sql(_D["l2"], 5))(_topk("l2", 5))
query("l1_topk", _topk_sql(_D["l1"], 5))(_topk("l1", 5))
query("cosine_topk", _topk_sql(_D["cosine"], 5, "d desc"))(_topk("cosine", 5))


def _sketch_topk(name: str, k: int = 5):
    measure = SIMILARITIES[name]

    def run(spark, sf):
        s = sketches(spark, sf)
        q = s.select(F.col("vec_id").alias("qid"), F.lit(0).alias("qtag"), F.col("words").alias("feature"), F.lit(k).alias("K"), F.lit(k).alias("hint_K"))
        e = s.select(F.col("vec_id").alias("object"), F.lit(0).alias("dtag"), F.col("words").alias("feature"))
        return hits(search(q, e, measure, Trivial(measure.polarity), Linear(2)))

    return run


def _sketch_sql(d: str, k: int = 5) -> str:
    return f"""with {_SKETCH}, p as (select a.vec_id as qid, b.vec_id as object, {d} as d from s a, s b),
    r as (select *, row_number() over (partition by qid order by d, object) as rank from p)
    select qid, rank, object, round(cast(d as double), 6) as score from r where rank <= {k}"""


query("hamming_topk", _sketch_sql("bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1))"))(_sketch_topk("hamming"))
query("type_hamming_topk", _sketch_sql("cast(a.w0 <> b.w0 as int) + cast(a.w1 <> b.w1 as int)"))(_sketch_topk("type_hamming"))


@query("range_search", _topk_sql(_D["l2"], 1000000, where="where d <= 1.1"))
def range_search(spark, sf):
    return hits(search(asked(spark, sf, K=1000000, hint_K=1000000, R=1.1), entries(spark, sf), SIMILARITIES["l2"], Trivial(-1), Linear(DIM)))


_K_OF = "case vec_id % 4 when 0 then -1 when 1 then 0 when 2 then 3 else 100000 end"
_R_OF = "case vec_id % 3 when 0 then 0.0 when 1 then cast('nan' as double) else 0.9 end"


@query(
    "default_resolution",
    f"""with q as (select vec_id, embedding, case when ({_K_OF}) > 0 then ({_K_OF}) else 1 end as k, case when vec_id % 3 = 2 then 0.9 else 3.4e38 end as r from embeddings),
    p as (select a.vec_id as qid, b.vec_id as object, a.k, a.r, {_D["l2"]} as d from q a, embeddings b),
    f as (select *, row_number() over (partition by qid order by d, object) as rank from p where d <= r)
    select qid, rank, object, round(cast(d as double), 6) as score from f where rank <= k""",
)
def default_resolution(spark, sf):
    k = F.expr("case vec_id % 4 when 0 then -1 when 1 then 0 when 2 then 3 else 100000 end")
    r = F.expr("case vec_id % 3 when 0 then 0.0D when 1 then double('NaN') else 0.9D end")
    return hits(search(asked(spark, sf, K=k, R=r, hint_K=1000000), entries(spark, sf), SIMILARITIES["l2"], Trivial(-1), Linear(DIM)))


@query("hint_filter", f"""with p as (select a.vec_id as qid, b.vec_id as object, {_D["l2"]} as d from embeddings a, embeddings b),
    r as (select *, row_number() over (partition by qid order by d, object) as rank from p where d <= 1.2)
    select qid, object, rank, round(cast(d as double), 6) as distance from r where rank <= 7""")
def hint_filter(spark, sf):
    measure = SIMILARITIES["l2"]
    found = Linear(DIM).search(with_limits(asked(spark, sf, hint_K=7, hint_R=1.2), -1, -1), entries(spark, sf), measure)
    return found.select("qid", "object", F.col("rank").cast("long").alias("rank"), score6("distance").alias("distance"))


_WEIGHTS = [round(0.25 + (7 * i) % 13 / 4, 2) for i in range(DIM)]


@query("weighted_l1", f"select vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding), {_WEIGHTS}), lambda z: cast(abs(z[1] - z[2]) as double) * z[3])), 3) as d from embeddings")
def weighted_l1_query(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(weighted_l1(v, F.reverse(v), ",".join(map(str, _WEIGHTS))).cast("double"), 3).alias("d"))


# objects with several features


def _multi(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("object"), F.floor(F.col("vec_id") / 50).cast("int").alias("dtag"), F.col("embedding").alias("feature"))


def _multi_search(spark, sf, matcher):
    e = _multi(spark, sf)
    q = e.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), "feature", F.lit(1000).alias("K"), F.lit(7).alias("hint_K"), F.lit(1.2).alias("hint_R"))
    return hits(search(q, e, SIMILARITIES["l2"], matcher, Linear(DIM)))


_MULTI = f"""with m as (select vec_id % 50 as object, vec_id // 50 as tag, embedding from embeddings),
    p as (select a.object as qid, a.tag as qtag, b.object, b.tag as dtag, {_D["l2"]} as d from m a, m b),
    h as (select * from (select *, row_number() over (partition by qid, qtag order by d, object, dtag) as rn from p where d <= 1.2) where rn <= 7)"""
query("multipart_trivial", f"""{_MULTI}, c as (select qid, object, arg_min(d, qtag*1000+rn) as score from h group by qid, object)
    select qid, row_number() over (partition by qid order by score, object) as rank, object, round(cast(score as double), 6) as score from c qualify rank <= 1000""")(lambda spark, sf: _multi_search(spark, sf, Trivial(-1)))
query("multipart_counting", f"""{_MULTI}, c as (select qid, object, count(*) as score from h group by qid, object)
    select qid, row_number() over (partition by qid order by score desc, object) as rank, object, cast(score as double) as score from c qualify rank <= 1000""")(lambda spark, sf: _multi_search(spark, sf, Counting()))
query("candidate_group", f"{_MULTI} select qid, object, count(*) as n_hints, min(qtag) as first_qtag, round(cast(min(d) as double), 6) as nearest from h group by qid, object")(
    lambda spark, sf: _candidate_group(spark, sf)
)


def _candidate_group(spark, sf):
    from ..operators.matchers import candidates

    e = _multi(spark, sf)
    q = with_limits(e.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), "feature", F.lit(7).alias("hint_K"), F.lit(1.2).alias("hint_R")), -1, -1)
    c = candidates(Linear(DIM).search(q, e, SIMILARITIES["l2"]))
    return c.select("qid", "object", F.size("hints").cast("long").alias("n_hints"), F.get("hints", F.lit(0))["qtag"].cast("long").alias("first_qtag"), F.round(F.array_min(F.transform("hints", lambda h: h["value"])), 6).alias("nearest"))


# words


def words(spark, sf, name: str, key: str) -> DataFrame:
    t = table(spark, sf, name)
    tokens = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return t.select(F.col(key).alias("object"), F.posexplode(tokens).alias("dtag", "feature"))


_TOKENS = "select {1} as object, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) as value from {0}"


@query(
    "inverted_search",
    f"""with d as ({_TOKENS.format("documents", "doc_id")}), q as ({_TOKENS.format("benchmark", "item_id")}),
    dc as (select object, value, count(*) as n from d group by all), qc as (select object as qid, value, count(*) as n from q group by all),
    s as (select qid, object, sum(dc.n * qc.n) as score from dc join qc using (value) group by qid, object)
    select qid, row_number() over (partition by qid order by score desc, object) as rank, object, cast(score as double) as score from s qualify rank <= 10""",
)
def inverted_search(spark, sf):
    found = counted_hits(word_counts(table(spark, sf, "documents"), "doc_id", "text"), word_counts(table(spark, sf, "benchmark"), "item_id", "text"), 10)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "object", "score")


@query("posting_df", f"with d as ({_TOKENS.format('documents', 'doc_id')}) select value, count(*) as df from d group by value")
def posting_df(spark, sf):
    return Inverted.total(word_counts(table(spark, sf, "documents"), "doc_id", "text"))


@query("inverted_hints", f"""with b as ({_TOKENS.format('benchmark', 'item_id')}), f as (select value, count(*) as df from b group by value)
    select a.object as qid, b.object, count(*) as n, sum(f.df)::double as distances from b a join b on a.value = b.value join f on f.value = a.value group by all""")
def inverted_hints(spark, sf):
    w = words(spark, sf, "benchmark", "item_id")
    q = w.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), "feature")
    return Inverted().search(q, w).groupBy("qid", "object").agg(F.count("*").alias("n"), F.sum("distance").alias("distances"))


@query("word_distance", "select conv_id, turn, cast(role <> 'user' as double) as d from conversations")
def word_distance(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", SIMILARITIES["word"].apply(F.col("role"), F.lit("user")).cast("double").alias("d"))


# earth mover's distance


def _order_parts(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("w"))


@query(
    "emd_1d",
    """with p as (select l_orderkey as k, l_quantity as x, l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey) as w from lineitem),
    n as (select k, lead(k) over (order by k) as k2 from (select distinct k from p)),
    u as (select n.k, x, w from n join p on p.k = n.k where k2 is not null union all select n.k, x, -w from n join p on p.k = n.k2),
    g as (select k, x, sum(w) as w from u group by k, x),
    c as (select k, abs(sum(w) over (partition by k order by x)) * (lead(x) over (partition by k order by x) - x) as part from g)
    select k as l_orderkey, round(sum(part), 4) + 0.0 as emd from c group by k""",
)
def emd_1d(spark, sf):
    """Distance of each order's quantities (weighted by price) to the next order's, in closed form along one dimension."""
    p = _order_parts(spark, sf).select(F.col("l_orderkey").alias("k"), "x", (F.col("w") / F.sum("w").over(W.partitionBy("l_orderkey"))).alias("w"))
    keys = neighbours_in_order(materialize(p.select("k").distinct(), "keys"), "k")
    # an order's parts count for it if there is a next one, and against the one before
    sides = F.filter(F.array(F.struct(F.when(F.col("after").isNotNull(), F.col("k")).alias("k"), F.col("w").alias("w")), F.struct(F.col("before").alias("k"), (-F.col("w")).alias("w"))), lambda s: s["k"].isNotNull())
    u = p.join(keys, "k").select("x", F.explode(sides).alias("s")).select(F.col("s.k").alias("k"), "x", F.col("s.w").alias("w"))
    g = u.repartition("k").groupBy("k", "x").agg(F.sum("w").alias("w"))
    o = W.partitionBy("k").orderBy("x")
    c = g.select("k", (F.abs(F.sum("w").over(o)) * (F.lead("x").over(o) - F.col("x"))).alias("part"))
    return c.groupBy(F.col("k").alias("l_orderkey")).agg((F.round(F.sum("part"), 4) + F.lit(0.0)).alias("emd"))


def neighbours_in_order(keys: DataFrame, key: str, span: int = 1 << 14) -> DataFrame:
    """(key, before, after) of distinct whole numbers.

    Keys are ordered inside ranges; a range's least and greatest key stand for it one level up, until one range is
    left. No task orders more than ``span`` keys or ranges.
    """
    rows = keys.select(F.col(key).alias("least"), F.col(key).alias("most"), F.floor(F.col(key) / span).alias("r"))
    top = keys.agg(F.max(F.abs(key))).first()[0] or 0
    levels = [rows]
    while top >= span:
        top //= span
        up = levels[-1].groupBy(F.col("r")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        levels.append(up.select("least", "most", F.col("r").alias("own"), F.floor(F.col("r") / span).alias("r")))
    found = None
    for rows in reversed(levels):
        o = W.partitionBy("r").orderBy("least")
        rows = rows.withColumn("after", F.lead("least").over(o)).withColumn("before", F.lag("most").over(o))
        if found is not None:  # at a range's ends, its neighbours' keys
            outer = found.select(F.col("own").alias("r"), F.col("before").alias("b"), F.col("after").alias("a"))
            rows = rows.join(outer, "r").withColumn("after", F.coalesce("after", "a")).withColumn("before", F.coalesce("before", "b")).drop("a", "b")
        found = rows
    return found.select(F.col("least").alias(key), "before", "after")


@query(
    "emd_match",
    """with s as (select s_nationkey as object, s_suppkey as tag, s_acctbal / 1000.0 as x from supplier),
    p as (select a.object as qid, a.tag as qtag, b.object, b.tag, cast(abs(a.x - b.x) as float) as d from s a, s b),
    c as (select distinct qid, object from (select *, row_number() over (partition by qid, qtag order by d, object, tag) as rn from p) where rn <= 3),
    n as (select object, count(*) as n from s group by object),
    u as (select c.qid, c.object, s.x, 1.0::double / n.n as w from c join s on s.object = c.qid join n on n.object = c.qid
          union all select c.qid, c.object, s.x, -1.0::double / n.n from c join s on s.object = c.object join n on n.object = c.object),
    g as (select qid, object, x, sum(w) as w from u group by all),
    t as (select qid, object, abs(sum(w) over (partition by qid, object order by x)) * (lead(x) over (partition by qid, object order by x) - x) as part from g),
    e as (select qid, object, coalesce(sum(part), 0) as score from t group by all)
    select qid, row_number() over (partition by qid order by round(score, 3), object) as rank, object, round(score, 3) + 0.0 as score from e qualify rank <= 5""",
)
def emd_match(spark, sf):
    """Weighted multi-part objects (suppliers' parts by nation) under the earth mover's distance; in one dimension it has a closed form."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("object"), F.col("s_suppkey").cast("int").alias("dtag"), F.array(F.col("s_acctbal") / 1000.0).alias("feature"), F.lit(1.0).alias("weight"))
    q = s.select(F.col("object").alias("qid"), F.col("dtag").alias("qtag"), "feature", F.lit(1 << 20).alias("K"), F.lit(3).alias("hint_K"))
    parts = s.select("object", F.col("dtag").alias("tag"), "feature", "weight")
    matcher = Earthmover(parts.withColumnRenamed("object", "qid"), parts)
    found = search(q, s.drop("weight"), SIMILARITIES["l2"], matcher, Linear(1))
    # masses and costs are rounded to millionths, so the last digits are left out, and ties after that go by object
    found = found.withColumn("score", F.round(F.col("score").cast("double"), 3) + F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("score", "object"))
    return found.select("qid", rank.cast("long").alias("rank"), "object", "score").where("rank <= 5")


# indexes

_COSINE, _L2 = Lsh(DIM, tables=12, bits=5), Lsh(DIM, tables=12, bits=4, width=1.5)


def _lsh_sql(index: Lsh, name: str) -> str:
    """(vec_id, t, code): a vector's code in each table, as text."""
    part = (lambda p: f"case when {_DOT.format('embedding', str(p[0]) + '::double[]')} > 0 then 1 else 0 end") if name == "cosine" else (lambda p: f"cast(floor(({_DOT.format('embedding', str(p[0]) + '::double[]')} + {p[1]}) / {index.width}) as int)")
    codes = ", ".join("concat_ws(' ', " + ", ".join(map(part, t)) + ")" for t in index.planes(SIMILARITIES[name]))
    return f"select vec_id, unnest(range({index.tables})) as t, unnest([{codes}]) as code from embeddings"


def _lsh_topk_sql(index: Lsh, name: str, k: int = 5) -> str:
    return f"""with c as ({_lsh_sql(index, name)}), m as (select distinct x.vec_id as qid, y.vec_id as object from c x join c y on x.t = y.t and x.code = y.code),
    p as (select qid, object, {_D[name]} as d from m join embeddings a on a.vec_id = qid join embeddings b on b.vec_id = object),
    r as (select *, row_number() over (partition by qid order by d {"desc" if name == "cosine" else ""}, object) as rank from p)
    select qid, rank, object, round(cast(d as double), 6) as score from r where rank <= {k}"""


@query("lsh_codes", _lsh_sql(_L2, "l2"))
def lsh_codes(spark, sf):
    parts = table(spark, sf, "embeddings").select("vec_id", F.posexplode(_L2.signature(F.col("embedding"), SIMILARITIES["l2"])).alias("t", "parts"))
    return parts.select("vec_id", F.col("t").cast("long").alias("t"), F.array_join("parts", " ").alias("code"))


@query("lsh_topk", _lsh_topk_sql(_COSINE, "cosine"))
def lsh_topk(spark, sf):
    return hits(search(asked(spark, sf, K=5, hint_K=5), entries(spark, sf), SIMILARITIES["cosine"], Trivial(1), _COSINE))


@query("lsh_l2_topk", _lsh_topk_sql(_L2, "l2"))
def lsh_l2_topk(spark, sf):
    return hits(search(asked(spark, sf, K=5, hint_K=5), entries(spark, sf), SIMILARITIES["l2"], Trivial(-1), _L2))


@query(
    "knn_graph_exact",
    f"""with p as (select a.vec_id as src, b.vec_id as dst, {_D["l2"]} as d from embeddings a, embeddings b where a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by src order by d, dst) - 1 as pos from p)
    select src, pos, dst, round(cast(d as double), 6) as dist from r where pos < 10""",
)
def knn_graph_exact(spark, sf):
    g = KGraph(DIM, K=10).exact_graph(entries(spark, sf), SIMILARITIES["l2"])
    return g.select("src", F.col("pos").cast("long").alias("pos"), "dst", score6("dist").alias("dist"))


@query("delta_merge", _topk_sql(_D["l2"], 5))
def delta_merge(spark, sf):
    """Four fifths of the entries are in a graph and searched by it, the others are scanned, and both are merged."""
    measure, g = SIMILARITIES["l2"], KGraph(DIM, K=20, P=100)
    e = entries(spark, sf).withColumn("indexed", F.col("object") % 5 != 0)
    graph = materialize(g.exact_graph(e.where("indexed").drop("indexed"), measure), "graph")
    q = with_limits(asked(spark, sf, K=5, hint_K=5), -1, -1)
    return hits(final_topk(Trivial(-1).score(g.search(q, e, measure, graph)), -1))


@query("kgraph_nndescent")
def kgraph_nndescent(spark, sf):
    return KGraph(DIM, K=10, L=20, S=8, iterations=4).descent(entries(spark, sf), SIMILARITIES["l2"])


@query("kgraph_recall", "select count(*) as entries, 10 * count(*) as edges, true as recalled from embeddings")
def kgraph_recall(spark, sf):
    """Does the approximate graph hold 99 in 100 of the exact graph's edges?"""
    measure, e = SIMILARITIES["l2"], entries(spark, sf)
    found = materialize(KGraph(DIM, K=10, L=60, S=30, iterations=10).descent(e, measure).select("src", "dst"), "graph")
    exact = KGraph(DIM, K=10).exact_graph(e, measure).select("src", "dst", F.lit(1).alias("hit"))
    both = found.join(exact, ["src", "dst"], "left")
    return both.agg(F.count_distinct("src").alias("entries"), F.count("*").alias("edges"), (F.count("hit") >= 0.99 * F.count("*")).alias("recalled"))


@query("kgraph_search", _topk_sql(_D["l2"], 5))
def kgraph_search(spark, sf):
    """Search over an approximate graph; with this graph and pool it finds all of the nearest at the test size."""
    measure, g = SIMILARITIES["l2"], KGraph(DIM, K=20, L=40, S=10, P=100)
    e = entries(spark, sf)
    graph = materialize(g.descent(e, measure), "graph")
    q = with_limits(asked(spark, sf, K=5, hint_K=5), -1, -1)
    return hits(final_topk(Trivial(-1).score(g.search_graph(q, e, graph, measure)), -1))


# records


def records(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select((F.col("c_nationkey") % 4).cast("int").alias("db"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("key"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("meta"))


_RECORDS = "r as (select cast(c_nationkey % 4 as int) as db, c_custkey as seq, c_name as key, '{\"segment\":\"' || c_mktsegment || '\"}' as meta from customer)"

query("fetch_keys", f"""with {_RECORDS}, k as (select o_orderkey as pos, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') as key from orders)
    select pos, key, meta from k join r using (key)""")(
    lambda spark, sf: store.fetch(records(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("key")))
)
query("stat_size", f"with {_RECORDS} select db, count(*) as size from r group by db")(lambda spark, sf: store.stat_size(records(spark, sf)))
query("stat_last", f"""with {_RECORDS}, l as (select *, row_number() over (partition by db order by seq desc) as back from r)
    select db, row_number() over (partition by db order by seq) - 1 as pos, key from l where back <= 500""")(lambda spark, sf: store.stat_last(records(spark, sf)).withColumn("pos", F.col("pos").cast("long")))


@query("journal_stat", "select cast(conv_id % 4 as bigint) as db, count(distinct conv_id) as objects, count(*) as features, round(count(*) / count(distinct conv_id), 6) as per_object from conversations group by 1")
def journal_stat(spark, sf):
    o = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("parts")).withColumn("db", F.col("conv_id") % 4)
    return store.journal_stat(o).withColumn("per_object", F.round("per_object", 6))


@query(
    "insert_conflict",
    """with i as (select cast(event_id % 2 as int) as db, event_id as seq, 'user' || user_id as key from events where event_type <> 'view'),
    e as (select distinct cast(event_id % 2 as int) as db, 'user' || user_id as key from events where event_type = 'view' and value > 80),
    f as (select *, row_number() over (partition by db, key order by seq) as n from i)
    select f.db, f.seq, f.key, (f.n = 1 and e.key is null) as accepted from f left join e on f.db = e.db and f.key = e.key""",
)
def insert_conflict(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", (F.col("event_id") % 2).cast("int").alias("db"), F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id")).alias("key"))
    new, again = store.split_insert(e.where("event_type <> 'view'").select("db", "seq", "key"), e.where("event_type = 'view' and value > 80").select("db", "key"))
    return new.withColumn("accepted", F.lit(True)).unionByName(again.withColumn("accepted", F.lit(False)))


@query("clear_db", f"with {_RECORDS} select db, count(*) as size from r where db <> 1 group by db")
def clear_db(spark, sf):
    """Four databases are written and one of them is cleared."""
    s = store.Store(spark, f"{shared_folder(spark)}/vicinal-store-{uuid.uuid4().hex}", "key string, meta string")
    s.insert(records(spark, sf))
    s.clear(1)
    return store.stat_size(s.records())


query("db_lookup", "select n_nationkey, n_name, cast(r_regionkey as int) as dbid from nation left join region on n_regionkey = r_regionkey")(
    lambda spark, sf: store.database_of(
        table(spark, sf, "nation").withColumn("db", F.col("n_regionkey")), table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("dbid"), F.col("r_regionkey").cast("int").alias("outer_id"))
    ).select("n_nationkey", "n_name", "dbid")
)
@query(
    "record_attach",
    f"""with {_RECORDS}, m as (select c_nationkey as qid, c_custkey as object, c_acctbal as s from customer where c_acctbal >= 100),
    t as (select qid, object, key, meta, s, row_number() over (partition by qid order by s desc, key) as rank from m join r on m.object = r.seq)
    select qid, rank, key, meta, round(s, 2) as score from t where rank <= 20""",
)
def record_attach(spark, sf):
    """Keys join before the cut (for ties), metas after it."""
    scored = table(spark, sf, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("object"), F.col("c_acctbal").alias("score"), F.lit(20).alias("K"), F.lit(100.0).alias("R"))
    found = final_topk(scored, 1, records(spark, sf).withColumnRenamed("seq", "object"))
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "key", "meta", F.round("score", 2).alias("score"))


# formats


@query("search_batch", _topk_sql(_D["l2"], 3))
def search_batch(spark, sf):
    return _topk("l2", 3)(spark, sf)


query("paginate", "with r as (select o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) select o_orderkey, rank from r where rank between 4 and 6")(
    lambda spark, sf: formats.paginate(table(spark, sf, "orders").withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")), 1, 3)[0].select("o_orderkey", "rank")
)
query("format_hit", "select c_custkey, c_name || chr(9) || '%' || c_mktsegment || ' \\' || cast(c_nationkey as varchar) as line from customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("key"), F.col("c_mktsegment").alias("meta"), F.col("c_nationkey").alias("score")).select("c_custkey", formats.format_hit("%k\\t%%%m \\\\%s").alias("line"))
)
_LINE = "case page_id % 4 when 0 then cast(page_id as varchar) || chr(9) || url when 1 then cast(page_id as varchar) || chr(9) || url || chr(9) || 'm' when 2 then url else cast(page_id as varchar) || chr(9) end"
query("task_parse", f"""with l as (select {_LINE} as line from pages), p as (select line, string_split(line, chr(9)) as s from l)
    select line, s[1] as key, s[2] as url, coalesce(s[3], '') as meta, (contains(line, chr(9)) and strpos(line, chr(9)) < length(line)) as valid from p""")(
    lambda spark, sf: formats.tasks(table(spark, sf, "pages").select(F.expr("case page_id % 4 when 0 then page_id || '\t' || url when 1 then page_id || '\t' || url || '\tm' when 2 then url else page_id || '\t' end").alias("value")))
)
query("query_list", "select cast(page_id as varchar) as expect_key, url from pages")(lambda spark, sf: formats.query_list(table(spark, sf, "pages").select(F.concat(F.lit("  "), F.col("page_id"), F.lit("   "), F.col("url")).alias("value"))))
query("backends_parse", "select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as address, '' as tag from pages")(
    lambda spark, sf: formats.backends(table(spark, sf, "pages").select(F.concat(F.lit(" "), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(" # from "), F.col("url")).alias("value")))
)
query("is_url", "select page_id, regexp_matches(url, '^(http|https|ftp)://') as url_ok, regexp_matches(substr(url, 2), '^(http|https|ftp)://') as cut_ok from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", text.is_url(F.col("url")).alias("url_ok"), text.is_url(F.expr("substring(url, 2)")).alias("cut_ok"))
)
query("query_dict", "select page_id, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, coalesce(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as source from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", text.query_dict(F.col("url")).alias("q")).select("page_id", F.coalesce(F.col("q")["page"], F.lit("")).alias("page"), F.coalesce(F.col("q")["utm_source"], F.lit("")).alias("source"))
)
query("host_port", "select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, cast(case when page_id % 2 = 0 then page_id else -1 end as int) as port from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", text.host_port(F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(":"), F.col("page_id"))).otherwise(""))).alias("a")).select("page_id", "a.host", "a.port")
)
query("key_value", "select event_id, case when event_id % 3 = 0 then event_type end as k, case when event_id % 3 = 0 then cast(user_id as varchar) end as v from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", text.key_value(F.expr("case event_id % 3 when 0 then event_type || '=' || user_id when 1 then event_type || '=' else event_type end")).alias("p")).select("event_id", F.col("p.key").alias("k"), F.col("p.value").alias("v"))
)
query("percent_codec", "select page_id, url_encode(url) as encoded, url as back from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", text.percent_encode(F.col("url")).alias("encoded"), text.percent_decode(text.percent_encode(F.col("url"))).alias("back"))
)
query("base64_content", "select item_id, base64(encode(text)) as content, text as back from benchmark")(
    lambda spark, sf: table(spark, sf, "benchmark").select("item_id", text.base64_encode(F.col("text").cast("binary")).alias("content"), F.unbase64(F.base64(F.col("text").cast("binary"))).cast("string").alias("back"))
)
query("hex_dump", "select vec_id, reverse(lower(lpad(to_hex(cast(vec_id * 1000003 as bigint)), 16, '0'))) as dump from embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", text.hex_dump((F.col("vec_id") * 1000003).cast("long")).alias("dump"))
)
query("json_request", "select event_id, cast(json_extract_string(props, '$.k') as int) as k_resolved, 0 as db, true as raw from events where cast(json_extract_string(props, '$.k') as int) > 0 union all select event_id, -1, 0, true from events where coalesce(cast(json_extract_string(props, '$.k') as int), 0) <= 0")(
    lambda spark, sf: formats.search_requests(table(spark, sf, "events").select("event_id", F.replace("props", F.lit('"k"'), F.lit('"K"')).alias("body"))).select("event_id", F.when(F.col("K") > 0, F.col("K")).otherwise(-1).alias("k_resolved"), "db", "raw")
)
@query("scan_url", "with c as (select url, min(html) as html from pages group by url) select page_id, length(c.html) as n_chars, md5(c.html) as content from pages join c using (url)")
def scan_url(spark, sf):
    """Contents of URLs, resolved against a table of pages."""
    pages = table(spark, sf, "pages")
    found = codec.resolve_urls(pages.select("page_id", "url"), pages.select("url", "html"), "url", "html")
    return found.select("page_id", F.length("html").cast("long").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("content"))


@query("server_list", "select distinct regexp_extract(url, '://([^/?#]*)', 1) as address from pages")
def server_list(spark, sf):
    """Addresses, several on a line."""
    lines = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("a")).groupBy(F.pmod(F.xxhash64("a"), F.lit(7))).agg(F.concat(F.lit(" "), F.array_join(F.collect_set("a"), "\t "), F.lit("  ")).alias("value"))
    return formats.server_list(lines)


@query("rand_text", "select vec_id, array_to_string(list_transform(range(32), lambda i: (vec_id * 2654435761 + i * 40503) % 4294967296), ' ') as v, vec_id % 3 <> 0 as ok from embeddings")
def rand_text(spark, sf):
    """Words of 32 bits from text; a text of too few has none."""
    e = table(spark, sf, "embeddings")
    whole = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pmod(F.col("vec_id") * F.lit(2654435761) + i * 40503, F.lit(1 << 32)))
    text_of = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), " \n")
    short = F.when(F.col("vec_id") % 3 == 0, F.slice(whole, 1, 31)).otherwise(whole)
    return e.select("vec_id", F.array_join(features.word_vector(text_of(whole)), " ").alias("v"), features.word_vector(text_of(short)).isNotNull().alias("ok"))


query("query_encode", "select event_id, 'type=' || url_encode(event_type || ' & ~' || user_id) || '&v=' || event_id as q from events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", text.query_encode(F.create_map(F.lit("type"), F.concat("event_type", F.lit(" & ~"), "user_id"), F.lit("v"), F.col("event_id").cast("string"))).alias("q"))
)
query("json_thumb", "select c_custkey, '/img/' || c_name || '.jpg' as thumb from customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", text.thumb_meta(F.to_json(F.struct(F.concat("c_name", F.lit(".jpg")).alias("thumb"), "c_acctbal")), "/img/").alias("thumb"))
)


@query("idmap_roundtrip", "select cast(row_number() over (order by n_nationkey) - 1 as int) as dbid, cast(n_nationkey * 10 as int) as outer_id from nation")
def idmap_roundtrip(spark, sf):
    path = f"{shared_folder(spark)}/vicinal-idmap-{uuid.uuid4().hex}"
    nations = table(spark, sf, "nation").select((F.row_number().over(W.orderBy("n_nationkey")) - 1).alias("dbid"), (F.col("n_nationkey") * 10).cast("int").alias("outer_id"))  # at most 256 rows
    formats.save_idmap(nations, path)
    return formats.idmap(spark, path)


@query("journal_scan", f"with {_RECORDS} select db, row_number() over (partition by db order by seq) - 1 as seq, key, meta, (seq % 7) || ' ' || (seq % 11) as feature from r where seq % 100 <> 99")
def journal_scan(spark, sf):
    """Records written as journals (one a database) and read back; a broken tail after them is left out."""
    import pandas as pd

    d = Domain("pairs", "single", 2, "float", "l2", "trivial")
    rows = records(spark, sf).where("seq % 100 <> 99").withColumn("feature", F.array((F.col("seq") % 7).cast("float"), (F.col("seq") % 11).cast("float")))

    def write(key, pdf):
        body = b"".join(codec.journal_record(k, m, codec.encode_parts(d, [{"feature": f}])) for k, m, f in zip(*(pdf.sort_values("seq")[c] for c in ("key", "meta", "feature"))))
        return pd.DataFrame({"path": [str(key[0])], "content": [body + codec.journal_record("broken", "", b"")]})

    files = rows.groupBy("db").applyInPandas(write, "path string, content binary")
    found = codec.scan_journals(files, d)
    return found.select(F.col("path").cast("int").alias("db"), "seq", "key", "meta", F.array_join(F.transform(F.get("parts", F.lit(0))["feature"], lambda x: x.cast("long")), " ").alias("feature"))


# feature extraction


def _pixels(spark, sf):
    """Pixel table: an image per supplier; channels from numeric columns scaled to 0..255, place from the other two."""
    li = table(spark, sf, "lineitem")
    return li.select("l_suppkey", F.col("l_linenumber").alias("region"), (F.col("l_quantity") * 5).alias("b"), (F.col("l_discount") * 2500).alias("g"), (F.col("l_tax") * 3000).alias("r"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_orderkey") % 89).alias("y"))


_PIXELS = "px as (select l_suppkey, l_linenumber as region, l_quantity * 5 as b, l_discount * 2500 as g, l_tax * 3000 as r, l_partkey % 97 as x, l_orderkey % 89 as y from lineitem)"
query("color_histogram", f"""with {_PIXELS}, l as (select l_suppkey, 0 as channel, b as v from px union all select l_suppkey, 1, g from px union all select l_suppkey, 2, r from px),
    c as (select l_suppkey, channel, cast(floor(v / 16) as int) as bin, count(*) as n from l where v >= 0 and v < 256 group by all)
    select l_suppkey, channel, bin, round(n / sqrt(sum(n * n) over (partition by l_suppkey)), 6) as value from c""")(
    lambda spark, sf: features.color_histogram(_pixels(spark, sf), "l_suppkey", ["b", "g", "r"]).withColumn("value", F.round("value", 6))
)
_M = ", ".join(f"avg({c}/255.0) as {c}1, avg(({c}/255.0)*({c}/255.0)) as {c}2, avg(({c}/255.0)*({c}/255.0)*({c}/255.0)) as {c}3" for c in "bgr")
query("color_moments", f"with {_PIXELS}, m as (select l_suppkey, {_M} from px group by l_suppkey) select l_suppkey, " + ", ".join(f"round({c}1, 5) as {c}_mean, round(sqrt(greatest({c}2 - {c}1*{c}1, 0.0)), 5) as {c}_sigma, round({c}3 - 3*{c}1*{c}2 + 2*{c}1*{c}1*{c}1, 7) + 0.0 as {c}_third" for c in "bgr") + " from m")(
    lambda spark, sf: features.color_moments(_pixels(spark, sf), ["l_suppkey"], ["b", "g", "r"]).select("l_suppkey", *(F.round(f"{c}_{k}", 5).alias(f"{c}_{k}") for c in "bgr" for k in ("mean", "sigma")), *((F.round(F.pow(F.col(f"{c}_skew"), 3), 7) + F.lit(0.0)).alias(f"{c}_third") for c in "bgr"))
)
query("box_feature", f"""with {_PIXELS}, g as (select l_suppkey, region, max(x) - min(x) + 1 as dx, max(y) - min(y) + 1 as dy, count(*) as n, sum(x) as sum_x, sum(y) as sum_y from px group by all)
    select l_suppkey, region, round(ln(dy / dx), 6) as log_aspect, round(n / (dx * dy), 6) as fill, round(ln(dx * dy), 6) as log_area, cast(sum_x as bigint) as sum_x, cast(sum_y as bigint) as sum_y from g""")(
    lambda spark, sf: features.box_features(_pixels(spark, sf), ["l_suppkey", "region"]).select("l_suppkey", "region", *(F.round(c, 6).alias(c) for c in ("log_aspect", "fill", "log_area")), "sum_x", "sum_y")
)
query("region_weight", f"""with {_PIXELS}, n as (select l_suppkey, region, sqrt(count(*)) as w from px group by all)
    select l_suppkey, region, round(w / sum(w) over (partition by l_suppkey), 6) as weight from n""")(lambda spark, sf: features.region_weights(_pixels(spark, sf), "l_suppkey", "region").withColumn("weight", F.round("weight", 6)))
query("grayscale", f"with {_PIXELS} select l_suppkey, round(sum(0.299*r + 0.587*g + 0.114*b), 0) as gray from px group by 1")(lambda spark, sf: _pixels(spark, sf).groupBy("l_suppkey").agg(F.round(F.sum(features.gray(F.col("r"), F.col("g"), F.col("b"))), 0).alias("gray")))
query(
    "entropy",
    """with v as (select vec_id, unnest(embedding) as x from embeddings), c as (select vec_id, floor(cast(x as double) * 255 + 0.5) as bin, count(*) as n from v group by all)
    select vec_id, round(cast(sum(case when bin >= 0 and bin < 256 then -(n / 64.0) * log2(n / 64.0) else 0 end) as double), 4) as e from c group by vec_id""",
)(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.round(features.entropy(F.col("embedding")).cast("double"), 4).alias("e")))
query(
    "binarify",
    """with v as (select vec_id, unnest(embedding) as x, unnest(range(64)) as i from embeddings), r as (select *, row_number() over (partition by vec_id order by x, i) - 1 as rank from v)
    select vec_id, cast(sum(case when rank >= 45 and i < 32 then cast(1 as bigint) << cast(i as int) else 0 end) as bigint) as w0, cast(sum(case when rank >= 45 and i >= 32 then cast(1 as bigint) << cast(i - 32 as int) else 0 end) as bigint) as w1 from r group by vec_id""",
)(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", features.binarify(F.col("embedding"), 45).alias("w")).select("vec_id", F.get("w", F.lit(0)).alias("w0"), F.get("w", F.lit(1)).alias("w1")))
query("dimension_weights", "select vec_id, " + " + ".join(f"round(cast(embedding[{i + 1}] as double) * {w}, 6)" for i, w in enumerate(features.DIMENSION_WEIGHTS)) + " as s from embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.aggregate(features.weighted(F.transform(F.slice("embedding", 1, 14), lambda x: x.cast("double"))), F.lit(0.0), lambda s, x: s + F.round(x, 6)).alias("s"))
)
_UNNEST = "(select vec_id, unnest(range(64)) as i, unnest(embedding) as x from embeddings)"
query("descriptor_scale", f"select vec_id, i, round(cast(least(x * 2, 1) as double), 6) as v from {_UNNEST}")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.posexplode(features.descriptor_scale(F.col("embedding"))).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), score6("v").alias("v"))
)
query("lsa_text", f"select vec_id, i, round(cast(x as double), 6) as v, vec_id % 4 = 0 as short_is_null from {_UNNEST}")(
    lambda spark, sf: table(spark, sf, "embeddings").withColumn("t", F.transform("embedding", lambda x: x.cast("string"))).select("vec_id", features.float_vector(F.array_join("t", "  "), DIM).alias("v"), features.float_vector(F.array_join(F.when(F.col("vec_id") % 4 == 0, F.slice("t", 1, DIM - 1)).otherwise(F.col("t")), "\n"), DIM).isNull().alias("short_is_null")).select("vec_id", F.posexplode("v").alias("i", "v"), "short_is_null").select("vec_id", F.col("i").cast("long").alias("i"), score6("v").alias("v"), "short_is_null")
)
query("enumerate_parts", "select conv_id as object, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as dtag, role as feature from conversations")(
    lambda spark, sf: codec.enumerate_parts(table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("object")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: F.struct(s["role"].alias("feature"))).alias("parts")))
)


@query("codec_roundtrip", f"select vec_id, 256 as n_bytes, i, round(cast(x as double), 6) as v from {_UNNEST}")
def codec_roundtrip(spark, sf):
    d = Domain("vectors", "single", DIM, "float", "l2", "trivial")
    raw = table(spark, sf, "embeddings").select("vec_id", codec.encode(d, F.array(F.struct(F.col("embedding").alias("feature")))).alias("raw"))
    back = raw.select("vec_id", F.length("raw").alias("n_bytes"), F.posexplode(F.get(codec.decode(d, F.col("raw")), F.lit(0))["feature"]).alias("i", "v"))
    return back.select("vec_id", "n_bytes", F.col("i").cast("long").alias("i"), score6("v").alias("v"))


@query("codec_multi", "select l_orderkey, 2 + count(*) * 12 as n_bytes, string_agg(l_linenumber, ' ' order by l_linenumber) as tags, round(sum(l_quantity * l_linenumber), 2) as s from lineitem group by l_orderkey")
def codec_multi(spark, sf):
    """Weighted parts (an order's lines): encoded, and decoded again."""
    d = Domain("orders", "multi", 2, "float", "l2", "emd", weighted=True)
    part = F.struct("l_linenumber", F.col("l_quantity").cast("float").alias("weight"), F.array(F.col("l_linenumber").cast("float"), F.col("l_quantity").cast("float")).alias("feature"))
    objects = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    raw = objects.select("l_orderkey", codec.encode(d, F.transform("parts", lambda p: F.struct(p["weight"].alias("weight"), p["feature"].alias("feature")))).alias("raw"))
    back = raw.select("l_orderkey", F.length("raw").cast("long").alias("n_bytes"), codec.decode(d, F.col("raw")).alias("p"))
    tag = lambda p: F.get(p["feature"], F.lit(0))
    return back.select("l_orderkey", "n_bytes", F.array_join(F.transform("p", lambda p: tag(p).cast("int")), " ").alias("tags"), F.round(F.aggregate("p", F.lit(0.0), lambda s, p: s + p["weight"] * tag(p)), 2).alias("s"))


@query("codec_text", "select conv_id, 4 + count(*) * 8 as n_bytes, string_agg(length(text), ' ' order by turn) as words from conversations group by conv_id")
def codec_text(spark, sf):
    d = Domain("lengths", "text", 1, "int64", "word", "counting")
    objects = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("feature")))).alias("parts"))
    raw = objects.select("conv_id", codec.encode(d, F.transform("parts", lambda p: F.struct(p["feature"].alias("feature")))).alias("raw"))
    return raw.select("conv_id", F.length("raw").cast("long").alias("n_bytes"), F.array_join(F.transform(codec.decode(d, F.col("raw")), lambda p: p["feature"]), " ").alias("words"))


@query("build_info", "select * from (values ('image', 192), ('keypoints', 16), ('regions', 56), ('text', 8), ('text-bits', 128), ('text-lsa', 8000)) t(domain, feature_bytes)")
def build_info(spark, sf):
    return spark.createDataFrame([(d.name, d.feature_bytes) for d in DOMAINS.values()], "domain string, feature_bytes int")


# service metrics

query("stress_totals", "select user_id % 8 as server, count(*) as queries, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors, sum(case when value > 90 then 1 else 0 end)::bigint as misses, round(sum(value), 2) as latency_ms from events group by 1")(
    lambda spark, sf: stress_totals(table(spark, sf, "events"), F.col("user_id") % 8, F.col("event_type") == "error", F.col("value") > 90, "value").withColumn("latency_ms", F.round("latency_ms", 2))
)
query(
    "interval_rates",
    """with i as (select date_trunc('hour', ts) as t, count(*) as queries, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors, sum(case when value > 90 then 1 else 0 end)::bigint as misses, round(avg(value), 4) as mean_ms from events group by 1)
    select strftime(t, '%Y-%m-%d %H:%M:%S') as start, queries, errors, misses, mean_ms, sum(queries) over (order by t)::bigint as total_queries, sum(errors) over (order by t)::bigint as total_errors, sum(misses) over (order by t)::bigint as total_misses from i""",
)(
    lambda spark, sf: cumulative(interval_rates(table(spark, sf, "events"), "ts", "1 hour", F.col("event_type") == "error", "value", miss=F.col("value") > 90), ["queries", "errors", "misses"]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("mean_ms", F.round("mean_ms", 4))
)
query("expected_hit", f"""with p as (select a.vec_id as qid, a.label as la, b.label as lb, row_number() over (partition by a.vec_id order by {_D["l2"]}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id <> b.vec_id)
    select qid, max(case when la = lb then 1 else 0 end) as expected from p where rank <= 5 group by qid""")(lambda spark, sf: _expected(spark, sf))


def _expected(spark, sf):
    """Does any of the five nearest others carry the query's label?"""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id"), "label")
    g = KGraph(DIM, K=5).exact_graph(entries(spark, sf), SIMILARITIES["l2"])
    g = g.join(labels.withColumnRenamed("vec_id", "src").withColumnRenamed("label", "la"), "src").join(labels.withColumnRenamed("vec_id", "dst").withColumnRenamed("label", "lb"), "dst")
    return g.groupBy(F.col("src").alias("qid")).agg(F.max(F.when(F.col("la") == F.col("lb"), 1).otherwise(0)).alias("expected"))


@query("stream_ingest", f"with {_RECORDS} select db, count(*) as size from r group by db")
def stream_ingest(spark, sf):
    """Customers streamed into a store; returns the stored keys by database."""
    from ..streaming.ingest import stream_insert

    root = f"{shared_folder(spark)}/vicinal-stream-{uuid.uuid4().hex}"
    s = store.Store(spark, f"{root}/store", "key string, meta string")
    source = records(spark, sf)
    source.write.parquet(f"{root}/in")
    stream_insert(spark.readStream.schema(source.schema).parquet(f"{root}/in"), s, f"{root}/checkpoint").awaitTermination()
    return store.stat_size(s.records())


@query("sift_keypoints")
def sift_keypoints(spark, sf):
    """Keypoints of 64 x 64 images drawn from the line items (an image for each nation of the suppliers)."""
    from ..functions.sift import extract_keypoints

    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    side = 64
    cell = (F.pmod(F.xxhash64("l_partkey"), F.lit(8)) * 8 + F.col("l_linenumber")).cast("int")
    ink = li.select(F.col("s_nationkey").alias("object"), (F.col("l_orderkey") % side).cast("int").alias("y"), F.pmod(cell, F.lit(side)).alias("x"), "l_quantity")
    dots = ink.groupBy("object", "y", "x").agg(F.sum("l_quantity").alias("v"))
    # an image has side x side pixels, so its dots are few
    image = dots.groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y") * side + F.col("x"), "v"))).alias("m"), F.max("v").alias("top"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) * 255.0 / F.col("top"))
    return extract_keypoints(image.select("object", F.lit(side).alias("width"), F.lit(side).alias("height"), pixels.alias("pixels")))
