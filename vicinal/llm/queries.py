"""The queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_text, langid, packing, sharding, simhash, suffix_dedup, token_counts, url_filter
from .common import materialize, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.stored_index(table(spark, sf_dir, "documents"))
    found = decontaminate.match(index, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",", "")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.predict(docs, langid.learn(docs), keep=["doc_id"])
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = materialize(token_counts.write_streams(table(spark, sf_dir, "documents"), id_col="doc_id"), "tokens")
    return token_counts.count_tokens(streams).withColumnRenamed("name", "doc_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), weights)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html_text": op2_html_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_url_filter": op7_url_filter,
    "op8_ann": op8_ann,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL with the rows of a query, where SQL can say it; tests/llm compares the others with brute force.
ORACLE_SQL: dict[str, str] = {
    # every window of an item, looked up among all windows of the documents
    "op3_decontaminate": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        i as (select item_id, w, least(13, len(w)) as n from b where len(w) > 0),
        q as (select distinct cast(item_id as varchar) as item, n, array_to_string(w[p : p + n - 1], ' ') as s from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as p from i)),
        lengths as (select distinct n from q),
        places as (select r, n, w, unnest(range(1, len(w) - n + 2)) as p from d, lengths where len(w) >= n),
        found as (select x.r, x.p, q.n, q.item from places x join q on q.n = x.n and q.s = array_to_string(x.w[x.p : x.p + x.n - 1], ' ')),
        hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(p, p + n)) as k from found) group by r),
        items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from found group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hits using (r) left join items using (r)""",
    # texts as hexadecimal digits, two for each byte
    "op10_suffix_dedup": """
        with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        w as (select r, doc_id, p, substr(h, 2 * p + 1, 100) as s from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d)),
        first as (select s, min(doc_id) as least from w group by s),
        gone as (select r, p from w join first using (s) where least < doc_id),
        steps as (select r, p, coalesce(p > lag(p) over (partition by r order by p) + 50, true) as new from gone),
        runs as (select r, min(p) as a, max(p) + 50 as b from (select r, p, sum(cast(new as int)) over (partition by r order by p) as k from steps) group by r, k),
        pieces as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as begin from runs),
        cut as (select r, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' order by a) as head, max(b) as last from pieces join d using (r) group by r)
        select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join cut using (r)""",
}
