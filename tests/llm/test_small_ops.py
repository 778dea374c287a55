"""Brute-force and edge-case tests of the row-wise operators."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import langid, packing, sharding, token_counts, url_filter
from vicinal.llm.common import materialize
from vicinal.llm.tokens import encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, text_crc32 string, slot int, size int"
ODD = [None, "", "x", "Hello World", "Hello World", "é ü\u00a0ß 日本", "12 34 !!", "a" * 5000, "<|endoftext|> tail", " \n\t ", "long " * 40000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", "clash", 1, 1) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None, None, None), (3, "Hello World", "en", "s", 0, "c", "c", 1, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(spark, docs, none):
    rows, m = sharding.shard_documents(docs, n_shards=4, n_slots=64)
    got = rows.toPandas()
    assert len(got) == docs.count() and m.version == 2
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows.collect()}
    assert (0, 0, 8) in by and (2, zlib.crc32(b"x"), 9) in by and (5, zlib.crc32(ODD[5].encode()), len(ODD[5].encode()) + 8) in by
    assert sharding.shard_documents(none)[0].count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=400, max_size=400), st.integers(2, 24))
def test_slot_map(sizes, shards):
    size = np.array(sizes)
    m = sharding.SlotMap.initial(len(size), shards).rebalanced(size)
    load = np.bincount(m.shards, size, shards)
    assert load.max() - load.min() <= max(size.max(), 0.02 * load.mean())
    assert [e for e in m.history if e[2] == e[3]] == []
    grown = m.grown(size)
    moved = [(a, b) for a, b in zip(m.shards, grown.shards) if a != b]
    assert grown.version == m.version + 1 and all(b == shards for _, b in moved)


def test_sharding_of_repeated_rows(spark):
    """Equal rows beyond a slot's share are dealt over all slots, so the law holds for them as well."""
    rows = [(i, f"text {i} " * 20) for i in range(2000)] + [(7, "the same row again")] * 4000 + [(None, None)] * 3000
    got, _ = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=24, n_slots=1024)
    load = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    size = [r["b"] for r in load]
    assert got.count() == 9000 and len(load) == 24 and max(size) / (sum(size) / 24) < 1.05
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in load)


def test_stored_slot_map(spark, tmp_path):
    """The map is loaded, edited and stored again; a record moves only if its slot's entry was edited."""
    path = f"file://{tmp_path}/slots"
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(3000)], "doc_id long, text string")
    key = lambda rows: {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in rows.collect()}
    rows, first = sharding.shard_documents(docs, 8, 256, map_path=path)
    before = key(rows)
    rows, again = sharding.shard_documents(docs, 8, 256, map_path=path)
    assert again.version == first.version == sharding.SlotMap.load(spark, path).version == 2 and key(rows) == before
    more = docs.unionByName(spark.createDataFrame([(5000 + i, "y" * 700) for i in range(40)], docs.schema))
    rows, third = sharding.shard_documents(more, 8, 256, map_path=path)
    after = key(rows)
    edited = {slot for version, slot, _, _ in sharding.SlotMap.load(spark, path).history if version == third.version}
    assert third.version == 3 and edited == {s for s, (a, b) in enumerate(zip(first.shards, third.shards)) if a != b}
    assert {after[d][0] for d in before if before[d] != after[d]} <= edited
    rows, wider = sharding.shard_documents(more, 9, 256, map_path=path)
    assert wider.n_shards == 9 and sharding.SlotMap.load(spark, path, 2).shards == first.shards
    assert {r["shard"] for r in rows.select("shard").distinct().collect()} == set(range(9))
    with pytest.raises(ValueError):
        sharding.shard_documents(more, 8, 128, map_path=path)
    with pytest.raises(ValueError):
        wider.store(spark, path)


def test_sharding_balance(spark, sf):
    rows, _ = sharding.shard_documents(spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet"))
    load = [r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 24 and max(load) / (sum(load) / 24) < 1.01


def test_tokens_equal_the_tokenizer(docs):
    e = encoder(tokenizer_path())
    odd = [*ODD, "it's  don't\n\n x_y __ 12½ ²", "a\x85b\x1cc", "tab\t\tx  y ", "ends in spaces   "]
    for t in odd:
        want = [] if t is None else e.whole.encode(t, add_special_tokens=False).ids
        assert e.encode(t).tolist() == want


def test_packing(spark, docs, none):
    got = packing.pack(docs.where("doc_id is not null")).toPandas()
    e = encoder(tokenizer_path())
    for i, t in enumerate(ODD):
        ids = np.append(e.encode(t), 0).astype("<u4")
        g = got[got.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        assert g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        for _, r in g.iterrows():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert packing.pack(none).count() == 0
    assert packing.pack(docs.where("doc_id is null")).first()["doc_id"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    place, offset, n = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    # the same rule without a tree
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [w for w, room in enumerate(free) if room >= lengths[i]]
        if not fits:
            free.append(64)
            fits = [len(free) - 1]
        least = min(free[w] for w in fits)
        w = next(w for w in fits if free[w] == least)
        want[i] = 64 - free[w]
        free[w] -= lengths[i]
    assert n == len(free) and sorted(want.values()) == sorted(offset.tolist())
    used = np.zeros(n, int)
    np.add.at(used, place, lengths)
    assert (used <= 64).all() and used.sum() == sum(lengths)


def test_token_counts(spark, docs, none):
    e = encoder(tokenizer_path())
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(e.ordinary(r["text"]))) for r in docs.collect())
    assert 50256 not in e.ordinary("a<|endoftext|>b").tolist() and len(e.ordinary("<|endoftext|>")) > 1
    for block, chunk in ((64, 3), (1 << 20, 4096)):
        streams = materialize(token_counts.write_streams(docs, id_col="doc_id", block_bytes=block), "t")
        got = token_counts.count_tokens(streams, chunk=chunk).collect()
        assert sorted((r["name"] if r["name"] is not None else -1, r["n_tokens"]) for r in got) == want and all(r["closed"] for r in got)
        for stream in {r["stream"] for r in got}:
            assert sorted(r["doc_no"] for r in got if r["stream"] == stream) == list(range(sum(r["stream"] == stream for r in got)))
    assert token_counts.count_tokens(token_counts.write_streams(none)).count() == 0
    open_ = spark.createDataFrame([(0, 0, bytearray(b"\1\0\2\0")), (0, 1, bytearray(b"\3\0\4")), (1, 0, None)], "stream long, block long, tokens binary")
    r = token_counts.count_tokens(open_).collect()
    assert [(x["stream"], x["n_tokens"], x["closed"]) for x in r] == [(0, 3, False)]


@pytest.mark.parametrize("whole, chunk", [(1 << 20, 4096), (8, 2)])
def test_flat_files(spark, tmp_path, whole, chunk):
    """Files of a folder are one stream, whether they are read whole or in ranges."""
    (tmp_path / "s").mkdir()
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(5000) < 0.05, 50256, rng.integers(0, 50000, 5000)).astype("<u2")
    raw = ids.tobytes()
    for i, (a, b) in enumerate(((0, 4), (4, 4096), (4096, 4098), (4098, 10000))):
        (tmp_path / "s" / f"{i}.bin").write_bytes(raw[a:b])
    files = token_counts.read_token_files(spark, f"file://{tmp_path}/s", range_bytes=64, whole_file=whole)
    got = [(r["n_tokens"], r["closed"]) for r in token_counts.count_tokens(files, chunk=chunk).orderBy("doc_no").collect()]
    ends = np.flatnonzero(ids == 50256)
    want = [(int(n), True) for n in np.diff(np.concatenate([[-1], ends])) - 1]
    if rest := len(ids) - int(ends[-1]) - 1:
        want.append((rest, False))
    assert got == want


def test_language_filter_and_edges(spark, docs, none):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden are there", "en"), ("das haus und der garten sind dort", "de")] * 60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(train)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(train, model, keep=["doc_id"]).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    odd = langid.predict(docs, model).toPandas()
    assert len(odd) == docs.count() and odd.columns.tolist() == [*docs.columns, "lang_pred", "score"]
    by = dict(zip(odd.doc_id, odd.lang_pred))
    assert by[0] == by[1] == by[6] == by[9] == "und" and by[2] in ("de", "en") and odd.score.between(0, 1).all()
    assert langid.learn(none) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model).count() == 0
    # every n-gram that went in is found, for exactly its languages or more
    gram = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    mask = np.arange(1000, dtype=np.uint64) % np.uint64(3) + np.uint64(1)
    f = langid.LanguageFilter(["a", "b"], gram, mask)
    assert ((f.contained(gram) & mask.astype(np.uint8)) == mask).all()


def test_language_of_two_texts(spark):
    """A language with fewer texts than an n-gram needs elsewhere is still predicted."""
    rows = [(i, f"das haus {i} und der garten sind dort", "de") for i in range(200)] + [(1001, "the house and the garden are there", "en"), (1002, "there are trees", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame([(1, "the garden and the trees", "x", 1.0)], "doc_id long, text string, lang_pred string, score double"), langid.learn(docs))
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.first()["lang_pred"] == "en"


def test_many_languages(spark):
    """More languages than a word has bits, one text in each document of a language."""
    letters = np.random.default_rng(3)
    texts = [" ".join("".join(letters.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)) for _ in range(70)]
    rows = [(i, texts[i % 70], f"l{i % 70:02}") for i in range(70 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert langid.predict(docs, model).where("lang <> lang_pred").count() == 0


def test_small_language_beside_many_grams(spark):
    """A language of few texts keeps its n-grams where a large one has over a million."""
    long = [bytes(x).decode() for x in np.random.default_rng(5).integers(97, 123, (1, 1_300_000), np.uint8)] * 12
    rows = [(i, t, "big") for i, t in enumerate(long)] + [(100 + i, "zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich", "few") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.where("doc_id = 0 or lang = 'few'"), langid.learn(docs), keep=["lang"]).collect()
    assert len(got) == 7 and all(r["lang"] == r["lang_pred"] for r in got)


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = langid.predict(docs, langid.learn(docs)).where(langid.held_out())
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


def test_urls(spark):
    urls = [
        ("http://WWW.Example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/x#y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://h.org?x=/a", "h.org", "", None, None),
        ("no url", "", "", None, None),
        (None, "", "", None, None),
        ("://", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://com", "com", "", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "c", "c") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    weights = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.judge_urls(df, weights).orderBy("page_id").collect()
    for (_, host, path, rule, verdict), r in zip(urls, got):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict in (None, r["verdict"]) and r["verdict"] in ("allow", "block")
    # the model, against the same sum in plain Python over Spark's hashes
    texts = spark.createDataFrame([("jackpot-poker.info/3",), ("ab",), ("",)], "t string")
    rows = texts.select("t", url_filter.buckets(F.col("t")).alias("b"), url_filter.probability(F.col("t"), weights).alias("p")).collect()
    for r in rows:
        t = r["t"]
        want = [t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)]
        hashed = spark.createDataFrame([(i, g) for i, g in enumerate(want)], "i int, g string").orderBy("i").select(F.pmod(F.xxhash64("g"), F.lit(url_filter.BUCKETS)).alias("h"))
        assert r["b"] == [h["h"] for h in hashed.collect()]
        counts = np.bincount(r["b"], minlength=url_filter.BUCKETS) if r["b"] else np.zeros(url_filter.BUCKETS)
        z = counts @ np.array(weights[:-1]) / (np.linalg.norm(counts) or 1) + weights[-1]
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-z)))
    labelled = url_filter.labelled_urls(spark)
    p = url_filter.probability(F.concat(*url_filter.host_path(F.col("url"))), weights)
    assert labelled.where((p >= 0.5).cast("int") == F.col("label")).count() / labelled.count() > 0.95
    assert url_filter.train(labelled.where("label = 0"))[-1] < 0
    assert url_filter.judge_urls(df.limit(0), weights).count() == 0


def test_url_model_on_sites_it_never_saw(spark, sf):
    """A tenth of the word pairs is kept from training; their sites are judged right, and no word of the table is a host's."""
    used = lambda a, b: zlib.crc32(f"{a} {b}".encode()) % 10 != 0
    known = url_filter.labelled_urls(spark, used)
    rest = url_filter.labelled_urls(spark).join(known, "url", "left_anti").where("label = 1 or url rlike '[a-z]{7}'")
    weights = url_filter.train(known)
    p = url_filter.probability(F.concat(*url_filter.host_path(F.col("url"))), weights)
    assert rest.count() > 100 and rest.where((p >= 0.5).cast("int") == F.col("label")).count() / rest.count() > 0.97
    pages = spark.read.parquet(sf.replace("0.001", "0.1") + "/pages.parquet")
    hosts = {r[0] for r in pages.select(url_filter.host_path(F.col("url"))[0]).distinct().collect()}
    words = {w for h in hosts for label in h.split(".") for w in label.split("-")}
    assert not words & set(url_filter.BLOCK_WORDS + url_filter.ALLOW_WORDS)
    assert not hosts & {r[0] for r in url_filter.labelled_urls(spark).select(url_filter.host_path(F.col("url"))[0]).collect()}


def test_large_labelled_table(spark):
    """A table over the bound is cut by hash, for each label: where labels sort doesn't matter, and both stay."""
    rows = [(f"http://{'a' if i % 3 else 'z'}{i}.{'garden' if i % 3 else 'poker'}.com/", int(i % 3 == 0)) for i in range(2 * url_filter.MAX_LABELLED)]
    weights = url_filter.train(spark.createDataFrame([*rows, (None, 1), ("http://x.poker.com", None)], "url string, label int"))
    asked = spark.createDataFrame([(1, "http://new.poker.net/"), (2, "http://new.garden.net/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(asked, weights).collect()} == {1: "block", 2: "allow"}


def test_arrow_helpers():
    from vicinal.llm.common import buffers, run_starts, slices, spread

    raw, off = buffers(pa.array(["ab", None, "é"]))
    assert raw.tobytes() == "abé".encode() and off.tolist() == [0, 2, 2, 4]
    assert run_starts(np.array([1, 1, 2]), np.array([0, 1, 1])).tolist() == [0, 1, 2]
    assert spread(np.array([5, 9]), np.array([2, 1])).tolist() == [5, 6, 9]
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", "b", "cc", None]})
    assert [p.num_rows for p in slices(batch, "t", 3)] == [1, 3]
