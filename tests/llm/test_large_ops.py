"""Brute-force and edge-case tests of the operators that relate documents, pages and vectors to one another."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import ann, components, decontaminate, gsaca, html_text, queries, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, u long"
RNG = np.random.default_rng(4)
WORDS = ["".join(RNG.choice(list("abcdefgé"), RNG.integers(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def corpus():
    base = [prose(int(n), i) for i, n in enumerate(RNG.integers(1, 200, 40))]
    passage = prose(80, 999)
    texts = [*base, *base[:6], base[3].upper(), base[7].replace("a", "b", 1), f"{base[8]} {passage} {base[9]}", f"x{passage}", passage, None, "", " ", "z", "zz" * 400, "zz" * 300, "ab" * 30]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7, 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# suffix arrays


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5))
def test_suffix_arrays(texts):
    texts = [np.array([*t, 0]) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = gsaca.suffix_arrays(np.concatenate(texts), first)
    for i, t in enumerate(texts):
        t = t.tolist()
        assert (got[first[i] : first[i + 1]] - first[i]).tolist() == sorted(range(len(t)), key=lambda k: t[k:])


def cut_by_force(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            w = b[a : a + 50]
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if i is not None and least[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def cut(df, **options):
    rows = suffix_dedup.cut_repeats(df, keep=["doc_id"], **options)
    return [tuple(r) for r in rows.select("doc_id", "__n_bytes", "__n_removed", "__n_spans", F.sha2("__kept", 256)).collect()]


def test_suffix_dedup_by_force(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, prose(60, 3)), (None, prose(60, 3))]
    df = spark.createDataFrame([(i, t, "", "", 0, "", 1, 1) for i, t in rows], DOCS)
    key = lambda r: (r[0] is None, r)
    assert sorted(cut(df), key=key) == sorted(cut_by_force(rows), key=key)
    assert cut(none) == []
    full = suffix_dedup.cut_repeats(docs)
    assert [c for c in full.columns if not c.startswith("__")] == [c for c in docs.columns if c != "text"] and full.count() == docs.count()


def test_suffix_dedup_many_spans_of_one_name(spark):
    # one short string in very many surroundings: names are refined until texts are small
    common = "the very same sentence stands here again"
    rows = [(i, f"{prose(12, 100 + i % 40)} {common} {prose(12, 200 + i // 3)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(cut(df)) == sorted(cut_by_force(rows))


@pytest.mark.parametrize("followers", [1, 2, 5])
def test_suffix_dedup_of_a_line_that_all_share(spark, followers):
    """Spans that stand very often wait in their task's group: alone under their name, and in several surroundings."""
    line = "this very line stands at the end of each of the documents here, under some licence"
    texts = [f"{prose(15, 700 + i)} {line}" for i in range(60)] + [line] * 30 + [f"{line} {prose(6, 800 + i % 4)}" for i in range(60)] + [f"{'ab' * 90}{i % 3}" for i in range(20)]
    rows = [(i * 37 % 211, t) for i, t in enumerate(texts)] + [(500, line), (500, line), (500, prose(20, 1)), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r)
    assert sorted(cut(df, followers=followers), key=key) == sorted(cut_by_force(rows), key=key)


def test_suffix_dedup_of_one_row_over_and_over(spark):
    rows = [(1, prose(30, 5))] * 400 + [(2, prose(30, 5)), (3, "x " + prose(30, 5) + " y")] + [(None, prose(30, 5))] * 50
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, part int")
    key = lambda r: (r[0] is None, r)
    assert sorted(cut(df), key=key) == sorted(cut_by_force(rows), key=key)
    assert sorted(r["part"] for r in suffix_dedup.cut_repeats(df).collect()) == list(range(len(rows)))


def test_suffix_dedup_spans_in_pieces(monkeypatch):
    """Runs of one name cut into pieces cover the same windows."""
    raw = np.frombuffer((b"ab" * 300 + b"-" * 200 + prose(40, 1).encode()), np.uint8)
    off = np.array([0, 500, len(raw)])
    windows = lambda: sorted(x for d, a, n in zip(*suffix_dedup.spans_of(raw, off, 20)[:3]) for x in range(a, a + n - 49))
    want = [*range(451), *range(500, len(raw) - 49)]
    assert windows() == want
    monkeypatch.setattr(suffix_dedup, "SPAN_WINDOWS", 5)
    assert windows() == want


def test_suffix_dedup_runs_of_one_byte(spark):
    # one window in runs of more lengths than a text holds spans, the longest of them cut into pieces
    rows = [(i * 17 % 41, f"{prose(9, 300 + i)}{'-' * (50 + i)}{prose(9, 400 + i)}") for i in range(41)]
    rows += [(100 + i, f"{'_' * (190 - 3 * i)}{prose(4, 500 + i)} {'.' * (50 + 5 * i)}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(cut(df)) == sorted(cut_by_force(rows))


def test_packed_arrays():
    a, b = np.arange(300, dtype=np.int64) << 40, np.array([], np.uint8)
    x, y = suffix_dedup.unpack(suffix_dedup.pack(a, b))
    assert (x == a).all() and y.dtype == np.uint8 and len(y) == 0


# SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(i, least.get(r, i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_by_force(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [format(p, "016x") for p in prints], classes([i for i, _ in rows], prints)))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id")
    assert sorted(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in want})


@pytest.mark.parametrize("limit", [8192, 20])
def test_links_of_close_fingerprints(spark, limit):
    """Chains and clouds of near fingerprints; with a low limit, groups are dealt again and again."""
    rng = np.random.default_rng(8)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 12).tolist():
        for _ in range(60):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)))
        for _ in range(5):
            centre ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            prints.add(centre)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(frame, limit=limit).collect()}
    assert [got[p] for p in signed] == classes(list(range(len(prints))), prints)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)], "u long, v long")
    got = dict(map(tuple, components.connected_components(links).collect()))
    assert got == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200}
    assert components.connected_components(links.limit(0)).count() == 0


# decontamination


def by_force(rows, items, width=13):
    find = re.compile(decontaminate.WORD).findall
    windows = {}
    for i, t in items:
        w = find((t or "").encode().lower())
        n = min(width, len(w))
        for a in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in rows:
        w = find((t or "").encode().lower())
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= owners
        out.append((d, len(w), len(hit), tuple(sorted(map(str, found)))))
    return out


def test_decontamination_by_force(spark, docs, none, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, rows[3][1]), (2, " ".join(rows[8][1].split()[5:25])), (2, "z"), (10, None), (11, ""), (12, prose(30, 5)), (13, "ab cd"), (14, "zz" * 400)]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(by_force(rows, items))

    def run():
        found = decontaminate.match(decontaminate.stored_index(docs), bench)
        return sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in found.collect())

    assert run() == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # several blocks of items
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    assert run() == want
    monkeypatch.setattr(decontaminate, "CANDIDATES", 2)
    assert run() == want
    assert decontaminate.match(decontaminate.stored_index(none), bench).count() == 0
    assert decontaminate.match(decontaminate.stored_index(docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_words_of_very_long_texts():
    text = (" ".join(prose(200, i) for i in range(40)) + "x" * 3000 + " Ä1-b\n") * 3
    want = decontaminate.words(text.encode())
    for size in (1, 50, 4000):
        assert [w for b in decontaminate._blocks(text.encode(), size) for w in decontaminate.words(b)] == want
        assert [w for b in simhash._blocks(text.encode(), size) for w in b] == text.encode().split()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma z"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha a b c d e beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.stored_index(docs)
    hit = lambda **kw: sorted(r["doc_id"] for r in decontaminate.match(index, bench, **kw).where("n_hit > 0").collect())
    assert hit() == [] and hit(slop=0) == [2] and hit(slop=2) == [1, 2] and hit(slop=5) == [1, 2, 4]


def test_proximity_by_force(spark):
    """All documents in one segment; matches that end a document and matches that overlap."""
    r = np.random.default_rng(6)
    rows = [(i, " ".join(r.choice(list("abcdefgh"), int(n)))) for i, n in enumerate(r.integers(0, 14, 80))] + [(90, "c b a"), (91, "h")]
    items = ["a b c", "d e", "a g h f"]
    index = decontaminate.stored_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert index.count() == 1
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for slop in (0, 2, 5):
        want = {}
        for d, t in rows:
            w, hit = t.split(), set()
            for need in map(str.split, items):
                for a in range(len(w)):
                    part = w[a : a + len(need) + slop]
                    if w[a] in need and set(need) <= set(part):
                        hit.update(range(a, a + len(part)))
            want[d] = len(hit)
        assert {x["doc_id"]: x["n_hit"] for x in decontaminate.match(index, bench, slop=slop).collect()} == want


# neighbours


def test_ann(spark, sf):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(1000 + i, rows[0][1], "c") for i in range(200)]  # one vector very often
    rows += [(5000, None, "c"), (5001, [0.0] * 16, "c"), (5002, [float("nan")] * 16, "c"), (5003, [1.0], "c"), (5100, [None] * 16, "c"), (5200, [float("inf")] + [1.0] * 15, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = ann.nearest(df, every=100, k=10).toPandas()
    ids = np.array([r[0] for r in rows[:1100]])
    full = np.array([r[1] for r in rows[:1100]], np.float32).astype(float)
    hit = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((full - full[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine.vec_id)
        assert mine.score.tolist() == pytest.approx([d[ids == v][0] for v in mine.vec_id], rel=1e-12)
        assert mine.sort_values(["score", "vec_id"]).vec_id.tolist() == mine.vec_id.tolist()
        hit, n = hit + len(set(best) & set(mine.vec_id)), n + 10
    assert hit / n >= 0.9 and set(got.query_id) == set(ids[ids % 100 == 0])
    few = ann.nearest(df.where("vec_id < 4"), every=2, k=10)
    assert few.count() == 6
    assert ann.nearest(df.where("vec_id >= 5000")).count() == 0 and ann.nearest(df.limit(0)).count() == 0


def test_ann_asks_a_repeated_query_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 4)))]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (0, [9.0] * 4), (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, every=40, k=10).toPandas()
    assert got["rank"].tolist() == list(range(1, 11)) and got.vec_id.nunique() == 10 and 0 not in set(got.vec_id)


def test_ann_probes_follow_the_data():
    """Close neighbours need few parts, evenly spread ones need many."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 16)) * 5
    close = np.repeat(centres, 20, axis=0) + rng.normal(size=(4000, 16)) * 0.1
    assert ann.fit(close)[1] <= 4 < ann.fit(rng.normal(size=(4000, 64)))[1]


def test_ann_recall_on_the_table(spark, sf):
    t = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")
    p = t.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    got = ann.nearest(t, every=50).toPandas()
    hit = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit, n = hit + len(set(ids[np.argsort(d)[:10]]) & set(got[got.query_id == ids[q]].vec_id)), n + 10
    assert hit / n >= 0.9


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    g = ann.neighbour_graph(x, 5)
    label = ann.balanced_parts(x, g, 8, np.random.default_rng(1))
    assert np.bincount(label, minlength=8).max() <= 51
    random_cut = np.mean(rng.permutation(label)[g] != rng.permutation(label)[:, None])
    assert np.mean(label[g] != label[:, None]) < 0.8 * random_cut


# pages


def test_blocks():
    texts = lambda h: [b.text for b in html_text.blocks(h)]
    assert texts("<p>a &amp; b\n  c<p>d<b>e</b>f</p><script>var x='</p>';</script>g<!-- h --><br>i") == ["a & b c", "def", "g i"]
    assert texts("<ul><li>x<li>y</ul>1 < 2 &lt; 3") == ["x", "y", "1 < 2 < 3"]
    assert texts(None) == texts("") == texts("<div></div>") == []
    assert texts('<a title="1>0">t</a>') == ["t"]
    assert len(texts("<p>w</p>" * 5000)) == 5000


def test_blocks_after_custom_and_self_closed_elements():
    texts = lambda h: [b.text for b in html_text.blocks(h)]
    assert texts("<video-js id=v></video-js><p>a</p><template-card>t</template-card><p>b</p>") == ["a", "t", "b"]
    assert texts('<p><svg class="i" title="x>y" viewBox="0 0 1 1"/>a</p><math/><p>b<svg><path d="M0"/><text>no</text></svg>c</p>') == ["a", "bc"]
    assert texts("<p>a</p><video src=x>no</video><script\n>no</script><svg>no</svg><p>b</p><style>no") == ["a", "b"]


def test_html_extraction(spark, sf):
    rng = np.random.default_rng(77)
    model = html_text.trained()
    right = total = 0
    for _ in range(120):
        page, labels = html_text.sample_page(rng)
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        right += int(((model.label([found])[0] >= 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97
    pages = spark.read.parquet(sf.replace("0.001", "0.1") + "/pages.parquet")
    got = html_text.extract(pages, model).select("html", "text", "n_chars").collect()
    assert len(got) == pages.count()
    same = 0
    for r in got:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        import html

        want = "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if t)
        same += r["text"] == want
        assert r["n_chars"] == len(r["text"])
    assert same == len(got)
    odd = spark.createDataFrame([(1, None, "c", 5), (2, "", "c", 5), (3, "<nav><a>x</a></nav>", "c", 5)], "page_id long, html string, text string, N_chars int")
    rows = html_text.extract(odd, model)
    assert rows.columns == ["page_id", "html", "text", "n_chars"] and [(r["text"], r["n_chars"]) for r in rows.collect()][:2] == [("", 0), ("", 0)]
    assert html_text.extract(pages.limit(0), model).count() == 0


ARTICLE = [
    "<h1>How to install the tool</h1>",
    "<p>First you get the files from the server and unpack them.</p>",
    "<pre>tar xf tool.tgz\ncd tool; make install</pre>",
    "<p>Then set these values, as the table says.</p>",
    "<table><tr><th>name</th><th>value</th></tr><tr><td>depth</td><td>12</td></tr></table>",
    "<p>That is all there is to do, it works.</p>",
]


@pytest.mark.parametrize("outer", ["div", 'div class="content"', "article", "main"])
def test_html_of_articles_with_code_and_tables(outer):
    around = '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>', '<div class="footer">&copy; 2020 someone. All rights reserved.</div>'
    page = f"<html><body>{around[0]}<{outer}>{''.join(ARTICLE)}</{outer.split()[0]}>{around[1]}</body></html>"
    want = [b.text for b in html_text.blocks("".join(ARTICLE))]
    assert html_text.article_text([page], html_text.trained())[0].split("\n") == want and len(want) == 9


def test_html_of_very_long_and_deep_pages():
    """A page of 2 MB beside short ones: whole, and in memory that its own length sets."""
    import tracemalloc

    long = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>Item {i} of a long list, in some words.</p>" for i in range(45_000)) + "</article></body></html>"
    short = "<article><h1>A title</h1><p>One paragraph of a text, and not a long one.</p></article>"
    model = html_text.trained()
    tracemalloc.start()
    got = html_text.article_text([short] * 100 + [long], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(long) > 2 << 20 and got[-1].count("\n") == 44_999 and peak < 500 << 20
    assert [b.depth for b in html_text.blocks("<div>" * 50_000 + "x</div>y")] == [50_000, 49_999]
    assert len(html_text._parts("div", 'class="a b c d e f g h i j k l"')) == 13


# all together


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    items = spark.createDataFrame([(1, prose(40, 321))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = spark.createDataFrame([(900, f"{prose(20, 1)} {prose(40, 321)}", "en", "s", 0, "c", 1, 1), (901, "123", "en", "s", 0, "c", 1, 1)], DOCS)
    rows = docs.unionByName(bad)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    for start in (rows, none):
        d = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, d, str(tmp_path))
            assert after.columns == d.columns
            if start is rows and name == "language_id":
                assert 901 not in ids(after) and len(ids(after)) == len([r for r in d.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])])
            if start is rows and name == "decontamination":
                assert 900 in ids(d) and set(ids(d)) - set(ids(after)) == {900}
            if start is rows and name == "suffix_dedup":
                assert after.count() == d.count() and after.agg(F.sum(F.length("text"))).first()[0] < d.agg(F.sum(F.length("text"))).first()[0]
            d = after
        packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_cut_texts_keep_their_characters(spark, none):
    """Only what is left of a character at a cut goes; a replacement character of the text's own stays."""
    import corpus_pipeline

    words = "word " * 12  # © ends in the byte that é ends in, ã begins with the byte that é begins with
    rows = [(1, f"first-é{words}é"), (2, f"own\ufffd-©{words}ã x"), (3, None), (4, ""), (5, "\ufffd\ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c", 1, 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert got == {**dict(rows), 2: "own\ufffd- x"}


def test_clean_row_with_a_contaminated_id_stays(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(40, 321))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, prose(40, 321)), (7, prose(50, 1)), (None, prose(40, 321)), (None, prose(30, 2)), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c", 1, 1) for i, t in rows], DOCS)
    got = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path))
    assert sorted(r["text"] or "" for r in got.collect()) == sorted(["", prose(50, 1), prose(30, 2)])


def test_one_of_many_repeated_rows(spark):
    rows = [(1, "the same words again and again")] * 300 + [(2, "the same words again and again"), (3, "quite another text of some words"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c", 1, 1) for i, t in rows], DOCS)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, ""), (1, rows[0][1]), (3, rows[301][1])]


def test_registered(spark, sf):
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11))
