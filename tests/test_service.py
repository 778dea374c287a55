"""The service with every kind of domain, its snapshots, id map, journals and command line."""

import gzip
import json
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import cli
from vicinal.domain import DOMAINS, Domain
from vicinal.errors import ConfigError, PermissionDenied, PluginError, RequestError
from vicinal.operators.emd import emd
from vicinal.operators.indexes import counted_hits, word_counts
from vicinal.service import Server
from vicinal.sources import codec
from vicinal.streaming.ingest import last_keys

RNG = np.random.default_rng(5)


def frame(spark, server, objects):
    """Rows of (key, parts) for an insert."""
    rows = [(0, k, f"m{k}", parts) for k, parts in objects]
    return spark.createDataFrame(rows, f"db int, key string, meta string, parts {server.parts_type.simpleString()}")


def ask(server, parts, **limits):
    return [(h.key, round(h.score, 4)) for h in server.search(content=codec.encode_parts(server.domain, parts), raw=False, **limits).hits]


def test_weighted_parts_under_emd(spark, tmp_path):
    d = Domain("regions", "multi", 3, "float", "l2", "emd", index="linear", weighted=True)
    s = Server(spark, f"file://{tmp_path}/s", d)
    part = lambda: {"feature": [round(float(x), 3) for x in RNG.normal(size=3)], "weight": round(float(RNG.random() + 0.1), 3)}
    objects = [(f"k{i}", [part() for _ in range(1 + i % 4)]) for i in range(12)]
    assert s.insert_frame(frame(spark, s, objects)) == 12
    query = [part(), part()]
    side = lambda ps: (np.array([p["weight"] for p in ps], np.float32).astype(float), np.array([p["feature"] for p in ps], np.float32).astype(float))
    (wq, xq), want = side(query), []
    for k, parts in objects:
        w, x = side(parts)
        want.append((k, emd(wq / wq.sum(), w / w.sum(), np.sqrt(((xq[:, None] - x[None]) ** 2).sum(axis=2)))))
    want.sort(key=lambda r: r[1])
    got = ask(s, query, K=4, hint_K=99)
    assert [k for k, _ in got] == [k for k, _ in want[:4]] and got[0][1] == pytest.approx(want[0][1], abs=1e-3)


@pytest.mark.parametrize("algorithm", ["linear", "lsh", "kgraph"])
def test_bit_parts_counted(spark, tmp_path, algorithm):
    d = Domain("keypoints", "multi", 2, "uint32", "hamming", "counting", part_data=("x", "y"))
    config = {"vicinal.index.algorithm": algorithm, "vicinal.kgraph.min": "5", "vicinal.kgraph.index.K": "5", "vicinal.lsh.tables": "4", "vicinal.lsh.bits": "4"}
    s = Server(spark, f"file://{tmp_path}/s", d, config)
    part = lambda: {"feature": [int(x) for x in RNG.integers(0, 1 << 32, 2)], "data": {"x": 1.0, "y": 2.0}}
    objects = [(f"k{i}", [part() for _ in range(3)]) for i in range(8)]
    s.insert_frame(frame(spark, s, objects))
    s.misc("reindex")
    assert (algorithm == "kgraph") == (0 in s.graphs)
    query = [objects[2][1][0], objects[2][1][2], objects[5][1][1]]
    assert ask(s, query, K=5, hint_K=1, hint_R=3.0) == [("k2", 2.0), ("k5", 1.0)]


def test_words_through_the_inverted_index(spark, tmp_path):
    s = Server(spark, f"file://{tmp_path}/s", DOMAINS["text"], extractor=lambda b, t: [len(w) * 1000 + ord(w[0]) for w in b.decode().split()])
    for k, t in (("a", b"red green green"), ("b", b"blue red"), ("c", b"white")):
        s.insert(0, k, content=t)
    hits = lambda t: [(h.key, h.score) for h in s.search(content=t, K=9).hits]
    assert hits(b"green red") == [("a", 3.0), ("b", 1.0)] and hits(b"black") == []
    with pytest.raises(ConfigError):
        Server(spark, f"file://{tmp_path}/t", DOMAINS["text"], {"vicinal.index.algorithm": "kgraph"})
    with pytest.raises(ConfigError):
        Server(spark, f"file://{tmp_path}/t", DOMAINS["image"], {"vicinal.index.algorithm": "inverted"})


def test_parameters_and_limits(spark, tmp_path):
    d = Domain("v", "single", 2, "float", "l1", "trivial", index="linear")
    s = Server(spark, f"file://{tmp_path}/s", d, {"vicinal.defaults.K": "3", "vicinal.defaults.hint_K": "3", "vicinal.defaults.R": "4.5"})
    s.insert_frame(frame(spark, s, [("a", [{"feature": [1.0, 0.0]}]), ("b", [{"feature": [0.0, 2.0]}]), ("c", [{"feature": [9.0, 9.0]}])]))
    zero = [{"feature": [0.0, 0.0]}]
    assert ask(s, zero) == [("a", 1.0), ("b", 2.0)]
    assert ask(s, zero, params_l1="4,0.5") == [("b", 1.0), ("a", 4.0)]
    assert ask(s, zero, hint_R=1.5) == [("a", 1.0)] and ask(s, zero, R=100.0)[-1] == ("c", 18.0)
    with pytest.raises(ConfigError):
        Server(spark, f"file://{tmp_path}/t", d, {"vicinal.defaults.R": "0"})
    with pytest.raises(PluginError):
        s.search(content=struct.pack("<3f", 1, 2, 3)[:6], raw=False)
    c = Server(spark, f"file://{tmp_path}/c", Domain("v", "single", 2, "float", "l2", "trivial", index="linear"))
    c.insert_frame(frame(spark, c, [("a", [{"feature": [1.0, 0.0]}])]))
    with pytest.raises(RequestError):
        ask(c, zero, params_l1="1,2")


def test_databases_and_restart(spark, tmp_path):
    d = Domain("v", "single", 2, "float", "l2", "trivial")
    config = {"vicinal.kgraph.min": "10", "vicinal.kgraph.index.K": "5", "vicinal.max_dbs": "2", "vicinal.last_size": "3"}
    root = f"file://{tmp_path}/s"
    s = Server(spark, root, d, config)
    x = RNG.normal(size=(30, 2)).round(3)
    rows = spark.createDataFrame([(70, i, f"k{i:02}", "", [{"feature": [float(a) for a in v]}]) for i, v in enumerate(x)], f"db int, seq long, key string, meta string, parts {s.parts_type.simpleString()}")
    s.insert_frame(rows)
    s.insert(7, "other", content=struct.pack("<2f", 0, 0), raw=False)
    assert s.dbs == {70: 0, 7: 1} and s.stat(70) == {"size": 30, "last": ["k27", "k28", "k29"]}
    with pytest.raises(RequestError):
        s.stat(3)
    with pytest.raises(RequestError):
        s.insert(8, "x", content=struct.pack("<2f", 0, 0), raw=False)
    s.misc("reindex", 70)
    s.insert(70, "new", content=struct.pack("<2f", 50, 50), raw=False)
    again = Server(spark, root, d, config, readonly=True)
    assert again.dbs == s.dbs and again.graphs[0][1] == 30 and 1 not in again.graphs
    assert [h.key for h in again.search(70, content=struct.pack("<2f", *x[4]), raw=False, K=1).hits] == ["k04"]
    assert [h.key for h in again.search(70, content=struct.pack("<2f", 49, 50), raw=False, K=1).hits] == ["new"]
    with pytest.raises(PermissionDenied):
        again.misc("clear", 70)
    assert Server(spark, root, d, config).ping()["restart_count"] == 1
    s.misc("clear", 70)
    assert s.stat(70)["size"] == 0 and s.stat(7)["size"] == 1 and Server(spark, root, d, config).graphs == {}


def test_json_calls(spark, tmp_path):
    d = Domain("v", "single", 2, "float", "l2", "trivial", index="linear")
    seen = []
    s = Server(spark, f"file://{tmp_path}/s", d, extractor=lambda b, t: [float(v) for v in b.split()], before=[lambda c, b: seen.append(c) or b], after=[lambda c, o: o | {"by": c}], handlers={"double": lambda n: {"n": 2 * n}})
    assert s.handle("insert", {"db": 0, "key": "a" * 900, "content": "MSAy"})[0] == 200
    assert s.handle("double", {"n": 4})[2] == {"n": 8, "by": "double"} and s.handle("extract", {"content": "MSAy"})[2]["object"] == [1.0, 2.0]
    assert [s.handle(c, b)[0] for c, b in (("nothing", {}), ("stat", {"no": 1}), ("search", {"db": 5, "content": "MSAy"}))] == [404] * 3 and seen[0] == "insert"
    status, headers, body = s.respond("search", b'{"content": "MSAy", "K": 1}', "gzip, br")
    assert status == 200 and headers["Content-Encoding"] == "gzip" and json.loads(gzip.decompress(body))["hits"][0]["score"] == 0
    assert s.respond("search", b"{", "gzip")[0] == 404 and "Content-Encoding" not in s.respond("ping", b"")[1]


def test_batch_against_sql(spark, sf, tmp_path):
    """A batch of searches through the service finds what SQL finds."""
    s = Server(spark, f"file://{tmp_path}/s", Domain("v", "single", 64, "float", "l2", "trivial", index="linear"))
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    parts = F.array(F.struct(F.col("embedding").alias("feature")))
    s.insert_frame(e.select(F.lit(0).alias("db"), F.col("vec_id").alias("seq"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("key"), F.lit("").alias("meta"), parts.alias("parts")))
    found = s.search_frame(0, e.select(F.col("vec_id").cast("int").alias("qid"), parts.alias("parts"), F.lit(3).alias("K"), F.lit(3).alias("hint_K")))
    got = sorted((r["qid"], r["rank"], int(r["key"])) for r in found.collect())
    d = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1]-z[2] as double)*cast(z[1]-z[2] as double)))"
    sql = f"select a.vec_id as q, row_number() over (partition by a.vec_id order by cast(sqrt({d}) as float), b.vec_id) as r, b.vec_id from '{sf}/embeddings.parquet' a, '{sf}/embeddings.parquet' b qualify r <= 3"
    assert got == sorted(duckdb.sql(sql).fetchall())


def test_command_line(spark, tmp_path):
    d = DOMAINS["image"]
    for i in range(3):
        (tmp_path / f"{i}.obj").write_bytes(codec.encode_parts(d, [{"feature": [float(i)] * 48}]))
    tasks, lines = tmp_path / "tasks", []
    tasks.write_text("".join(f"k{i}\t{tmp_path}/{i}.obj\tm{i}\n" for i in range(3)) + "bad line\n")
    run = lambda *a: cli.run(spark, ["--set", f"vicinal.root=file://{tmp_path}/store", "--set", "vicinal.index.algorithm=linear", *a], lines.append)
    assert run("insert", str(tasks)) == 0 and run("insert", str(tasks)) == 1  # the keys are there
    assert run("search", str(tasks), "-K", "2", "--hint-K", "2", "--format", "%K>%k %m %s") == 0
    assert lines[0] == "k0>k0 m0 0.0" and len(lines) == 6 and lines[1].startswith("k0>k1 m1 6.9")
    lines.clear()
    (tmp_path / "pairs").write_text(f"k1 {tmp_path}/1.obj\nk0 {tmp_path}/2.obj\nk0 {tmp_path}/none\n")
    assert run("stress", str(tmp_path / "pairs"), "--count", "4") == 0
    assert {k: lines[0][k] for k in ("queries", "errors", "misses")} == {"queries": 4, "errors": 1, "misses": 1}
    (tmp_path / "out").write_text(f"k\t{tmp_path}/2.obj\t{tmp_path}/copy.obj\n")
    assert run("extract", str(tmp_path / "out")) == 0 and (tmp_path / "copy.obj").read_bytes() == (tmp_path / "2.obj").read_bytes()
    journal = tmp_path / "journal"
    good = b"".join(codec.journal_record(f"j{i}", "", codec.encode_parts(d, [{"feature": [10.0 + i] * 48}])) for i in range(4))
    journal.write_bytes(good + b"\1\2\3")
    lines.clear()
    assert run("journal-stat", f"file://{journal}") == run("replay", f"file://{journal}") == run("replay", f"file://{journal}") == 0
    assert lines == [{"objects": 4, "features": 4, "per_object": 1.0}, 4, 0]
    assert codec.truncate_journal(str(journal), d) == len(good) == journal.stat().st_size
    lines.clear()
    assert run("stat") == run("ping") == run("sync") == run("clear") == run("stat") == 0
    assert lines[0]["size"] == 7 and lines[1]["restart_count"] > 0 and lines[-1]["size"] == 0
    assert cli.run(spark, ["ping"], lines.append) == 1


def test_counted_hits(spark, monkeypatch):
    from vicinal.operators import indexes

    words = [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(i, " ".join(RNG.choice(words, RNG.integers(0, 40)))) for i in range(120)] + [(500, None)]
    asked = [(i, " ".join(RNG.choice(words, 6))) for i in range(7)] + [(9, "")]
    d = spark.createDataFrame(docs, "k long, t string").repartition(3)
    q = spark.createDataFrame(asked, "k long, t string")
    want = []
    for j, t in asked:
        scores = sorted(((sum((x or "").split().count(w) for w in t.split()), i) for i, x in docs), key=lambda r: (-r[0], r[1]))
        want += [(j, r + 1, i, float(s)) for r, (s, i) in enumerate(scores[:5]) if s]
    run = lambda: sorted((r["qid"], r["rank"], r["object"], r["score"]) for r in counted_hits(word_counts(d, "k", "t"), word_counts(q, "k", "t"), 5).collect())
    assert run() == sorted(want)
    monkeypatch.setattr(indexes, "QUERY_NUMBERS", 1)  # the join
    assert run() == sorted(want)


def test_last_keys_as_stream_state(spark, tmp_path):
    spark.createDataFrame([(i % 2, i, f"k{i}") for i in range(20)], "db int, seq long, key string").write.parquet(f"{tmp_path}/in")
    stream = last_keys(spark.readStream.schema("db int, seq long, key string").parquet(f"{tmp_path}/in"), 3)
    stream.writeStream.outputMode("update").format("memory").queryName("last_keys").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r["db"]: r["last"] for r in spark.table("last_keys").collect()} == {0: ["k14", "k16", "k18"], 1: ["k15", "k17", "k19"]}
