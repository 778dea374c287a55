"""The service: ping, search, batch search, stat, fetch, insert, misc and extract over a store of tables.

A server holds databases of one domain. Objects of every domain are stored as parts (feature, and weight and data
where the domain has them); a single-feature object is one part, a text one part for each word. A search explodes the
query's parts, runs them through the domain's index, and scores candidates with the domain's matcher.
"""

from __future__ import annotations

import base64
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .domain import Domain
from .errors import ConfigError, ExternalError, PermissionDenied, PluginError, RequestError, ServiceError
from .functions.similarity import Similarity, is_normal_number, weighted_l1
from .operators import store as tables
from .operators.indexes import ALGORITHMS, Inverted, KGraph, Linear, Lsh
from .operators.matchers import Counting, Earthmover, Trivial
from .plans.search import Defaults, search
from .sources import codec
from .storage import exists, subfolders

log = logging.getLogger("vicinal")

#: Parts of an object at most; an entry's number is its object's number times this, plus the part's.
PARTS = codec.MAX_PARTS + 1


@dataclass
class Hit:
    key: str
    meta: str
    score: float
    details: str = ""


@dataclass
class SearchResponse:
    hits: list[Hit]
    time: float = 0.0
    load_time: float = 0.0
    filter_time: float = 0.0
    rank_time: float = 0.0


class Settings:
    """Typed access to a configuration's dotted keys; a value that can't be read, or isn't positive, is an error."""

    def __init__(self, values: dict[str, str]):
        self.values = values

    def number(self, key: str, default, kind=int, positive: bool = True):
        text = self.values.get(f"vicinal.{key}")
        if text is None or text == "":
            return default
        try:
            value = kind(text)
        except ValueError as e:
            raise ConfigError(f"{key}: {e}") from e
        if positive and not value > 0:
            raise ConfigError(f"{key} must be positive")
        return value

    def radius(self, key: str) -> float | None:
        value = self.number(key, None, float, positive=False)
        if value is not None and not is_normal_number(value):
            raise ConfigError(f"{key} must be a normal number")
        return value


@dataclass
class Server:
    """One domain, many databases; a store has one writing server at a time.

    ``extractor`` turns raw bytes into a feature (a list of numbers), or a list of parts (dicts) for domains with
    several; ``fetcher`` resolves a URL to bytes. ``before`` and ``after`` filter the requests and responses of
    ``handle``, ``handlers`` adds calls to it. Responses are small (K hits), so they come back as Python objects;
    batch users take the frames.
    """

    spark: SparkSession
    root: str
    domain: Domain
    config: dict[str, str] = field(default_factory=dict)
    readonly: bool = False
    extractor: Callable[[bytes, str], list] | None = None
    fetcher: Callable[[str], bytes] | None = None
    before: list[Callable[[str, dict], dict]] = field(default_factory=list)
    after: list[Callable[[str, dict], dict]] = field(default_factory=list)
    handlers: dict[str, Callable[..., dict]] = field(default_factory=dict)

    def __post_init__(self):
        s = self.settings = Settings(self.config)
        self.root = self.root.rstrip("/")
        self.parts_type = codec.parts_type(self.domain)
        self.key = self.config.get("vicinal.http.server.key", "")
        default = "inverted" if self.domain.kind == "text" else self.domain.index
        self.algorithm = self.config.get("vicinal.index.algorithm", default)
        if self.algorithm not in ALGORITHMS or (self.algorithm == "inverted") != (self.domain.kind == "text"):
            raise ConfigError(f"index {self.algorithm} for objects of kind {self.domain.kind}")
        self.defaults = Defaults(K=s.number("defaults.K", 1), hint_K=s.number("defaults.hint_K", 1), R=s.radius("defaults.R"), hint_R=s.radius("defaults.hint_R"))
        self.last_size, self.max_dbs = s.number("last_size", tables.LAST_SIZE), s.number("max_dbs", tables.MAX_DBS)
        self.log_objects = bool(s.number("server.log_object", 0, positive=False))
        self.penalty = s.number("emd.extra_mass_penalty", 0.0, float, positive=False)
        self.index_options = self._index_options()
        self.store = tables.Store(self.spark, self.root, f"key string, meta string, parts {self.parts_type.simpleString()}", self.readonly)
        self.graphs: dict[int, tuple[DataFrame, int]] = {}
        self.recent: dict[int, list[str]] = {}
        self.next_seq: dict[int, int] = {}
        self.dbs = tables.load_idmap(self.spark, f"{self.root}/idmap")
        self._count_start()
        self._recover()

    def _index_options(self) -> dict:
        s = self.settings
        if self.algorithm == "lsh":
            return {"tables": s.number("lsh.tables", 8), "bits": s.number("lsh.bits", 8), "width": s.number("lsh.width", 1.0, float)}
        if self.algorithm in ("kgraph", "kgraph_lite"):
            build = {k: s.number(f"kgraph.index.{k}", d) for k, d in (("K", 25), ("L", 50), ("S", 10), ("iterations", 12))}
            return {"minimum": s.number("kgraph.min", 10_000), **build, "delta": s.number("kgraph.index.delta", 0.002, float), "seed": s.number("kgraph.index.seed", 1), "P": s.number("kgraph.search.P", 100), "T": s.number("kgraph.search.T", 1)}
        return {}

    # helpers

    def _count_start(self) -> None:
        """Start times are kept beside the store, so that a restart is known as one."""
        path = f"{self.root}/starts"
        now = time.time()
        if self.readonly:
            self.started = [now]
            return
        self.spark.createDataFrame([(now,)], "at double").coalesce(1).write.mode("append").parquet(path)
        self.started = sorted(r["at"] for r in self.spark.read.parquet(path).collect())  # one row per start

    def _auth(self, authentication: str) -> None:
        if self.key and authentication != self.key:
            raise PermissionDenied("authentication")

    def _db(self, outer: int, allocate: bool = False) -> int:
        """The internal number of a database; reading an unknown one is an error, writing to it makes it known."""
        if outer in self.dbs:
            return self.dbs[outer]
        if not allocate:
            raise RequestError(f"unknown database {outer}")
        if self.readonly:
            raise PermissionDenied("read only")
        if len(self.dbs) >= self.max_dbs:
            raise RequestError("too many databases")
        self.dbs[outer] = len(self.dbs)
        tables.save_idmap(self.spark, f"{self.root}/idmap", self.dbs)
        return self.dbs[outer]

    def _load(self, url: str = "", content: bytes = b"", raw: bool = True, kind: str = "") -> list[dict]:
        """The parts of a request's object."""
        if self.log_objects:
            log.info("OBJECT %s %d %s", kind, raw, f"URL: {url}" if url else f"CONTENT: {base64.b64encode(content).decode()}")
        if url and content:
            raise RequestError("both url and content set")
        if url:
            if self.fetcher is None:
                raise ExternalError(url)
            content = self.fetcher(url)
        if raw:
            if self.extractor is None:
                raise PluginError("no extractor")
            found = list(self.extractor(content, kind))
            if self.domain.kind == "single":
                found = [{"feature": found}]
            elif self.domain.kind == "text":
                found = [p if isinstance(p, dict) else {"feature": p} for p in found]
        else:
            found = codec.decode_parts(self.domain, content)
        return [self._checked(p) for p in found]

    def _checked(self, part: dict) -> dict:
        d = self.domain
        number = float if d.element == "float" else int
        try:
            feature = number(part["feature"]) if d.kind == "text" else [number(x) for x in part["feature"]]
            out = {"feature": feature}
            if d.weighted:
                out["weight"] = float(part["weight"])
            if d.part_data:
                out["data"] = {k: float(part["data"][k]) for k in d.part_data}
        except (KeyError, TypeError, ValueError) as e:
            raise PluginError(f"bad part: {e}") from e
        if d.kind != "text" and len(feature) != d.dim:
            raise PluginError(f"a feature has {d.dim} values, not {len(feature)}")
        return out

    def _index(self):
        if self.algorithm == "inverted":
            return Inverted()
        if self.algorithm == "lsh":
            return Lsh(self.domain.dim, **self.index_options)
        if self.algorithm == "linear":
            return Linear(self.domain.dim)
        return KGraph(self.domain.dim, **self.index_options)

    def _measure(self, params_l1: str) -> Similarity:
        """The domain's similarity, with a query's parameters where it takes any (weights, for L1)."""
        measure = self.domain.measure
        if not params_l1:
            return measure
        if measure.name != "l1":
            raise RequestError(f"{measure.name} takes no parameters")
        return Similarity("weighted_l1", measure.polarity, lambda a, b, dim=None: weighted_l1(a, b, params_l1))

    def _matcher(self, query_parts: DataFrame, object_parts: DataFrame):
        if self.domain.matcher == "counting":
            return Counting()
        if self.domain.matcher == "emd":
            return Earthmover(query_parts, object_parts, self.penalty)
        return Trivial(self.domain.measure.polarity)

    def _records(self, db: int) -> DataFrame:
        return self.store.records().where(F.col("db") == db)

    @staticmethod
    def _exploded(rows: DataFrame, key: str, tag: str) -> DataFrame:
        return rows.select(key, F.posexplode("parts").alias(tag, "part"))

    def _entries(self, db: int) -> DataFrame:
        """(object, dtag, feature) of all parts."""
        return self._exploded(self._records(db).withColumnRenamed("seq", "object"), "object", "dtag").select("object", "dtag", F.col("part.feature").alias("feature"))

    # calls

    def ping(self) -> dict:
        return {"first_start_time": self.started[0], "last_start_time": self.started[-1], "restart_count": len(self.started) - 1}

    def extract(self, url: str = "", content: bytes = b"", raw: bool = True, type: str = "") -> list:
        """A single-feature object's feature, or an object's parts."""
        parts = self._load(url, content, raw, type)
        return parts[0]["feature"] if self.domain.kind == "single" else parts

    def search_frame(self, db: int, queries: DataFrame, params_l1: str = "") -> DataFrame:
        """Hits of a frame of queries (qid, parts; K, R, hint_K, hint_R if set)."""
        inner = self._db(db)
        entries, measure = self._entries(inner), self._measure(params_l1)
        limits = [c for c in ("K", "R", "hint_K", "hint_R") if c in queries.columns]
        asked = queries.select("qid", *limits, F.posexplode("parts").alias("qtag", "part")).select("qid", "qtag", F.col("part.feature").alias("feature"), *limits)
        matcher = None
        if self.domain.matcher == "emd":
            side = lambda df, key: df.select(key, "tag", F.col("part.weight").alias("weight"), F.col("part.feature").alias("feature"))
            matcher = self._matcher(side(self._exploded(queries, "qid", "tag"), "qid"), side(self._exploded(self._records(inner).withColumnRenamed("seq", "object"), "object", "tag"), "object"))
        matcher = matcher or self._matcher(None, None)
        index = self._index()
        if isinstance(index, KGraph):
            index = _PartGraph(index, *self.graphs.get(inner, (None, 0)))
        records = self._records(inner).select(F.col("seq").alias("object"), "key", "meta")
        return search(asked, entries, measure, matcher, index, records, self.defaults)

    def search(self, db: int = 0, url: str = "", content: bytes = b"", raw: bool = True, type: str = "", K: int = -1, R: float = float("nan"), hint_K: int = -1, hint_R: float = float("nan"), params_l1: str = "") -> SearchResponse:
        return self.search_batch(db, [(url, content)], raw, type, K, R, hint_K, hint_R, params_l1)[0]

    def search_batch(self, db: int, requests: list[tuple[str, bytes]], raw: bool = True, type: str = "", K: int = -1, R: float = float("nan"), hint_K: int = -1, hint_R: float = float("nan"), params_l1: str = "") -> list[SearchResponse]:
        """One response for each request; all run as one plan, and limits that aren't set take the defaults."""
        if not requests:
            raise RequestError("no queries")
        t0 = time.perf_counter()
        objects = [self._load(u, c, raw, type) for u, c in requests]
        t1 = time.perf_counter()
        schema = T.StructType([T.StructField("qid", T.IntegerType()), T.StructField("parts", self.parts_type), *(T.StructField(n, k) for n, k in (("K", T.IntegerType()), ("R", T.DoubleType()), ("hint_K", T.IntegerType()), ("hint_R", T.DoubleType())))])
        frame = self.spark.createDataFrame([(i, p, K, float(R), hint_K, float(hint_R)) for i, p in enumerate(objects)], schema)
        ranked = self.search_frame(db, frame, params_l1)
        t2 = time.perf_counter()
        found = ranked.orderBy("qid", "rank").collect()  # K rows per request
        t3 = time.perf_counter()
        out = [SearchResponse([], t3 - t0, t1 - t0, t2 - t1, t3 - t2) for _ in objects]
        for r in found:
            out[r["qid"]].hits.append(Hit(r["key"], r["meta"], r["score"], r["details"]))
        return out

    def insert(self, db: int, key: str, meta: str = "", url: str = "", content: bytes = b"", raw: bool = True, type: str = "", authentication: str = "") -> dict:
        self._auth(authentication)
        t0 = time.perf_counter()
        parts = self._load(url, content, raw, type)
        t1 = time.perf_counter()
        schema = T.StructType([T.StructField("db", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("meta", T.StringType()), T.StructField("parts", self.parts_type)])
        self.insert_frame(self.spark.createDataFrame([(db, key, meta, parts)], schema))
        t2 = time.perf_counter()
        # the new entry is searched by scan until the next reindex, so there is nothing to do for the index
        return {"time": t2 - t0, "load_time": t1 - t0, "journal_time": t2 - t1, "index_time": 0.0}

    def insert_frame(self, batch: DataFrame, strict: bool = True) -> int:
        """Inserts (db, key, meta, parts) rows, numbered after the last one of a database; a column ``seq`` orders them."""
        outer = [r["db"] for r in batch.select("db").distinct().limit(self.max_dbs + 1).collect()]
        inner = {o: self._db(o, allocate=True) for o in outer}
        for db in inner.values():
            if db not in self.next_seq:  # looked up once; this server is the store's only writer
                last = self._records(db).agg(F.max("seq")).first()[0]
                self.next_seq[db] = 0 if last is None else last + 1
        known = F.broadcast(self.spark.createDataFrame([(o, i, self.next_seq[i]) for o, i in inner.items()], "db int, __db int, __next long"))  # max_dbs rows
        n = tables.numbered(batch.join(known, "db"))
        rows = n.select(F.col("__db").alias("db"), (F.col("__next") + F.col("__n")).alias("seq"), "key", "meta", "parts")
        done = self.store.insert(rows, strict)
        for db in inner.values():
            last = self._records(db).where(F.col("seq") >= self.next_seq[db])
            tail = last.orderBy(F.desc("seq")).limit(self.last_size).select("seq", "key").collect()
            if tail:
                self.next_seq[db] = tail[0]["seq"] + 1
                self.recent[db] = (self.recent.get(db, []) + [r["key"] for r in reversed(tail)])[-self.last_size :]
        return done

    def replay(self, path: str, db: int = 0, seek: int = 0) -> int:
        """Inserts the records of journal files (up to the first broken one of each); returns how many are new."""
        found = codec.scan_journals(codec.scan_local_files(self.spark, path), self.domain, seek)
        return self.insert_frame(found.select(F.lit(db).alias("db"), "seq", "key", "meta", "parts"), strict=False)

    def fetch(self, db: int, keys: list[str]) -> list[tuple[str, str]]:
        asked = self.spark.createDataFrame(list(enumerate(keys)), "pos int, key string")
        found = tables.fetch(self._records(self._db(db)), asked)
        return [(r["key"], r["meta"]) for r in found.orderBy("pos").collect()]  # as many rows as keys

    def stat(self, db: int) -> dict:
        inner = self._db(db)
        return {"size": self._records(inner).count(), "last": self.recent.get(inner, [])}

    def misc(self, method: str, db: int = 0, authentication: str = "") -> dict:
        self._auth(authentication)
        if method not in ("reindex", "clear", "sync"):
            raise RequestError(f"unknown method {method}")
        if self.readonly:
            raise PermissionDenied("read only")
        if method == "reindex":
            self.reindex(self._db(db))
        elif method == "clear":
            inner = self._db(db)
            self.store.clear(inner)
            self._forget(inner)
            self.recent.pop(inner, None)
            self.next_seq.pop(inner, None)
        return {"code": 0, "text": ""}  # sync: writes are durable already

    # graph snapshots

    def reindex(self, db: int) -> None:
        """Builds the graph of a database's entries and keeps it beside the store, so that a restart finds it."""
        index = self._index()
        if not isinstance(index, KGraph):
            return
        if self.algorithm == "kgraph_lite":  # searches a graph that was built elsewhere
            self._recover()
            return
        entries = _PartGraph.coded(self._entries(db))
        graph = index.build(entries, self.domain.measure)
        if graph is None:
            return
        top = self._records(db).agg(F.max("seq")).first()[0] + 1
        version = len(subfolders(self.spark, f"{self.root}/graphs/db={db}"))
        path = f"{self.root}/graphs/db={db}/{version:06d}-{top}"
        graph.write.parquet(path)
        self.graphs[db] = (self.spark.read.parquet(path), top)

    def _recover(self) -> None:
        """The newest whole snapshot of each database; without one, all its entries are scanned."""
        for db in self.dbs.values():
            for path in sorted(subfolders(self.spark, f"{self.root}/graphs/db={db}"), reverse=True):
                if exists(self.spark, f"{path}/_SUCCESS"):
                    self.graphs[db] = (self.spark.read.parquet(path), int(path.rsplit("-", 1)[1]))
                    break

    def _forget(self, db: int) -> None:
        self.graphs.pop(db, None)
        tables.remove(self.spark, f"{self.root}/graphs/db={db}")

    def handle(self, call: str, body: dict) -> tuple[int, dict, dict]:
        """A JSON call: (status, headers, response). Contents are base64; errors are 404 with their text and code."""
        try:
            args = dict(body)
            for f in self.before:
                args = f(call, args)
            if "content" in args:
                args["content"] = base64.b64decode(args["content"])
            if call == "search_batch":
                if "urls" not in args:
                    raise RequestError("urls missing")
                args["requests"] = [(u, b"") for u in args.pop("urls")]
            calls = {n: getattr(self, n) for n in ("ping", "search", "search_batch", "stat", "fetch", "insert", "misc", "extract")} | self.handlers
            if call not in calls:
                raise RequestError(f"unknown call {call}")
            try:
                out = calls[call](**args)
            except TypeError as e:
                raise RequestError(str(e)) from e
            if isinstance(out, SearchResponse):
                out = {"time": out.time, "load_time": out.load_time, "filter_time": out.filter_time, "rank_time": out.rank_time, "hits": [vars(h) for h in out.hits]}
            elif call == "search_batch":
                out = {"results": [{"time": r.time, "hits": [vars(h) for h in r.hits]} for r in out]}
            elif call == "fetch":
                out = {"records": [{"key": k, "meta": m} for k, m in out]}
            elif call == "extract":
                out = {"object": out}
            for f in self.after:
                out = f(call, out)
            return 200, {}, out
        except ServiceError as e:
            return 404, {"Error": str(e), "ErrorCode": str(e.code)}, {}

    def respond(self, call: str, body: bytes, accept_encoding: str = "") -> tuple[int, dict, bytes]:
        """``handle`` on bytes; a response of 1000 bytes or more is compressed if the caller takes gzip."""
        import gzip

        try:
            args = json.loads(body or b"{}")
        except ValueError:
            return 404, {"Error": "bad JSON", "ErrorCode": str(RequestError.code)}, b"{}"
        status, headers, out = self.handle(call, args)
        data = json.dumps(out).encode()
        if len(data) >= 1000 and "gzip" in accept_encoding.lower():
            return status, headers | {"Content-Encoding": "gzip"}, gzip.compress(data)
        return status, headers, data


class _PartGraph:
    """A graph over the parts of objects: an entry's number holds its object's and its tag."""

    def __init__(self, index: KGraph, graph: DataFrame | None, indexed: int):
        self.index, self.graph, self.indexed = index, graph, indexed

    @staticmethod
    def coded(entries: DataFrame) -> DataFrame:
        return entries.select((F.col("object") * PARTS + F.col("dtag")).alias("object"), F.lit(0).alias("dtag"), "feature")

    def search(self, queries: DataFrame, entries: DataFrame, measure: Similarity) -> DataFrame:
        if self.graph is None:
            return Linear(self.index.dim).search(queries, entries, measure)
        coded = self.coded(entries).withColumn("indexed", F.col("object") < self.indexed * PARTS)
        found = self.index.search(queries, coded, measure, self.graph)
        return found.withColumn("dtag", F.pmod("object", F.lit(PARTS)).cast("int")).withColumn("object", F.floor(F.col("object") / PARTS))


class RoundRobin:
    """Client over several servers: the next one for each search, others after a failure."""

    def __init__(self, servers: list, retry: int = 3):
        if not servers:
            raise ConfigError("no servers")
        self.servers, self.retry, self.at = servers, retry, 0

    def search(self, **request) -> SearchResponse:
        from .errors import ProxyBackendError

        last = None
        for _ in range(self.retry):
            server = self.servers[self.at % len(self.servers)]
            self.at += 1
            try:
                return server.search(**request)
            except ServiceError as e:
                raise e
            except Exception as e:  # a backend that is down
                last = e
        raise ProxyBackendError(str(last))


def with_config(domain: Domain, config: dict[str, str]) -> Domain:
    """A domain whose similarity, matcher or index the configuration names."""
    names = {k: config[f"vicinal.domain.{k}"] for k in ("similarity", "matcher", "index") if f"vicinal.domain.{k}" in config}
    return replace(domain, **names)
