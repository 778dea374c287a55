"""Command line: ``python -m vicinal.cli [--set KEY=VALUE] COMMAND ...`` over a store on a folder.

There is no network server, so every command opens the store itself. ``insert``, ``search`` and ``extract`` read task
lines (``key TAB url [TAB meta]``) from a file or standard input; URLs are local paths of encoded objects.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import DOMAINS
from .errors import ConfigError, FileSystemError, RequestError, ServiceError
from .service import SearchResponse, Server
from .sources import codec, formats

# Fixed value: how a hit is printed if no format is given.
HIT_FORMAT = "%K\t%k\t%s"


def read_file(path: str) -> bytes:
    """A local file of at most 128 MiB; a missing or larger one is empty."""
    p = Path(path.removeprefix("file://"))
    return p.read_bytes() if p.is_file() and p.stat().st_size <= codec.MAX_RAW else b""


def write_file(path: str, content: bytes) -> None:
    try:
        Path(path).write_bytes(content)
    except OSError as e:
        raise FileSystemError(str(e)) from e


def open_server(spark: SparkSession, settings: list[str], config_path: str = "", readonly: bool = False) -> Server:
    config = formats.override_config(formats.load_config(config_path) if config_path else {}, settings)
    if "vicinal.root" not in config:
        raise ConfigError("vicinal.root is not set")
    name = config.get("vicinal.domain", "image")
    if name not in DOMAINS:
        raise ConfigError(f"unknown domain {name}")
    return Server(spark, config["vicinal.root"], DOMAINS[name], config, readonly, fetcher=read_file)


def task_rows(spark: SparkSession, lines: list[str]) -> list:
    """Good tasks in order; bad lines are reported and skipped."""
    frame = spark.createDataFrame([(i, line.rstrip("\n")) for i, line in enumerate(lines)], "n int, value string")
    rows = formats.tasks(frame.orderBy("n")).collect() if lines else []
    for r in rows:
        if not r["valid"]:
            print(f"bad task: {r['line']}", file=sys.stderr)
    return [r for r in rows if r["valid"]]


def hit_lines(spark: SparkSession, task, response: SearchResponse, fmt: str) -> list[str]:
    rows = [(i, h.key, h.meta, h.details, float(h.score), task["key"], task["url"], task["meta"]) for i, h in enumerate(response.hits)]
    if not rows:
        return []
    frame = spark.createDataFrame(rows, "n int, key string, meta string, details string, score double, task_key string, task_url string, task_meta string")
    return [r["line"] for r in frame.select("n", formats.format_hit(fmt).alias("line")).orderBy("n").collect()]


def stress(server: Server, queries: list[tuple[str, str]], count: int | None = None, **limits) -> dict:
    """Searches (expected key, url) one after another and counts: a miss is a search without its expected key."""
    out = {"queries": 0, "errors": 0, "misses": 0, "latency_ms": 0.0}
    for i in range(count if count is not None else len(queries)):
        key, url = queries[i % len(queries)]
        began = time.perf_counter()
        out["queries"] += 1
        try:
            found = server.search(url=url, raw=False, **limits)
            out["misses"] += all(h.key != key for h in found.hits)
        except ServiceError:
            out["errors"] += 1
        out["latency_ms"] += 1000 * (time.perf_counter() - began)
    return out


def journal_stat(spark: SparkSession, path: str, domain) -> DataFrame:
    """Objects, features and features per object of journal files."""
    from .operators import store

    found = codec.scan_journals(codec.scan_local_files(spark, path), domain)
    return store.journal_stat(found.withColumn("db", F.lit(0))).drop("db")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vicinal")
    p.add_argument("--config", default="")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="overrides a key of the configuration")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ping")
    for name in ("insert", "search", "extract", "stress"):
        c = sub.add_parser(name)
        c.add_argument("tasks", nargs="?", default="-", help="file of task lines (or of key-url pairs, for stress); - is standard input")
        c.add_argument("--db", type=int, default=0)
        if name in ("search", "stress"):
            c.add_argument("-K", type=int, default=-1)
            c.add_argument("-R", type=float, default=float("nan"))
            c.add_argument("--hint-K", type=int, default=-1)
            c.add_argument("--hint-R", type=float, default=float("nan"))
            c.add_argument("--params-l1", default="")
        if name == "search":
            c.add_argument("--format", default=HIT_FORMAT)
        if name == "stress":
            c.add_argument("--count", type=int)
        if name == "insert":
            c.add_argument("--authentication", default="")
    for name in ("stat", "sync", "reindex", "clear"):
        c = sub.add_parser(name)
        c.add_argument("--db", type=int, default=0)
        c.add_argument("--authentication", default="")
    c = sub.add_parser("journal-stat")
    c.add_argument("path")
    c = sub.add_parser("replay")
    c.add_argument("path")
    c.add_argument("--db", type=int, default=0)
    return p


def run(spark: SparkSession, argv: list[str], out=print) -> int:
    args = parser().parse_args(argv)
    lines = []
    if getattr(args, "tasks", None):
        lines = sys.stdin.readlines() if args.tasks == "-" else Path(args.tasks).read_text().splitlines()
    try:
        server = open_server(spark, args.set, args.config, readonly=args.command in ("search", "stress", "stat", "journal-stat"))
        limits = {k: getattr(args, k) for k in ("K", "R", "hint_K", "hint_R", "params_l1", "db") if hasattr(args, k)}
        if args.command == "ping":
            out(server.ping())
        elif args.command == "insert":
            for t in task_rows(spark, lines):
                server.insert(args.db, t["key"], t["meta"], url=t["url"], raw=False, authentication=args.authentication)
        elif args.command == "search":
            tasks = task_rows(spark, lines)
            limits.pop("db")
            found = server.search_batch(args.db, [(t["url"], b"") for t in tasks], raw=False, **limits) if tasks else []
            for t, r in zip(tasks, found):
                for line in hit_lines(spark, t, r, args.format):
                    out(line)
        elif args.command == "extract":  # an object's bytes go to the path in the task's meta
            for t in task_rows(spark, lines):
                if not t["meta"]:
                    raise RequestError(f"no path for {t['key']}")
                parts = server._load(t["url"], b"", server.extractor is not None, "")
                write_file(t["meta"], codec.encode_parts(server.domain, parts))
        elif args.command == "stress":
            pairs = [tuple(line.split()[:2]) for line in lines if len(line.split()) >= 2]
            out(stress(server, pairs, args.count, **limits))
        elif args.command == "stat":
            out(server.stat(args.db))
        elif args.command == "journal-stat":
            out(journal_stat(spark, args.path, server.domain).first().asDict())
        elif args.command == "replay":
            out(server.replay(args.path, args.db))
        else:
            out(server.misc(args.command, args.db, args.authentication))
    except ServiceError as e:
        print(f"{type(e).__name__} {e.code:#06x}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("vicinal").getOrCreate(), sys.argv[1:]))
