"""Text and JSON formats: task and query lists, server lists, id maps, configuration, requests and hits."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ConfigError, RequestError, Unsupported
from ..functions.text import base64_encode, strip_comment


def tasks(lines: DataFrame, value: str = "value") -> DataFrame:
    """``key TAB url [TAB meta]`` lines; lines without a tab, or with nothing after the first, are bad."""
    v = F.col(value)
    at = F.instr(v, "\t")
    p = F.split(v, "\t", 3)
    return lines.select(v.alias("line"), F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("url"), F.coalesce(F.get(p, F.lit(2)), F.lit("")).alias("meta"), ((at > 0) & (at < F.length(v))).alias("valid"))


def query_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """White-space separated pairs: expected key, url."""
    words = F.filter(F.split(F.col(value), r"\s+"), lambda w: w != "")
    return lines.where(F.size(words) >= 2).select(F.get(words, F.lit(0)).alias("expect_key"), F.get(words, F.lit(1)).alias("url"))


def server_list(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.explode(F.split(F.trim(value), r"\s+")).alias("address")).where("address <> ''")


def backends(lines: DataFrame, value: str = "value") -> DataFrame:
    """``address [tag]`` lines, comments stripped, blanks skipped, distinct; more than one tag is not supported."""
    v = strip_comment(F.col(value))
    words = F.split(v, r"\s+")
    out = lines.where(v != "").select(F.get(words, F.lit(0)).alias("address"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("tag"), F.size(words).alias("n"))
    bad = F.when(F.col("n") > 2, F.raise_error(F.lit("more than one tag"))).otherwise(F.col("address"))
    return out.select(bad.alias("address"), "tag").dropDuplicates()


def idmap(spark: SparkSession, path: str) -> DataFrame:
    """``dbid TAB outer id``; dbid must be the row's number."""
    rows = spark.read.csv(path, sep="\t", schema="dbid int, outer_id int")
    numbered = rows.withColumn("n", F.row_number().over(W.orderBy("dbid")) - 1)  # max_dbs rows at most
    return numbered.select(F.when(F.col("dbid") == F.col("n"), F.col("dbid")).otherwise(F.raise_error(F.lit("bad id map")).cast("int")).alias("dbid"), "outer_id")


def save_idmap(rows: DataFrame, path: str) -> None:
    rows.orderBy("dbid").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def load_config(path: str) -> dict[str, str]:
    """Dotted keys of an XML file; a missing file is an empty configuration."""
    if not Path(path).exists():
        return {}
    out: dict[str, str] = {}

    def walk(node, prefix):
        for child in node:
            name = f"{prefix}.{child.tag}" if prefix else child.tag
            if len(child):
                walk(child, name)
            else:
                out[name] = (child.text or "").strip()

    root = ET.parse(path).getroot()
    walk(root, root.tag)
    return out


def override_config(config: dict[str, str], settings: list[str]) -> dict[str, str]:
    out = dict(config)
    for s in settings:
        key, _, value = s.partition("=")
        if not key or not value:
            raise ConfigError(s)
        out[key] = value
    return out


def save_config(config: dict[str, str], path: str) -> None:
    roots: dict[str, ET.Element] = {}
    for key, value in sorted(config.items()):
        parts = key.split(".")
        node = roots.setdefault(parts[0], ET.Element(parts[0]))
        for p in parts[1:]:
            found = node.find(p)
            node = found if found is not None else ET.SubElement(node, p)
        node.text = str(value)
    if len(roots) > 1:
        raise Unsupported("one root only")
    for root in roots.values():
        ET.ElementTree(root).write(path)


REQUEST = "db int, raw boolean, url string, content string, type string, K int, R double, hint_K int, hint_R double, params_l1 string"


def search_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as request columns, with the protocol's defaults; content is base64."""
    r = F.from_json(F.col(body), REQUEST)
    default = {"db": F.lit(0), "raw": F.lit(True), "url": F.lit(""), "type": F.lit(""), "K": F.lit(-1), "R": F.lit(float("nan")), "hint_K": F.lit(-1), "hint_R": F.lit(float("nan")), "params_l1": F.lit("")}
    cols = [F.coalesce(r[c], d).alias(c) for c, d in default.items()]
    return rows.select("*", *cols, F.coalesce(F.unbase64(r["content"]), F.lit(b"")).alias("content"))


def checked_request(url: str, content: bytes) -> None:
    if url and content:
        raise RequestError("both url and content set")


def hits_json(hits: DataFrame) -> DataFrame:
    """One JSON response per query."""
    h = F.sort_array(F.collect_list(F.struct("rank", "key", "meta", "score", "details")))
    return hits.groupBy("qid").agg(F.to_json(F.struct(h.alias("hits"))).alias("body"))


#: letters of a hit format -> column
_FORMAT = {"k": "key", "m": "meta", "d": "details", "s": "score", "K": "task_key", "U": "task_url", "M": "task_meta"}


def format_hit(fmt: str) -> Column:
    """Compiles a hit format: %k %m %d %s of the hit, %K %U %M of the task, %%, \\t and \\\\."""
    parts, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c in "%\\" and i + 1 < len(fmt):
            n = fmt[i + 1]
            if c == "%" and n in _FORMAT:
                parts.append(F.col(_FORMAT[n]).cast("string"))
            elif c == "%" and n == "%":
                parts.append(F.lit("%"))
            elif c == "\\" and n == "t":
                parts.append(F.lit("\t"))
            elif c == "\\" and n == "\\":
                parts.append(F.lit("\\"))
            else:
                raise RequestError(f"bad format {c}{n}")
            i += 2
        elif c in "%\\":
            raise RequestError("bad format")
        else:
            parts.append(F.lit(c))
            i += 1
    return F.concat(*parts) if parts else F.lit("")


def paginate(hits: DataFrame, page, size, rank: str = "rank") -> tuple[DataFrame, int, int]:
    """A page of ranked rows; a bad size becomes 20, a bad page 0. Returns (rows, page, size)."""
    size = size if isinstance(size, int) and size > 0 else 20
    page = page if isinstance(page, int) and page >= 0 else 0
    return hits.where(F.col(rank).between(page * size + 1, (page + 1) * size)), page, size


def n_pages(n: int, size: int) -> int:
    return (n - 1) // size + 1


def audit(requests: DataFrame, kind: str) -> DataFrame:
    """Log lines of requests, contents as base64."""
    body = F.when(F.length("content") > 0, F.concat(F.lit(" CONTENT: "), base64_encode(F.col("content")))).otherwise(F.concat(F.lit(" URL: "), F.col("url")))
    return requests.select(F.concat(F.lit(f"OBJECT {kind} "), F.col("raw").cast("int").cast("string"), body).alias("line"))


def multipart(body: bytes, boundary: str) -> list[tuple[str, bytes]]:
    """(name, content) of the parts of a multipart form body."""
    out = []
    for chunk in body.split(b"--" + boundary.encode())[1:]:
        if chunk.startswith(b"--"):
            break
        head, _, content = chunk.lstrip(b"\r\n").partition(b"\r\n\r\n")
        name = head.decode(errors="replace").partition('name="')[2].partition('"')[0]
        out.append((name, content.removesuffix(b"\r\n")))
    return out
