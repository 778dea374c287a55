"""String, URL, binary and JSON functions of the service's formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_url(s: Column) -> Column:
    return s.rlike("^(http|https|ftp)://")


def host_port(s: Column) -> Column:
    """``host:port`` as a struct; port -1 if missing."""
    return F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("host"), F.when(F.instr(s, ":") > 0, F.substring_index(s, ":", -1).try_cast("int")).otherwise(-1).alias("port"))


def key_value(s: Column) -> Column:
    """``KEY=VALUE`` as a struct; null unless both sides are there."""
    parts = F.split(s, "=", 2)
    ok = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value")))


def strip_comment(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "#.*$", ""))


def percent_encode(s: Column) -> Column:
    """Keeps letters, digits and ``- . _ ~``."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(s: Column) -> Column:
    return F.url_decode(s)


def query_dict(url: Column) -> Column:
    """Decoded parameters of a URL's query part as a map (the last of equal keys wins); empty without a query."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.transform(F.split(query, "[&;]"), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != ""))
    decoded = F.transform(pairs, lambda p: F.struct(percent_decode(F.get(p, F.lit(0))).alias("k"), percent_decode(F.get(p, F.lit(1))).alias("v")))
    return F.aggregate(decoded, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def query_encode(m: Column, amps: bool = False) -> Column:
    entries = F.transform(F.map_entries(m), lambda e: F.concat(percent_encode(e["key"]), F.lit("="), percent_encode(e["value"])))
    return F.array_join(entries, "&amp;" if amps else "&")


def hex_dump(word: Column) -> Column:
    """A 64-bit word's hex digits, lowest nibble first."""
    return F.reverse(F.lower(F.lpad(F.hex(word), 16, "0")))


def thumb_meta(meta: Column, prefix: str) -> Column:
    """``thumb`` of a JSON meta with a path prefix."""
    return F.concat(F.lit(prefix), F.get_json_object(meta, "$.thumb"))


def base64_encode(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")
