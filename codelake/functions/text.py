"""Small text operators as columns: languages, remote addresses, headers, token norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGES

TOKEN = r"[A-Za-z0-9_]+|[^ \t\n\x0B\f\rA-Za-z0-9_]"


def language_of(path: Column) -> Column:
    """The language of a path's extension, null if none is known."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext]


def remote_parts(url: Column) -> Column:
    """(namespace, repo): the last two path segments of an https or scp-like remote address without ``.git``; null where missing."""
    url = F.trim(url)
    tail = F.when(url.contains("@"), F.regexp_replace(F.regexp_replace(url, "^[^@]*@", ""), "^[^:]*:", "")).when(url.rlike("^https?://"), F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "^[^/]*/", "")).otherwise(url)
    parts = F.filter(F.split(F.regexp_replace(tail, r"\.git$", ""), "/"), lambda s: s != "")
    return F.struct(F.get(parts, F.size(parts) - 2).alias("namespace"), F.get(parts, F.size(parts) - 1).alias("repo"))


def header_map(text: Column) -> Column:
    """``k=v,k=v`` as a map; parts without ``=`` are skipped, blanks around keys and values dropped, a later key wins."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.contains("="))
    value = lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), value(p).alias("v")))
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["k"]), F.map_from_entries(F.array(e)))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), put)
