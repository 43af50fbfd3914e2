"""Links between files: calls by name, package imports by suffix, promotion of sure calls, import graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def functions(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind = 'function'")


def cross_file_calls(symbols: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``edges`` plus a likely call for each unresolved callee and each function of that name in another file.

    A call that exists already between the two stays single. Every function of the name is a callee, however common it is.
    """
    targets = functions(symbols).select(F.col("name").alias("callee"), F.col("file").alias("to_file"), F.col("local_id").alias("to_id"))
    known = edges.filter("kind = 'calls'").select("file", "from_id", "to_file", "to_id")
    keys = ["file", "from_id", "to_file", "to_id"]
    new = unresolved.join(targets, "callee").filter("file <> to_file").select(*keys).distinct().join(known, keys, "left_anti")
    return edges.unionByName(new.withColumns({"kind": F.lit("calls"), "confidence": F.lit("likely"), "edge_ord": F.lit(None).cast("int")}))


def resolve_package_imports(symbols: DataFrame) -> DataFrame:
    """Dependency names of Go rewritten to the longest package directory of the tree that the import path ends with.

    The path's own suffixes at slashes meet the directories by equality; no name changes where none fits.
    """
    go = lambda s: s.filter(F.col("file").endswith(".go"))
    dirs = go(symbols).filter("kind = 'file'").select(F.col("fqn").alias("dir")).distinct().filter("dir <> ''")
    paths = go(symbols).filter("kind = 'dependency'").select("name").distinct()
    parts = F.split("name", "/")
    suffixes = paths.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("dir"))
    best = suffixes.join(dirs, "dir").groupBy("name").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    is_go = (F.col("kind") == "dependency") & F.col("file").endswith(".go")
    joined = symbols.join(best, "name", "left")
    return joined.withColumn("name", F.when(is_go & F.col("dir").isNotNull(), F.col("dir")).otherwise(F.col("name"))).select(*symbols.columns)


def promote_calls(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with likely calls made certain where both ends are in one file that has one function of the callee's name."""
    fns = functions(symbols).select("file", "local_id", "name")
    single = fns.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("local_id").alias("local_id")).filter("n = 1")
    sure = single.select(F.col("file").alias("s_file"), F.col("local_id").alias("s_id"))
    meets = (edges["to_file"] == sure["s_file"]) & (edges["to_id"] == sure["s_id"]) & (edges["file"] == edges["to_file"]) & (edges["kind"] == "calls") & (edges["confidence"] == "likely")
    joined = edges.join(sure, meets, "left")
    return joined.withColumn("confidence", F.when(F.col("s_id").isNotNull(), F.lit("certain")).otherwise(F.col("confidence"))).select(*edges.columns)


def exports(symbols: DataFrame) -> DataFrame:
    """(key, exporter): the first file, by path and id, whose file, class or module has the key as its full name."""
    own = symbols.filter("kind in ('file', 'class', 'module')")
    return own.groupBy(F.col("fqn").alias("key")).agg(F.min_by("file", F.struct("file", "local_id")).alias("exporter"))


def imports(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, from_id, key) of each import edge."""
    deps = symbols.filter("kind = 'dependency'").select(F.col("file").alias("to_file"), F.col("local_id").alias("to_id"), F.col("name").alias("key"))
    return edges.filter("kind = 'imports'").join(deps, ["to_file", "to_id"]).select("file", "from_id", "key")


def file_import_graph(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) files: who imports what another file exports."""
    found = imports(symbols, edges).join(exports(symbols), "key")
    return found.select(F.col("file").alias("src"), F.col("exporter").alias("dst")).filter("src <> dst").distinct()


def name_import_graph(symbols: DataFrame, edges: DataFrame, classes_as_files: bool = False) -> DataFrame:
    """(src, dst) full names: a file's own full name and the exported key it imports.

    A class that is imported by its name (Java) is no file's full name and so ends every path. ``classes_as_files`` puts
    the full name of its file in its place, which lets such files form cycles.
    """
    files = symbols.filter("kind = 'file'").select("file", F.col("local_id").alias("from_id"), F.col("fqn").alias("src"))
    found = imports(symbols, edges).join(files, ["file", "from_id"]).join(exports(symbols).select("key"), "key", "left_semi")
    if classes_as_files:
        owner = exports(symbols).select("key", F.col("exporter").alias("file")).join(symbols.filter("kind = 'file'").select("file", F.col("fqn").alias("dst")), "file")
        return found.join(owner.select("key", "dst"), "key").select("src", "dst").filter("src <> dst").distinct()
    return found.select("src", F.col("key").alias("dst")).filter("src <> dst").distinct()


def file_spans(symbols: DataFrame, by: str = "file") -> DataFrame:
    """(node, span) of the first file symbol of each file, or of each full name."""
    span = F.struct("file", "start_byte", "end_byte", "start_line")
    return symbols.filter("kind = 'file'").groupBy(F.col(by).alias("node")).agg(F.min_by(span, F.struct("file", "local_id")).alias("span"))
