"""The six analyses: tables of the code graph in, findings out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Boundaries
from ..functions.globs import any_glob
from ..lineage import cut
from ..schema import COMPLEXITY_THRESHOLD, FINDINGS, HOTSPOT_FLOOR, HOTSPOT_THRESHOLD, MIN_TOKENS, UINT32, finding, place
from .graph import cycles, reachable
from .resolve import file_import_graph, file_spans, functions, name_import_graph


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDINGS)


def dead_code(symbols: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Functions that no entrypoint reaches over calls and inheritance: unused if not at all, possibly unused if only over unsure edges."""
    node = lambda f, i: F.concat_ws("\x00", f, i)
    steps = edges.filter("kind in ('calls', 'inherits')").select(node("file", "from_id").alias("src"), node("to_file", "to_id").alias("dst"), (F.col("confidence") == "certain").alias("strong"))
    reach = reachable(entrypoints.select(node("file", "local_id").alias("node")), steps)
    rows = functions(symbols).withColumn("node", node("file", "local_id")).join(reach, "node", "left").filter(~F.coalesce("strong", F.lit(False)))
    weak = F.col("strong").isNotNull()
    message = F.concat(F.when(weak, "possibly unused function `").otherwise("unused function `"), "name", F.lit("`"))
    return rows.select(*finding("dead_code", F.when(weak, "info").otherwise("warning"), message, F.when(weak, "likely").otherwise("certain"), place()))


# Odd multipliers of the two rolling hashes of a window.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _window_hashes(t: np.ndarray, base: int, k: int) -> np.ndarray:
    """Of each run of k tokens, the sum of its hashes times falling powers of an odd base, modulo 2^64.

    Prefix sums over rising powers of the base's inverse give all of them in one pass, whatever k is.
    """
    n = len(t)
    powers = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(t * powers(pow(base, -1, 1 << 64)))]
    return (sums[k:] - sums[: n - k + 1]) * powers(base)[k - 1 :]


def _windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (file, pos) -> a row for each window of k tokens in a file, keyed by two hashes of its content.

    A window's hash is a polynomial over its tokens' hashes; only the last k - 1 rows go from batch to batch.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        n = len(rows)
        if n >= k:
            files = rows.column("file").combine_chunks().dictionary_encode()
            code = files.indices.to_numpy()
            token = [rows.column(c).to_numpy().view(np.uint64) for c in ("t1", "t2")]
            keys = [_window_hashes(t, b, k).view(np.int64) for t, b in zip(token, BASES, strict=True)]
            ok = np.flatnonzero(code[: n - k + 1] == code[k - 1 :])
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [rows.column(c).combine_chunks().take(at) for c in ("file", "pos", "start_byte", "start_line")] + [rows.column("end_byte").combine_chunks().take(pa.array(ok + k - 1))] + [pa.array(x[ok]) for x in keys],
                ["file", "pos", "start_byte", "start_line", "end_byte", "h1", "h2"],
            )
        held = rows.slice(max(0, n - k + 1)) if k > 1 else None


def token_windows(tokens: DataFrame, k: int) -> DataFrame:
    """(file, pos, start_byte, start_line, end_byte, h1, h2): windows of k tokens within a file, keyed by a 128-bit hash."""
    rows = tokens.select("file", "pos", "start_byte", "end_byte", "start_line", F.xxhash64("norm").alias("t1"), F.xxhash64(F.lit(1), "norm").alias("t2"))
    rows = rows.repartition("file").sortWithinPartitions("file", "pos")
    return rows.mapInArrow(lambda it: _windows(it, k), "file string, pos int, start_byte long, start_line int, end_byte long, h1 long, h2 long")


def clones(tokens: DataFrame, k: int) -> DataFrame:
    """Reported clones: (file, pos, start_byte, end_byte, start_line, partner_file, partner_pos, partner_line, others).

    A window that occurs twice starts a region where the window one token before it does not. Of a group of equal windows
    the first place, by file and position, is reported if it starts a region; its partner is the next place that does not
    overlap it, and ``others`` counts those.
    """
    windows = cut(token_windows(tokens, k))
    many = cut(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"))
    twice = cut(windows.join(many, ["h1", "h2"]))
    first = twice.groupBy("h1", "h2").agg(F.min(F.struct("file", "pos")).alias("first")).select("h1", "h2", "first.file", "first.pos")
    before = twice.select("file", (F.col("pos") + 1).alias("pos"))
    firsts = twice.join(first, ["h1", "h2", "file", "pos"], "left_semi").join(before, ["file", "pos"], "left_anti")
    anchors = firsts.select("h1", "h2", F.col("file").alias("a_file"), F.col("pos").alias("a_pos"), F.col("start_byte").alias("a_start"), F.col("end_byte").alias("a_end"), F.col("start_line").alias("a_line"))
    apart = (F.col("file") != F.col("a_file")) | (F.col("pos") >= F.col("a_pos") + k)
    partner = F.min(F.struct("file", "pos", "start_line")).alias("partner")
    others = twice.join(anchors, ["h1", "h2"]).filter(apart).groupBy("a_file", "a_pos", "a_start", "a_end", "a_line").agg(partner, F.count(F.lit(1)).alias("others"))
    return others.select(
        F.col("a_file").alias("file"), F.col("a_pos").alias("pos"), F.col("a_start").alias("start_byte"), F.col("a_end").alias("end_byte"), F.col("a_line").alias("start_line"),
        F.col("partner.file").alias("partner_file"), F.col("partner.pos").alias("partner_pos"), F.col("partner.start_line").alias("partner_line"), "others",
    )


def duplication(tokens: DataFrame, k: int = MIN_TOKENS) -> DataFrame:
    """Runs of at least k equal tokens in two places. No window of fewer than one token exists."""
    if k < 1:
        return _empty(tokens)
    more = F.when(F.col("others") > 1, F.concat(F.lit(" and "), (F.col("others") - 1).cast("string"), F.lit(" more"))).otherwise("")
    message = F.concat(F.lit(f"duplicated code block (>= {k} tokens) also at "), "partner_file", F.lit(":"), F.col("partner_line").cast("string"), more)
    return clones(tokens, k).select(*finding("duplication", "warning", message, "certain", place("file", "pos")))


def _first_cx(complexity: DataFrame) -> DataFrame:
    return complexity.groupBy("file", "local_id").agg(F.first("cx").alias("cx"))


def complexity(symbols: DataFrame, measured: DataFrame, threshold: int = COMPLEXITY_THRESHOLD) -> DataFrame:
    """Functions over the threshold; from twice the threshold on a warning."""
    rows = functions(symbols).join(_first_cx(measured), ["file", "local_id"]).filter(F.col("cx") > threshold)
    message = F.concat(F.lit("function `"), "name", F.lit("` has high cyclomatic complexity ("), F.col("cx").cast("string"), F.lit(")"))
    return rows.select(*finding("complexity", F.when(F.col("cx") >= min(2 * threshold, UINT32), "warning").otherwise("info"), message, "certain", place()))


def hotspot(symbols: DataFrame, measured: DataFrame, churn: DataFrame, threshold: int = HOTSPOT_THRESHOLD, floor: int = HOTSPOT_FLOOR) -> DataFrame:
    """Functions whose complexity, from ``floor`` on, times their file's commits exceeds the threshold."""
    rows = functions(symbols).join(_first_cx(measured), ["file", "local_id"]).filter(F.col("cx") >= floor).join(churn, "file", "left")
    rows = rows.withColumn("ch", F.coalesce("commits", F.lit(0).cast("long"))).withColumn("score", F.least(F.col("cx") * F.col("ch"), F.lit(UINT32))).filter(F.col("score") > threshold)
    text = lambda c: F.col(c).cast("string")
    message = F.concat(F.lit("hotspot: `"), "name", F.lit("` complexity "), text("cx"), F.lit(" x churn "), text("ch"), F.lit(" = "), text("score"))
    return rows.select(*finding("hotspot", "info", message, "certain", place()))


def import_cycles(symbols: DataFrame, edges: DataFrame, classes_as_files: bool = False) -> DataFrame:
    """Circular imports between files, packages counting as one node, shown by their first files."""
    found = cycles(name_import_graph(symbols, edges, classes_as_files)).withColumn("id", F.array_join("cycle", "\x00"))
    spans = file_spans(symbols, "fqn")
    nodes = found.select("id", F.posexplode("cycle").alias("at", "node")).join(spans, "node", "left").withColumn("shown", F.coalesce("span.file", "node"))
    rows = nodes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "shown", "span"))).alias("nodes"))  # a cycle's own nodes
    span = F.col("nodes")[0]["span"]
    message = F.concat(F.lit("circular dependency: "), F.array_join(F.col("nodes.shown"), " -> "))
    return rows.select(*finding(
        "cycle", "warning", message, "certain", F.col("id"), file=F.col("nodes")[0]["shown"], start_byte=F.coalesce(span["start_byte"], F.lit(0)),
        end_byte=F.coalesce(span["end_byte"], F.lit(0)), start_line=F.coalesce(span["start_line"], F.lit(1)),
    ))


def layer_of(path: Column, layers: dict[str, list[str]]) -> Column:
    """The first layer, by name, one of whose globs a path matches; null if none."""
    out = F.lit(None).cast("string")
    for name in sorted(layers, reverse=True):
        out = F.when(any_glob(path, layers[name]), F.lit(name)).otherwise(out)
    return out


def boundary_edges(graph: DataFrame, config: Boundaries) -> DataFrame:
    """(src, dst, src_layer, dst_layer) of file imports between layers that must not know each other."""
    rows = graph.withColumns({"src_layer": layer_of(F.col("src"), config.layers), "dst_layer": layer_of(F.col("dst"), config.layers)})
    rules = graph.sparkSession.createDataFrame(sorted(set(config.forbid)), "src_layer string, dst_layer string")
    return rows.join(F.broadcast(rules), ["src_layer", "dst_layer"], "left_semi")  # as many rows as the configuration has


def boundary(symbols: DataFrame, edges: DataFrame, config: Boundaries) -> DataFrame:
    """Imports from a layer into one it must not know. Without rules there is nothing to find."""
    config = config.resolved()
    if not config.forbid:
        return _empty(symbols)
    rows = boundary_edges(file_import_graph(symbols, edges), config).join(file_spans(symbols).withColumnRenamed("node", "src"), "src", "left")
    message = F.concat(F.lit("layer `"), "src_layer", F.lit("` must not import `"), "dst_layer", F.lit("` ("), "src", F.lit(" -> "), "dst", F.lit(")"))
    return rows.select(*finding(
        "boundary", "warning", message, "certain", F.concat_ws("\x00", "src", "dst"), file=F.col("src"), start_byte=F.coalesce("span.start_byte", F.lit(0)),
        end_byte=F.coalesce("span.end_byte", F.lit(0)), start_line=F.coalesce("span.start_line", F.lit(1)),
    ))


