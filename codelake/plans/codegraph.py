"""From files to the linked code graph, and from the graph to findings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..lineage import cut
from ..operators import analyses, resolve
from ..parse import PARSERS
from ..report import scan_stats, union
from ..sources.git import churn
from ..sources.repo import read_repo

BATCH_TOKENS = 100_000
"""Tokens after which parsed files go on from a worker."""
PARSED = pa.schema([
    ("file", pa.string()), ("lang", pa.string()), ("error", pa.string()),
    ("symbols", pa.list_(pa.struct([("local_id", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("fqn", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int32())]))),
    ("edges", pa.list_(pa.struct([("from_id", pa.int32()), ("to_id", pa.int32()), ("kind", pa.string()), ("confidence", pa.string())]))),
    ("entrypoints", pa.list_(pa.int32())),
    ("complexity", pa.list_(pa.struct([("local_id", pa.int32()), ("cx", pa.int64())]))),
    ("unresolved", pa.list_(pa.struct([("from_id", pa.int32()), ("callee", pa.string())]))),
    ("tokens", pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int32()), ("norm", pa.string())]))),
])
SQL = """file string, lang string, error string,
symbols array<struct<local_id: int, kind: string, name: string, fqn: string, start_byte: long, end_byte: long, start_line: int>>,
edges array<struct<from_id: int, to_id: int, kind: string, confidence: string>>, entrypoints array<int>,
complexity array<struct<local_id: int, cx: long>>, unresolved array<struct<from_id: int, callee: string>>,
tokens array<struct<start_byte: long, end_byte: long, start_line: int, norm: string>>"""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file; a file that is no UTF-8 or breaks its parser has an error and no rows, a damaged one both."""
    named = lambda kind, rows: [dict(zip(kind, r, strict=True)) for r in rows]
    keys = {f.name: [c.name for c in f.type.value_type] for f in PARSED if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type)}
    done, size = [], 0
    for batch in batches:
        for file, lang, data in zip(*(batch.column(c) for c in ("file", "lang", "content")), strict=True):
            row = {"file": file.as_py(), "lang": lang.as_py(), "error": None, "symbols": [], "edges": [], "entrypoints": [], "complexity": [], "unresolved": [], "tokens": []}
            try:
                p = PARSERS[row["lang"]](row["file"], data.as_py().decode("utf-8"))
                row |= {"entrypoints": p.entrypoints, "error": p.error} | {c: named(k, getattr(p, c)) for c, k in keys.items()}
            except Exception as e:  # noqa: BLE001  one bad file must not end a scan; it is reported
                row["error"] = f"{type(e).__name__}: {e}"
            done.append(row)
            size += len(row["tokens"]) + 1
            if size > BATCH_TOKENS:
                yield pa.RecordBatch.from_pylist(done, schema=PARSED)
                done, size = [], 0
    yield pa.RecordBatch.from_pylist(done, schema=PARSED)


@dataclass
class CodeGraph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    entrypoints: DataFrame
    complexity: DataFrame
    unresolved: DataFrame
    tokens: DataFrame
    errors: DataFrame

    def views(self) -> None:
        """Temporary views for ad-hoc SQL."""
        for name, df in vars(self).items():
            df.createOrReplaceTempView(name)


def parse_files(files: DataFrame) -> CodeGraph:
    """Each file is parsed once, into one row of arrays that is written; the tables are views of it."""
    rows = cut(files.select("file", "lang", "content").mapInArrow(_parse, SQL))
    flat = lambda c: rows.select("file", F.inline(c))
    symbols = flat("symbols").withColumns({"visibility": F.lit("unknown"), "confidence": F.lit("certain")})
    edges = rows.select("file", F.posexplode("edges").alias("edge_ord", "e")).select("file", "e.from_id", F.col("file").alias("to_file"), "e.to_id", "e.kind", "e.confidence", "edge_ord")
    tokens = rows.select("file", F.posexplode("tokens").alias("pos", "t")).select("file", "pos", "t.*")
    return CodeGraph(
        rows.select("file", "lang"), symbols, edges, rows.select("file", F.explode("entrypoints").alias("local_id")), flat("complexity"), flat("unresolved"), tokens,
        rows.filter("error is not null").select("file", "error"),
    )


def merge(a: CodeGraph, b: CodeGraph) -> CodeGraph:
    """Both graphs' rows; ids stay, as they count within a file."""
    return CodeGraph(*(x.unionByName(y) for x, y in zip(vars(a).values(), vars(b).values(), strict=True)))


def link(graph: CodeGraph) -> CodeGraph:
    """Calls across files, then package imports, then promotion of sure calls."""
    edges = resolve.cross_file_calls(graph.symbols, graph.edges, graph.unresolved)
    symbols = resolve.resolve_package_imports(graph.symbols)
    return replace(graph, symbols=symbols, edges=resolve.promote_calls(symbols, edges))


def findings(graph: CodeGraph, commits: DataFrame, config: Config) -> DataFrame:
    """All six analyses of a linked graph; each runs only if its rows are asked for."""
    g = graph
    return union([
        analyses.dead_code(g.symbols, g.edges, g.entrypoints),
        analyses.duplication(g.tokens, config.min_tokens),
        analyses.complexity(g.symbols, g.complexity),
        analyses.hotspot(g.symbols, g.complexity, commits),
        analyses.import_cycles(g.symbols, g.edges),
        analyses.boundary(g.symbols, g.edges, config.boundaries),
    ])


@dataclass
class Scan:
    graph: CodeGraph
    findings: DataFrame
    stats: dict


def scan(spark: SparkSession, root: str) -> Scan:
    """Read, parse, link and analyse one tree."""
    began = time.monotonic()
    config = load_config(root)
    graph = link(parse_files(read_repo(spark, root, config.ignore)))
    found = cut(findings(graph, churn(spark, root), config))
    stats = scan_stats(graph.symbols, graph.complexity, graph.files).first().asDict()
    return Scan(graph, found, stats | {"duration_ms": int(1000 * (time.monotonic() - began))})
