"""Code-graph shaped views of the test tables, a query for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Boundaries
from .functions.text import TOKEN, header_map, remote_parts
from .operators import analyses, graph, resolve
from .parse.model import enclosing, normalize
from .parse.tokens import Token
from .plans.codegraph import CodeGraph, parse_files
from .report import by_rule, diagnostics, gate, metrics, rules_seen, sarif_tool, scan_stats, totals, union
from .schema import RULES, SEVERITIES
from .sources.git import count_commits
from .sources.tables import read_table

K = 8
CX, FLOOR, SCORE = 6, 5, 300
FORBID = [("AFRICA", "MIDDLE EAST"), ("ASIA", "MIDDLE EAST"), ("EUROPE", "AMERICA")]
KEYWORDS = frozenset({"the", "and", "der", "de", "la"})
# Language, ending, head, a branch, tail: @K is the customer's key, @N the nation's.
SOURCES = [
    ("java", ".java", "class C@K {\n  int f@K(int x) {\n", "    if (x > 1 && x < 9) {\n      return h@N(x);\n    }\n", "    return x;\n  }\n}\n"),
    ("ruby", ".rb", "def f@K(x)\n", "  if x && true\n    h@N(x)\n  end\n", "end\n"),
    ("typescript", ".ts", "function f@K(x: number) {\n", "  if (x && true) {\n    return h@N(x);\n  }\n", "  return 0;\n}\n"),
    ("python", ".py", "import r@N.m\n\ndef f@K(x):\n    def g@K(y):\n        return f@K(y) if y else h@N(y)\n", "    if x and g@K(x):\n        return h@N(x)\n", "    return 0\n"),
    ("go", ".go", "package p\n\nfunc f@K(x int) int {\n", "\tif x > 1 && x < 9 {\n\t\treturn h@N(x)\n\t}\n", "\treturn 0\n}\n"),
    ("rust", ".rs", "fn f@K(x: i32) -> i32 {\n", "    if x > 1 && x < 9 {\n        return h@N(x);\n    }\n", "    0\n}\n"),
]
LAYERS = {"blog": ["**/blog/**", "**/post*"], "docs": ["**/doc*/**", "**/wiki/**"], "page": ["**/p*"], "rest": ["**"]}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)


def _symbols(df: DataFrame, file, local_id, kind: str, name, fqn) -> DataFrame:
    none = F.lit(0).cast("long")
    return df.select(
        file.cast("string").alias("file"), local_id.cast("int").alias("local_id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), fqn.cast("string").alias("fqn"),
        none.alias("start_byte"), none.alias("end_byte"), F.lit(1).alias("start_line"), F.lit("unknown").alias("visibility"), F.lit("certain").alias("confidence"),
    )


def _edges(df: DataFrame, kind: str, confidence) -> DataFrame:
    c = F.col
    return df.select(c("file").cast("string").alias("file"), c("from_id").cast("int"), c("to_file").cast("string"), c("to_id").cast("int"), F.lit(kind).alias("kind"), confidence.alias("confidence"), F.lit(None).cast("int").alias("edge_ord"))


def order_functions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Symbols and complexity: a customer is a file, an order a function, one and its lines its complexity."""
    symbols = _symbols(t.orders, F.col("o_custkey"), F.col("o_orderkey"), "function", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.lit(""))
    cx = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    rows = t.orders.join(cx, "o_orderkey", "left")
    return symbols, rows.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").cast("int").alias("local_id"), (F.coalesce("lines", F.lit(0)) + 1).cast("long").alias("cx"))


def part_calls(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges, entrypoints: parts are functions, consecutive large lines of an order call each other."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    a, b = line.filter("l_quantity > 47"), line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("to"))
    pairs = a.join(b, (F.col("l_orderkey") == F.col("k")) & (F.col("n") == F.col("l_linenumber") + 1)).groupBy("l_partkey", "to").agg(F.bool_or(F.col("l_returnflag") == "N").alias("sure"))
    edges = pairs.select(
        F.lit("p").alias("file"), F.col("l_partkey").cast("int").alias("from_id"), F.lit("p").alias("to_file"), F.col("to").cast("int").alias("to_id"), F.lit("calls").alias("kind"),
        F.when(F.col("sure"), "certain").otherwise("likely").alias("confidence"), F.lit(None).cast("int").alias("edge_ord"),
    )
    symbols = _symbols(t.part, F.lit("p"), F.col("p_partkey"), "function", F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit(""))
    return symbols, edges, t.part.filter("p_size = 1").select(F.lit("p").alias("file"), F.col("p_partkey").cast("int").alias("local_id"))


def nation_imports(t: Tables, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges: a nation is a file in its region's folder and imports the ``most`` nations its customers buy most from."""
    sold = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    )
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cents")).alias("c"), F.col("s_nationkey").alias("n")))), 1, most)  # nations
    best = sold.groupBy("c_nationkey").agg(top.alias("best")).select("c_nationkey", F.explode("best").alias("b")).select("c_nationkey", F.col("b.n").alias("to"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("path"))
    files = _symbols(named, F.col("path"), F.lit(0), "file", F.col("path"), F.col("path"))
    uses = best.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("path").alias("file"), "to")
    uses = uses.join(named.withColumnRenamed("path", "key"), F.col("to") == F.col("n_nationkey")).select("file", "key", (F.col("to") + 1).alias("id"))
    deps = _symbols(uses, F.col("file"), F.col("id"), "dependency", F.col("key"), F.col("key"))
    edges = _edges(uses.select("file", F.lit(0).alias("from_id"), F.col("file").alias("to_file"), F.col("id").alias("to_id")), "imports", F.lit("certain"))
    return files.union(deps), edges


def document_tokens(t: Tables) -> DataFrame:
    """A document is a file; its tokens are words and single other characters."""
    words = t.documents.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "norm"))
    return words.select("file", "pos", F.col("pos").cast("long").alias("start_byte"), (F.col("pos") + 1).cast("long").alias("end_byte"), F.lit(1).alias("start_line"), "norm")


def complexity_findings(t: Tables) -> DataFrame:
    symbols, cx = order_functions(t)
    return analyses.complexity(symbols, cx, CX)


def churn(t: Tables) -> DataFrame:
    return count_commits(t.events.select(F.col("user_id").cast("string").alias("file"), F.lit(1).alias("n")))


def hotspot_findings(t: Tables) -> DataFrame:
    symbols, cx = order_functions(t)
    return analyses.hotspot(symbols, cx, churn(t), SCORE, FLOOR)


def dead_code_findings(t: Tables) -> DataFrame:
    return analyses.dead_code(*part_calls(t))


def boundary_findings(t: Tables) -> DataFrame:
    symbols, edges = nation_imports(t)
    regions = {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}
    return analyses.boundary(symbols, edges, Boundaries(None, {r: [f"{r}/**"] for r in regions}, FORBID))


def every_finding(t: Tables) -> DataFrame:
    return union([dead_code_findings(t), complexity_findings(t), hotspot_findings(t), boundary_findings(t)])


def languages(t: Tables) -> DataFrame:
    """A customer's market segment stands for its file's language."""
    return t.customer.select(F.col("c_custkey").cast("string").alias("file"), F.lower("c_mktsegment").alias("lang"))


def reach(t: Tables, strong: bool) -> DataFrame:
    _, edges, roots = part_calls(t)
    steps = edges.select(F.col("from_id").cast("string").alias("src"), F.col("to_id").cast("string").alias("dst"), (F.col("confidence") == "certain").alias("strong"))
    found = graph.reachable(roots.select(F.col("local_id").cast("string").alias("node")), steps)
    return found.filter("strong" if strong else "true").select(F.col("node").cast("long").alias("node"))


def promote_edges(t: Tables) -> DataFrame:
    """Orders of a customer are functions named by priority; each is called by the customer's first order."""
    symbols = _symbols(t.orders, F.col("o_custkey"), F.col("o_orderkey"), "function", F.col("o_orderpriority"), F.lit(""))
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("from_id"))
    edges = _edges(t.orders.join(first, "o_custkey").select(F.col("o_custkey").alias("file"), "from_id", F.col("o_custkey").alias("to_file"), F.col("o_orderkey").alias("to_id")), "calls", F.lit("likely"))
    return resolve.promote_calls(symbols, edges).select("file", F.col("from_id").cast("long"), F.col("to_id").cast("long"), "confidence")


def cross_file_calls(t: Tables) -> DataFrame:
    """Suppliers are functions named by nation and balance band, customers call by nation and band from their own files."""
    name = lambda k, b: F.concat(F.col(k).cast("string"), F.lit("-"), F.floor(F.col(b) / 1000).cast("string"))
    symbols = _symbols(t.supplier, F.col("s_suppkey") % 10, F.col("s_suppkey"), "function", name("s_nationkey", "s_acctbal"), F.lit(""))
    calls = t.customer.select((F.col("c_custkey") % 10).cast("string").alias("file"), F.col("c_custkey").cast("int").alias("from_id"), name("c_nationkey", "c_acctbal").alias("callee"))
    known = _edges(t.customer.filter("c_custkey % 7 = 0").join(t.supplier, name("c_nationkey", "c_acctbal") == name("s_nationkey", "s_acctbal")).select((F.col("c_custkey") % 10).alias("file"), F.col("c_custkey").alias("from_id"), (F.col("s_suppkey") % 10).alias("to_file"), F.col("s_suppkey").alias("to_id")), "calls", F.lit("certain"))
    out = resolve.cross_file_calls(symbols, known, calls)
    return out.select("file", F.col("from_id").cast("long"), "to_file", F.col("to_id").cast("long"), "confidence")


def go_suffix_resolve(t: Tables) -> DataFrame:
    """Page paths are import paths; the last one or two segments of every third page are package directories."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = t.pages.select("page_id", path.alias("path"))
    tail = lambda n: F.array_join(F.slice(F.split("path", "/"), -n, n), "/")
    dirs = pages.filter("page_id % 3 = 0 and size(split(path, '/')) > 2").select(F.when(F.col("page_id") % 2 == 0, tail(1)).otherwise(tail(2)).alias("dir")).filter("dir <> ''").distinct()
    symbols = _symbols(dirs, F.concat("dir", F.lit("/x.go")), F.lit(0), "file", F.col("dir"), F.col("dir")).union(_symbols(pages, F.lit("main.go"), F.col("page_id"), "dependency", F.col("path"), F.col("path")))
    return resolve.resolve_package_imports(symbols).filter("kind = 'dependency'").select(F.col("local_id").cast("long").alias("page_id"), "name")


def clone_windows(t: Tables) -> DataFrame:
    w = analyses.token_windows(document_tokens(t), K)
    groups = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def duplication_findings(t: Tables) -> DataFrame:
    return analyses.duplication(document_tokens(t), K)


def token_normalize(t: Tables) -> DataFrame:
    """The parsers' norms over the documents' tokens, with KEYWORDS for reserved words."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [Token("op" if not x.isascii() or not x[0].isalnum() and x[0] != "_" else "number" if x.isdecimal() else "word", x, 0, 0, 1) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for *_, n in normalize(tokens, KEYWORDS, {"number": "NUM"})], pa.string())], ["norm"])

    return document_tokens(t).select("norm").mapInArrow(norms, "norm string").groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def enclosing_function(t: Tables) -> DataFrame:
    """Lines of an order are nested ranges that end at 10; each place 0 to 9 belongs to the shortest that holds it, then the smallest part."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("lines"))  # an order's own

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                owners = enclosing([(x["l_linenumber"], 10, i) for i, x in enumerate(spans)], list(range(10)))
                out += [(order, p, spans[i]["l_linenumber"], spans[i]["l_partkey"]) for p, i in enumerate(owners) if i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["l_orderkey", "place", "start", "l_partkey"])

    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return orders.join(lines, "l_orderkey").mapInArrow(places, "l_orderkey long, place long, start long, l_partkey long")


def sources(t: Tables) -> DataFrame:
    """(file, lang, content): each customer is a source file in one of six languages, with one to three branches."""
    k, n, times = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 3 + 1).cast("int")
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("@K"), k), F.lit("@N"), n)
    pick = lambda f: F.element_at(F.array(*(f(x) for x in SOURCES)), (F.col("c_custkey") % len(SOURCES) + 1).cast("int"))
    text = pick(lambda x: F.concat(fill(x[2]), F.repeat(fill(x[3]), times), fill(x[4])))
    return t.customer.select(F.concat(F.lit("f"), k, pick(lambda x: F.lit(x[1]))).alias("file"), pick(lambda x: F.lit(x[0])).alias("lang"), text.cast("binary").alias("content"))


def parsed(t: Tables) -> CodeGraph:
    return parse_files(sources(t))


def parse_functions(t: Tables) -> DataFrame:
    """Functions with their lines and complexity, parsed from source text."""
    g = parsed(t)
    return g.symbols.filter("kind = 'function'").join(g.complexity, ["file", "local_id"]).select("file", "name", F.col("start_line").cast("long").alias("start_line"), "cx")


def parse_calls(t: Tables) -> DataFrame:
    """Calls that leave the file, with the functions around them, parsed from source text."""
    g = parsed(t)
    owner = g.symbols.select("file", F.col("local_id").alias("from_id"), F.col("name").alias("owner"))
    return g.unresolved.join(owner, ["file", "from_id"]).select("file", "owner", "callee")


def parse_edges(t: Tables) -> DataFrame:
    """What files define and which of their functions call each other, parsed from source text."""
    g = parsed(t)
    name = lambda c: g.symbols.select("file", F.col("local_id").alias(f"{c}_id"), F.when(F.col("kind") == "file", "file").otherwise(F.col("name")).alias(c))
    return g.edges.filter("kind in ('defines', 'calls')").join(name("from"), ["file", "from_id"]).join(name("to"), ["file", "to_id"]).select("file", F.col("from").alias("src"), F.col("to").alias("dst"), "kind", "confidence")


def import_graph(t: Tables) -> DataFrame:
    return resolve.name_import_graph(*nation_imports(t))


def file_import_graph(t: Tables) -> DataFrame:
    return resolve.file_import_graph(*nation_imports(t))


def layer_classify_glob(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.select("page_id", analyses.layer_of(path, LAYERS).alias("layer"))


def cycle_findings(t: Tables) -> DataFrame:
    return analyses.import_cycles(*nation_imports(t))


def cycle_findings_single(t: Tables) -> DataFrame:
    """Each nation imports one other at most: the cycles are the graph's only closed walks."""
    return analyses.import_cycles(*nation_imports(t, 1))


def gate_by_threshold(t: Tables) -> DataFrame:
    found = every_finding(t)
    return t.spark.createDataFrame([(s, gate(found, s)) for s in SEVERITIES], "threshold string, fails boolean")


def sarif_rules_first_seen(t: Tables) -> DataFrame:
    driver = sarif_tool(rules_seen(every_finding(t)))["driver"]
    return t.spark.createDataFrame([(r["id"], RULES.index(r["id"])) for r in driver["rules"]], "rule string, place int")


def scc_members(t: Tables) -> DataFrame:
    return graph.mutual_reach(import_graph(t))


def scan_statistics(t: Tables) -> DataFrame:
    symbols, cx = order_functions(t)
    files = _symbols(t.customer, F.col("c_custkey"), F.lit(0), "file", F.lit(""), F.lit(""))
    s = scan_stats(symbols.union(files), cx, languages(t))
    return s.select("files", "functions", "cx_max", F.round("cx_mean", 6).alias("cx_mean"), F.array_join("languages", ",").alias("languages"))


def lsp_diagnostics(t: Tables) -> DataFrame:
    d = diagnostics(every_finding(t))
    return d.select("file", F.size("items").cast("long").alias("items"), F.element_at("items", 1)["message"].alias("first_message"))


def parse_headers(t: Tables) -> DataFrame:
    text = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(", kind ="), "event_type", F.lit(",broken,kind=last"), F.lit(",v="), F.col("event_type"))
    m = F.col("m")
    return t.events.select("event_id", header_map(text).alias("m")).select("event_id", m["user"].alias("user_header"), m["kind"].alias("kind_header"), m["v"].alias("v_header"), F.size(m).cast("long").alias("headers"))


def remote_names(t: Tables) -> DataFrame:
    parts = remote_parts(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".git"))).otherwise(F.concat(F.lit("git@host:"), F.regexp_replace("url", "^[a-z]+://", ""))))
    return t.pages.select("page_id", parts.alias("p")).select("page_id", "p.namespace", "p.repo")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "complexity_findings": complexity_findings,
    "hotspot_findings": hotspot_findings,
    "churn_by_user": churn,
    "dead_code_findings": dead_code_findings,
    "reachable_any": lambda t: reach(t, False),
    "reachable_certain": lambda t: reach(t, True),
    "promote_edges": promote_edges,
    "cross_file_calls": cross_file_calls,
    "go_suffix_resolve": go_suffix_resolve,
    "clone_windows": clone_windows,
    "duplication_findings": duplication_findings,
    "token_normalize": token_normalize,
    "enclosing_function": enclosing_function,
    "import_graph": import_graph,
    "file_import_graph": file_import_graph,
    "boundary_findings": boundary_findings,
    "layer_classify_glob": layer_classify_glob,
    "cycle_findings": cycle_findings,
    "cycle_findings_single": cycle_findings_single,
    "parse_functions": parse_functions,
    "parse_calls": parse_calls,
    "parse_edges": parse_edges,
    "scc_members": scc_members,
    "scan_stats": scan_statistics,
    "gate_by_threshold": gate_by_threshold,
    "metrics_grouped": lambda t: metrics(every_finding(t), languages(t)),
    "run_event": lambda t: totals(every_finding(t)),
    "findings_union": every_finding,
    "findings_by_rule": lambda t: by_rule(every_finding(t), "hotspot"),
    "lsp_diagnostics": lsp_diagnostics,
    "sarif_rules_first_seen": sarif_rules_first_seen,
    "parse_headers": parse_headers,
    "remote_names": remote_names,
}
