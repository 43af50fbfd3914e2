"""The analyses and links on graphs built by hand."""

import random

import pytest
from pyspark.sql import functions as F

from codelake import schema
from codelake.config import Boundaries
from codelake.operators import analyses, graph, resolve


def symbols(spark, rows):
    return spark.createDataFrame([(f, i, k, n, q, 0, 10, 1, "unknown", "certain") for f, i, k, n, q in rows], schema.SYMBOLS)


def functions(spark, *names, file="m"):
    return symbols(spark, [(file, i, "function", n, n) for i, n in enumerate(names)])


def edges(spark, *rows):
    return spark.createDataFrame([(f, a, g, b, k, c, None) for f, a, g, b, k, c in rows], schema.EDGES)


def entry(spark, *rows):
    return spark.createDataFrame(list(rows), schema.ENTRYPOINTS)


def said(df):
    return [(r.severity, r.message) for r in df.orderBy("ord").collect()]


def test_dead_code(spark):
    s = functions(spark, "main", "used", "maybe", "orphan")
    e = edges(spark, ("m", 0, "m", 1, "calls", "certain"), ("m", 0, "m", 2, "calls", "likely"), ("m", 0, "m", 3, "defines", "certain"))
    assert said(analyses.dead_code(s, e, entry(spark, ("m", 0)))) == [("info", "possibly unused function `maybe`"), ("warning", "unused function `orphan`")]


def test_dead_code_counts_a_sure_way_found_late(spark):
    s = functions(spark, "main", "a", "b", "c")
    e = edges(spark, ("m", 0, "m", 1, "calls", "likely"), ("m", 1, "m", 2, "calls", "certain"), ("m", 0, "m", 3, "calls", "certain"), ("m", 3, "m", 1, "inherits", "certain"))
    assert said(analyses.dead_code(s, e, entry(spark, ("m", 0)))) == []


@pytest.mark.parametrize("local", [0, 1000])
def test_reachability_equals_two_closures(spark, local):
    rng = random.Random(local)
    steps = [(str(rng.randrange(40)), str(rng.randrange(40)), rng.random() < 0.6) for _ in range(60)]

    def closure(strong):
        seen, work = {"0"}, ["0"]
        while work:
            n = work.pop()
            for a, b, sure in steps:
                if a == n and b not in seen and (sure or not strong):
                    seen.add(b)
                    work.append(b)
        return seen

    got = graph.reachable(spark.createDataFrame([("0",)], "node string"), spark.createDataFrame(steps, "src string, dst string, strong boolean"), local).collect()
    assert {r.node for r in got} == closure(False)
    assert {r.node for r in got if r.strong} == closure(True)


def tokens(spark, **files):
    return spark.createDataFrame([(f, i, 10 * i, 10 * i + 5, i + 1, w) for f, text in files.items() for i, w in enumerate(text.split())], schema.TOKENS)


@pytest.mark.parametrize(
    ("files", "k", "expected"),
    [
        ({"a": "w x y z", "b": "w x y z"}, 4, [("a", "b:1")]),
        ({"a": "w x y z", "b": "w x y z", "c": "w x y z"}, 4, [("a", "b:1 and 1 more")]),
        ({"a": "t t t t t t t"}, 4, []),
        ({"a": "w x y z 1 2 3 4 5 w x y z"}, 4, [("a", "a:10")]),
        ({"a": "1 2 3", "b": "4 5", "c": "1 2 3 4 5"}, 5, []),
        ({"a": "x y z", "b": "x y z"}, 5, []),
        ({"a": "p w x y z", "b": "q w x y z"}, 3, [("a", "b:2")]),
    ],
)
def test_duplication(spark, files, k, expected):
    got = analyses.duplication(tokens(spark, **files), k).orderBy("ord").collect()
    assert [(r.file, r.message) for r in got] == [(f, f"duplicated code block (>= {k} tokens) also at {m}") for f, m in expected]
    assert all(r.end_byte == r.start_byte + 10 * (k - 1) + 5 for r in got)


def test_duplication_without_windows(spark):
    assert analyses.duplication(tokens(spark, a="x y"), 0).count() == 0
    assert analyses.duplication(tokens(spark, a="x y").limit(0), 2).count() == 0


def test_complexity(spark):
    s = functions(spark, "a", "b", "c", "d")
    cx = spark.createDataFrame([("m", 0, 3), ("m", 1, 12), ("m", 2, 25), ("m", 3, 10)], schema.COMPLEXITY)
    assert said(analyses.complexity(s, cx, 10)) == [("info", "function `b` has high cyclomatic complexity (12)"), ("warning", "function `c` has high cyclomatic complexity (25)")]


def test_hotspot(spark):
    s = functions(spark, "a", "b").union(functions(spark, "c", "none", file="n"))
    cx = spark.createDataFrame([("m", 0, 10), ("m", 1, 9), ("n", 0, 40)], schema.COMPLEXITY)
    churn = spark.createDataFrame([("m", 6)], schema.CHURN)
    assert said(analyses.hotspot(s, cx, churn)) == [("info", "hotspot: `a` complexity 10 x churn 6 = 60")]


def imports(spark, *pairs):
    files = sorted({p[0] for p in pairs} | {p[1] for p in pairs if p[1] != "missing"})
    rows = [(f, 0, "file", f, f) for f in files] + [(a, i + 1, "dependency", b, b) for i, (a, b) in enumerate(pairs)]
    return symbols(spark, rows), edges(spark, *((a, 0, a, i + 1, "imports", "certain") for i, (a, _) in enumerate(pairs)))


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ([("a", "b"), ("b", "a")], ["a -> b"]),
        ([("a", "b")], []),
        ([("a", "missing")], []),
        ([("c", "a"), ("a", "b"), ("b", "c"), ("x", "a")], ["a -> b -> c"]),
    ],
)
def test_cycles(spark, pairs, expected):
    assert [m for _, m in said(analyses.import_cycles(*imports(spark, *pairs)))] == [f"circular dependency: {e}" for e in expected]


def test_cycles_equal_one_walk_over_all(spark):
    rng = random.Random(3)
    for _ in range(4):
        pairs = {(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(20)}
        pairs = {p for p in pairs if p[0] != p[1]}
        step = {}
        for a, b in pairs:
            step.setdefault(a, []).append(b)
            step.setdefault(b, [])
        got = graph.cycles(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()
        assert sorted(r.cycle for r in got) == sorted(graph.find_cycles(step))


def test_packages_count_as_one_node(spark):
    s = symbols(spark, [("a/1.go", 0, "file", "a", "a"), ("a/2.go", 0, "file", "a", "a"), ("b/1.go", 0, "file", "b", "b"), ("a/1.go", 1, "dependency", "b", "b"), ("a/2.go", 1, "dependency", "b", "b"), ("b/1.go", 1, "dependency", "a", "a")])
    e = edges(spark, *((f, 0, f, 1, "imports", "certain") for f in ("a/1.go", "a/2.go", "b/1.go")))
    assert said(analyses.import_cycles(s, e)) == [("warning", "circular dependency: a/1.go -> b/1.go")]


def test_classes_can_stand_for_their_files(spark):
    s = symbols(spark, [(f"{n}.java", i, k, m, q) for n, other in (("A", "B"), ("B", "A")) for i, k, m, q in ((0, "file", f"{n}.java", f"{n}.java"), (1, "class", n, f"p.{n}"), (2, "dependency", f"p.{other}", f"p.{other}"))])
    e = edges(spark, *((f, 0, f, 2, "imports", "certain") for f in ("A.java", "B.java")))
    assert analyses.import_cycles(s, e).count() == 0
    assert said(analyses.import_cycles(s, e, classes_as_files=True)) == [("warning", "circular dependency: A.java -> B.java")]


def test_boundaries(spark):
    s, e = imports(spark, ("app/models/u", "app/controllers/c"), ("app/controllers/c", "app/models/u"))
    own = Boundaries(None, {"m": ["app/models/**"], "c": ["app/controllers/**"]}, [("m", "c")])
    assert said(analyses.boundary(s, e, own)) == [("warning", "layer `m` must not import `c` (app/models/u -> app/controllers/c)")]
    assert said(analyses.boundary(s, e, Boundaries("rails"))) == [("warning", "layer `models` must not import `controllers` (app/models/u -> app/controllers/c)")]
    assert analyses.boundary(s, e, Boundaries()).count() == 0


def test_cross_file_calls(spark):
    s = functions(spark, "f", "g", file="a").union(functions(spark, "f", "h", file="b"))
    e = edges(spark, ("a", 1, "b", 1, "calls", "certain"))
    u = spark.createDataFrame([("a", 1, "f"), ("a", 1, "h"), ("a", 1, "f"), ("a", 1, "no"), ("b", 1, "h")], schema.UNRESOLVED)
    got = resolve.cross_file_calls(s, e, u).filter("confidence = 'likely'").select("file", "from_id", "to_file", "to_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, "b", 0)]


def test_promotion(spark):
    s = functions(spark, "f", "g", "g", file="a").union(functions(spark, "h", file="b"))
    e = edges(spark, ("a", 1, "a", 0, "calls", "likely"), ("a", 0, "a", 1, "calls", "likely"), ("a", 0, "b", 0, "calls", "likely"))
    got = {(r.from_id, r.to_file, r.to_id): r.confidence for r in resolve.promote_calls(s, e).collect()}
    assert got == {(1, "a", 0): "certain", (0, "a", 1): "likely", (0, "b", 0): "likely"}


def test_package_imports(spark):
    rows = [("x/a/f.go", 0, "file", "x/a", "x/a"), ("a/f.go", 0, "file", "a", "a"), ("m.go", 1, "dependency", "host/m/x/a", ""), ("m.go", 2, "dependency", "fmt", ""), ("m.go", 3, "dependency", "ba", "")]
    got = resolve.resolve_package_imports(symbols(spark, rows)).filter("kind = 'dependency'")
    assert {r.local_id: r.name for r in got.collect()} == {1: "x/a", 2: "fmt", 3: "ba"}


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a")]
    got = graph.mutual_reach(spark.createDataFrame(pairs, "src string, dst string"))
    assert sorted(map(tuple, got.select("node", "component").collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]


def test_levels_are_ordered(spark):
    rows = spark.createDataFrame([("error",), ("info",), ("warning",)], "s string")
    assert [r.s for r in rows.orderBy(schema.rank(F.col("s"), schema.SEVERITIES)).collect()] == list(schema.SEVERITIES)
