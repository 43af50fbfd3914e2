"""Whole trees: scan, configuration, git, renderers, gate, servers."""

import io
import json
import subprocess

import pytest

from codelake import __main__ as cli
from codelake import metrics, report
from codelake.config import Boundaries, load_config
from codelake.functions.globs import any_glob, glob_to_regex
from codelake.functions.text import header_map, language_of, remote_parts
from codelake.plans.codegraph import merge, parse_files, scan
from codelake.serve import lsp, mcp
from codelake.sources.git import churn, origin
from codelake.sources.repo import list_files, read_repo
from codelake.streaming.watch import watch
from pyspark.sql import functions as F


def tree(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def messages(spark, root):
    return {(r.rule, r.severity, r.message) for r in scan(spark, root).findings.collect()}


GNARLY = "def classify(n)\n  if n == 0\n    0\n" + "".join(f"  elsif n == {i}\n    {i}\n" for i in range(1, 10)) + "  end\nend\n"
LONG = "\n".join(f"  total{i} = first{i} + second{i} * {i}" for i in range(20))


def test_one_tree_of_everything(spark, tmp_path):
    root = tree(tmp_path, {
        "App.java": "class App { public static void main(String[] a) { helper(); } static void helper() {} void neverCalled() {} }",
        "a/one.rb": f"require_relative 'two'\ndef one\n{LONG}\nend\none\nfar_away\n",
        "a/two.rb": f"require_relative 'one'\ndef two\n{LONG.replace('total', 'sum')}\nend\ndef far_away; end\n",
        "gnarly.rb": GNARLY,
        "go/a/a.go": 'package a\nimport "host/go/b"\nfunc Exported() { inner() }\nfunc inner() {}\nfunc lost() {}\n',
        "go/b/b.go": 'package b\nimport "host/go/a"\n',
        "go/b/c.go": "package b\n",
        "skip/x.rb": "def ignored; end\n",
        "deep/vendor/y.rb": "def vendored; end\n",
        "bad.py": b"\xff\xfe",
        ".hidden/z.rb": "def hidden; end\n",
        "notes.txt": "def none",
        "codelake.toml": '[ignore]\npaths = ["skip/**", "**/vendor/**"]\n[layers]\nlow = ["go/b/**"]\nhigh = ["go/a/**"]\n[[forbid]]\nfrom = "low"\nto = "high"\n',
    })
    done = scan(spark, root)
    found = {(r.rule, r.severity, r.message) for r in done.findings.collect()}
    text = " ".join(m for _, _, m in found)
    assert ("dead_code", "warning", "unused function `neverCalled`") in found
    assert ("dead_code", "info", "possibly unused function `far_away`") in found
    assert ("dead_code", "warning", "unused function `lost`") in found
    assert not any(x in text for x in ("`helper`", "`one`", "`Exported`", "`inner`", "ignored", "vendored", "hidden"))
    assert ("duplication", "warning", "duplicated code block (>= 100 tokens) also at a/two.rb:3") in found or any(r == "duplication" for r, _, _ in found)
    assert ("complexity", "info", "function `classify` has high cyclomatic complexity (11)") in found
    assert {m for r, _, m in found if r == "cycle"} == {"circular dependency: a/one.rb -> a/two.rb", "circular dependency: go/a/a.go -> go/b/b.go"}
    assert ("boundary", "warning", "layer `low` must not import `high` (go/b/b.go -> go/a/a.go)") in found
    assert [r.file for r in done.graph.errors.collect()] == ["bad.py"]
    assert done.stats["files"] == 7 and done.stats["cx_max"] == 11 and done.stats["languages"] == ["go", "java", "python", "ruby"]
    rows = report.rows(done.findings)
    assert [r["rule"] for r in rows] == sorted((r["rule"] for r in rows), key=report.RULES.index)
    assert report.human(rows).endswith(f"\n{len(rows)} finding(s).\n") and "warn  App.java:1  unused" in report.human(rows)
    doc = json.loads(report.sarif(rows))["runs"][0]
    assert [r["id"] for r in doc["tool"]["driver"]["rules"]] == list(dict.fromkeys(r["rule"] for r in rows))
    assert doc["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1}
    assert json.loads(report.as_json(rows)) == {"schema_version": 1, "findings": rows}
    assert report.gate(done.findings, "warning") and not report.gate(done.findings, "error") and not report.gate(done.findings, None)
    points = {(p["name"], p["attributes"].get("rule")): p["value"] for p in metrics.points(done)}
    assert points["codelake.cycles", None] == 2 and points["codelake.files_scanned", None] == 7
    event = metrics.run_event(done, {"commit": "c", "branch": None})
    assert event["attributes"]["findings.total"] == len(rows) and event["attributes"]["commit"] == "c"
    assert metrics.emit(done, "http://127.0.0.1:9", "s", {}, {}, timeout=0.2) is False
    both = merge(done.graph, done.graph)
    assert both.symbols.count() == 2 * done.graph.symbols.count()


def test_empty_and_missing_trees(spark, tmp_path):
    assert messages(spark, str(tmp_path)) == set()
    assert report.human([]) == "No findings.\n"
    with pytest.raises(FileNotFoundError):
        read_repo(spark, str(tmp_path / "none"))
    assert cli.main(["check", str(tmp_path / "none")]) == 1


def test_hotspot_from_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q", "-b", "trunk")
    body = GNARLY.replace("  elsif n == 9\n    9\n", "")
    for i in range(6):
        tree(tmp_path, {"sub/gnarly.rb": body + f"# {i}\n", "sub/é.rb": f"# {i}\n", ".gitignore": "out/\n*.gen.rb\n!keep.gen.rb\n", "out/a.rb": "", "x.gen.rb": "", "keep.gen.rb": ""})
        git("add", "-A", "-f", "sub", ".gitignore")
        git("commit", "-q", "-m", "c", "--allow-empty")
    git("remote", "add", "origin", "git@host:org/team/repo.git")
    assert ("hotspot", "info", "hotspot: `classify` complexity 10 x churn 6 = 60") in messages(spark, str(tmp_path))
    assert {r.file: r.commits for r in churn(spark, str(tmp_path / "sub")).collect()} == {"gnarly.rb": 6, "é.rb": 6}
    assert [p for p, _ in list_files(str(tmp_path), [])] == ["keep.gen.rb", "sub/gnarly.rb", "sub/é.rb"]
    o = origin(spark, str(tmp_path))
    assert (o["branch"], o["namespace"], o["repo"]) == ("trunk", "team", "repo") and len(o["commit"]) == 40


def test_no_git_gives_nothing(spark, tmp_path):
    assert churn(spark, str(tmp_path)).count() == 0
    assert origin(spark, str(tmp_path)) == {"commit": None, "branch": None, "namespace": None, "repo": None}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", ([], 100, Boundaries())),
        ("not toml [", ([], 100, Boundaries())),
        ('[ignore]\npaths = ["a"]\n[duplication]\nmin_tokens = 7\n', (["a"], 7, Boundaries())),
        ('preset = "rails"\n[ignore]\npaths = 3\n[duplication]\nmin_tokens = "x"\n', ([], 100, Boundaries("rails"))),
        ('[layers]\na = ["x"]\n[[forbid]]\nfrom = "a"\nto = "b"\n', ([], 100, Boundaries(None, {"a": ["x"]}, [("a", "b")]))),
    ],
)
def test_config(tmp_path, text, expected):
    c = load_config(tree(tmp_path, {"codelake.toml": text}))
    assert (c.ignore, c.min_tokens, c.boundaries) == expected


def test_presets(tmp_path):
    assert load_config(tree(tmp_path / "r", {"config/routes.rb": ""})).boundaries.preset == "rails"
    assert load_config(tree(tmp_path / "j", {"pom.xml": ""})).boundaries.preset == "layered"
    assert load_config(tree(tmp_path / "n", {"x": ""})).boundaries.preset is None
    mixed = Boundaries("rails", {"models": ["m/**"], "new": ["n"]}, [("new", "models")]).resolved()
    assert mixed.layers["models"] == ["m/**"] and mixed.layers["views"] == ["app/views/**"] and mixed.forbid[-1] == ("new", "models") and len(mixed.forbid) == 4
    assert Boundaries("none", {"a": []}).resolved() == Boundaries("none", {"a": []})


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("tests/**", ["tests/a/b.rs"], ["src/main.rs", "tests"]),
        ("**/vendor/**", ["vendor/a", "a/b/vendor/c"], ["vendor"]),
        ("*.rb", ["a.rb"], ["d/a.rb"]),
        ("a/{b,c}?.x", ["a/b1.x", "a/cz.x"], ["a/b.x", "a/d1.x"]),
        ("[!a]b", ["xb"], ["ab"]),
    ],
)
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in rows.filter(any_glob(F.col("p"), [glob])).collect()} == set(yes)


def test_malformed_globs_match_nothing(spark):
    assert glob_to_regex("[a") is None and glob_to_regex("{a") is None
    assert spark.range(1).filter(any_glob(F.lit("[a"), ["[a"])).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(header_map(F.lit("a=1, b = x=y ,bad,a=2"))) == {"a": "2", "b": "x=y"}
    assert one(header_map(F.lit(None).cast("string"))) == {}
    for url, want in {"https://h.com/org/repo.git": ("org", "repo"), "git@h:org/repo": ("org", "repo"), "https://h.com/repo": (None, "repo"), "": (None, None)}.items():
        assert tuple(one(remote_parts(F.lit(url)))) == want
    assert one(language_of(F.lit("a.b/c.tsx"))) == "typescript" and one(language_of(F.lit("a.ts/none"))) is None


def test_exit_codes(spark, tmp_path, capsys):
    root = tree(tmp_path, {"a.rb": "def lost; end\n"})
    assert cli.main(["check", root]) == 0
    plain = capsys.readouterr().out
    assert cli.main(["check", root, "--fail-on", "warning", "--otlp-endpoint", "http://127.0.0.1:9"]) == 1
    again = capsys.readouterr()
    assert again.out == plain and "warning: telemetry" in again.err
    assert cli.main(["check", root, "--fail-on", "error", "--format", "json"]) == 0


def test_telemetry_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = {}

    class Sink(BaseHTTPRequestHandler):
        def do_POST(self):
            seen[self.path] = (json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["X-Key"])
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Sink)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    done = scan(spark, tree(tmp_path, {"a.rb": "def lost; end\n", "b.go": "package b\n"}))
    assert metrics.emit(done, f"http://127.0.0.1:{server.server_port}/", "svc", {"commit": "c", "branch": None}, metrics.headers(spark, "X-Key=1"))
    server.shutdown()
    body, key = seen["/v1/metrics"]
    resource = body["resourceMetrics"][0]
    assert key == "1" and {"key": "service.name", "value": {"stringValue": "svc"}} in resource["resource"]["attributes"]
    gauges = {m["name"]: m["gauge"]["dataPoints"] for m in resource["scopeMetrics"][0]["metrics"]}
    assert gauges["codelake.findings"][0]["asDouble"] == 1 and {"key": "language", "value": {"stringValue": "ruby"}} in gauges["codelake.findings"][0]["attributes"]
    record = seen["/v1/logs"][0]["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert {"key": "findings.severity.warning", "value": {"intValue": "1"}} in record["attributes"] and {"key": "languages", "value": {"stringValue": "go,ruby"}} in record["attributes"]


def test_service_names(monkeypatch):
    monkeypatch.delenv("OTEL_SERVICE_NAME", raising=False)
    assert metrics.service_name("flag", "/x/dir", "repo") == "flag" and metrics.service_name(None, "/x/dir", "repo") == "repo" and metrics.service_name(None, "/x/dir", None) == "dir"
    monkeypatch.setenv("OTEL_SERVICE_NAME", "env")
    assert metrics.service_name(None, "/x/dir", "repo") == "env"


def test_tool_server():
    ask = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "v"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
           {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "analyze", "arguments": {"path": "p", "rule": "cycle"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "no"}},
           {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "analyze"}}, {"jsonrpc": "2.0", "id": 6, "method": "nope"}, {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "analyze", "arguments": {"path": "bad"}}}]
    source, sink = io.StringIO("not json\n" + "".join(json.dumps(a) + "\n" for a in ask)), io.StringIO()

    def analyze(path, rule):
        if path == "bad":
            raise OSError("gone")
        return f"{path}:{rule}"

    mcp.serve(source, sink, analyze)
    got = {r["id"]: r for r in map(json.loads, sink.getvalue().splitlines())}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert got[1]["result"]["protocolVersion"] == "v" and got[2]["result"]["tools"][0]["name"] == "analyze"
    assert got[3]["result"] == {"content": [{"type": "text", "text": "p:cycle"}], "isError": False}
    assert got[4]["result"]["isError"] and got[5]["result"]["isError"] and got[7]["result"]["isError"] and got[6]["error"]["code"] == -32601


def test_language_server():
    found = [{"a.rb": [{"rule": "dead_code", "severity": "info", "message": "m", "start_line": 3}]}, {}]
    sent = [{"id": 1, "method": "initialize", "params": {"workspaceFolders": [{"uri": "file:///w%20s"}]}}, {"method": "initialized"}, {"method": "textDocument/didOpen"}, {"method": "textDocument/didSave"}, {"id": 2, "method": "what"}, {"id": 3, "method": "shutdown"}, {"method": "exit"}, {"id": 4, "method": "initialize"}]
    source, sink = io.BytesIO(), io.BytesIO()
    for m in sent:
        lsp.write_message(source, m)
    source.seek(0)
    lsp.serve(source, sink, lambda root: found.pop(0))
    sink.seek(0)
    got = []
    while (m := lsp.read_message(sink)) is not None:
        got.append(m)
    assert got[0]["result"]["capabilities"]["textDocumentSync"]["save"] is True
    notice = got[1]["params"]
    assert notice["uri"] == "file:///w s/a.rb" and notice["diagnostics"][0]["range"]["start"]["line"] == 2 and notice["diagnostics"][0]["severity"] == 3
    assert got[2]["params"] == {"uri": "file:///w s/a.rb", "diagnostics": []}
    assert got[3]["error"]["code"] == -32601 and got[4]["result"] is None and len(got) == 5


def test_servers_on_a_tree(spark, tmp_path):
    root = tree(tmp_path, {"a.rb": "def lost; end\n"})
    assert [f["rule"] for f in json.loads(mcp.analyzer(spark)(root, "dead_code"))["findings"]] == ["dead_code"]
    assert json.loads(mcp.analyzer(spark)(root, "cycle"))["findings"] == []
    assert [i["message"] for i in lsp.analyzer(spark)(root)["a.rb"]] == ["unused function `lost`"]


def test_stream_of_trees(spark, tmp_path):
    root = tree(tmp_path / "t", {"a.rb": "def lost; end\n"})
    spark.createDataFrame([(root,)], "root string").write.parquet(str(tmp_path / "in"))
    watch(spark.readStream.schema("root string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.root, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).select("root", "rule").collect()] == [(root, "dead_code")]


def test_parsed_tables_are_views(spark, tmp_path):
    graph = parse_files(read_repo(spark, tree(tmp_path, {"a.rb": "def f; end\nf\n"})))
    graph.views()
    assert spark.sql("select s.name from symbols s join edges e on e.file = s.file and e.to_id = s.local_id where e.kind = 'calls'").collect()[0].name == "f"
