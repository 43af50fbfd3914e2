"""SARIF of many findings: the rules by aggregation, the results one at a time."""

import json
import os

import pytest

from codelake import __main__ as cli
from codelake import report, testbed
from codelake.plans.codegraph import scan
from codelake.schema import FINDINGS, RULES

DATA = "/root/testdata/sf0.001"


def finding(rule, order, file="f", start=0, message="m"):
    return (rule, "info", message, file, start, start + 1, 0, "certain", order)


def whole(found):
    """The document rendered at once."""
    level = {"error": "error", "warning": "warning", "info": "note"}
    results = [
        {"ruleId": f["rule"], "level": level[f["severity"]], "message": {"text": f["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["span"]["file"]}, "region": {"startLine": max(1, f["span"]["start_line"])}}}]}
        for f in found
    ]
    rules = [{"id": r, "shortDescription": {"text": report.DESCRIPTIONS.get(r, r)}} for r in dict.fromkeys(f["rule"] for f in found)]
    run = {"tool": {"driver": {"name": "codelake", "version": "0.1.0", "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_the_query_brings_rules_not_findings_to_the_driver(spark, monkeypatch):
    kind, collected = type(spark.range(0)), []
    plain = kind.collect

    def collect(df):
        out = plain(df)
        collected.append(len(out))
        return out

    def stream(*a, **k):
        raise AssertionError("findings are streamed to the driver")

    monkeypatch.setattr(kind, "collect", collect)
    monkeypatch.setattr(kind, "toLocalIterator", stream)
    t = testbed.Tables(spark, DATA)
    got = testbed.sarif_rules_first_seen(t)
    assert collected and max(collected) <= len(RULES)
    assert testbed.every_finding(t).count() > 100 * max(collected)
    assert [(r.rule, r.place) for r in plain(got)] == [(r, RULES.index(r)) for r in RULES if r in {x.rule for x in plain(got)}]


@pytest.mark.parametrize(
    "found",
    [
        [],
        [finding("boundary", "a"), finding("dead_code", "z"), finding("complexity", "b"), finding("dead_code", "a")],
        [finding("zeta", "a"), finding("alpha", "b"), finding("dead_code", "0"), finding("alpha", "c")],
        [finding("zeta", "a", "g"), finding("alpha", "a", "f", 9), finding("mid", "a", "f", 3)],
        [finding("zeta", None), finding("alpha", "a"), finding("mid", "a", None)],
    ],
)
def test_rules_are_in_the_order_of_the_report(spark, found):
    df = spark.createDataFrame(found, FINDINGS).repartition(3)
    assert report.rules_seen(df) == list(dict.fromkeys(f["rule"] for f in report.rows(df)))


def test_pieces_make_the_whole_document(spark):
    found = [finding("cycle", "a", "é.py", 3, "a\n\"b\" \x85\u2028[]"), finding("complexity", "b", message=""), finding("cycle", "c", "[]")]
    for some in (found, found[:1], []):
        rows = report.rows(spark.createDataFrame(some, FINDINGS))
        if not some:
            assert json.loads(report.sarif(rows))["runs"][0]["results"] == []
        assert report.sarif(rows) == "".join(report.sarif_pieces(list(dict.fromkeys(f["rule"] for f in rows)), iter(rows))) == whole(rows)


def test_pieces_hold_one_finding():
    taken = []

    def endless():
        while True:
            taken.append(1)
            yield {"rule": "cycle", "severity": "warning", "message": "m", "span": {"file": "f", "start_line": 1}}

    pieces = report.sarif_pieces(["cycle"], endless())
    for _ in range(5):
        next(pieces)
    assert len(taken) == 4


def test_command_line_prints_the_same(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("import b\n\n\ndef lost():\n    return 1\n")
    (tmp_path / "b.py").write_text("import a\n\n\ndef gone():\n    return 2\n")
    rows = report.rows(scan(spark, str(tmp_path)).findings)
    assert cli.main(["check", str(tmp_path), "--format", "sarif"]) == 0
    assert rows and capsys.readouterr().out == whole(rows) + "\n"
