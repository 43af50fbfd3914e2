"""Findings joined, sorted, gated, measured and rendered."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import RULES, SCHEMA_VERSION, SEVERITIES, rank


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def by_rule(findings: DataFrame, rule: str | None) -> DataFrame:
    """One rule's findings; each analysis carries its rule as a constant, so the others are pruned from the plan."""
    return findings if rule is None else findings.filter(F.col("rule") == rule)


def in_order(findings: DataFrame) -> DataFrame:
    """By rule in the order of the analyses, then as each rule sorts its own."""
    return findings.orderBy(rank(F.col("rule"), RULES), "ord", "file", "start_byte")


def gate(findings: DataFrame, threshold: str | None) -> bool:
    """Whether a finding reaches the threshold; None never does."""
    if threshold is None:
        return False
    return not findings.filter(rank(F.col("severity"), SEVERITIES) >= SEVERITIES.index(threshold)).isEmpty()


def scan_stats(symbols: DataFrame, complexity: DataFrame, languages: DataFrame) -> DataFrame:
    """One row: files, functions, largest and mean complexity (0 without any), sorted languages."""
    counts = symbols.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "function").alias("functions"))
    cx = complexity.agg(F.coalesce(F.max("cx"), F.lit(0)).cast("long").alias("cx_max"), F.coalesce(F.avg("cx"), F.lit(0.0)).alias("cx_mean"))
    langs = languages.filter("lang is not null").agg(F.array_sort(F.collect_set("lang")).alias("languages"))  # as many as there are languages
    return counts.crossJoin(cx).crossJoin(langs)  # one row each


def metrics(findings: DataFrame, languages: DataFrame) -> DataFrame:
    """Findings by (rule, severity, language, confidence); ``languages`` is (file, lang)."""
    rows = findings.join(languages, "file", "left").withColumn("language", F.coalesce("lang", F.lit("unknown")))
    return rows.groupBy("rule", "severity", "language", "confidence").agg(F.count(F.lit(1)).alias("value"))


def totals(findings: DataFrame) -> DataFrame:
    """Totals overall, by severity and by rule in one pass: (rule, severity, value), null meaning all."""
    view = findings.select("rule", "severity")
    return view.groupingSets([[F.col("rule")], [F.col("severity")], []], "rule", "severity").agg(F.count(F.lit(1)).alias("value"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """(file, items): the findings of each file, in order, as an editor wants them."""
    item = F.struct((rank(F.col("rule"), RULES)).alias("rank"), "ord", "rule", "severity", "message", "start_line")
    return findings.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))


def each(findings: DataFrame) -> Iterator[dict]:
    """The report's findings in order, a partition at a time on the driver."""
    for r in in_order(findings).toLocalIterator():
        yield {"rule": r.rule, "severity": r.severity, "message": r.message, "span": {"file": r.file, "start_byte": r.start_byte, "end_byte": r.end_byte, "start_line": r.start_line}, "confidence": r.confidence}


def rows(findings: DataFrame) -> list[dict]:
    """The report's findings on the driver, in order."""
    return list(each(findings))


def rules_seen(findings: DataFrame) -> list[str]:
    """The rules of the findings as ``in_order`` first shows them; of each rule only its first place reaches the driver."""
    first = F.min(F.struct(rank(F.col("rule"), RULES).alias("rank"), "ord", "file", "start_byte")).alias("first")
    return [r.rule for r in findings.groupBy("rule").agg(first).orderBy("first", "rule").collect()]


def human(found: list[dict]) -> str:
    """A line for each finding and their number."""
    if not found:
        return "No findings.\n"
    label = {"error": "error", "warning": "warn", "info": "info"}
    lines = [f"{label[f['severity']]:<5} {f['span']['file']}:{f['span']['start_line']}  {f['message']}\n" for f in found]
    return "".join(lines) + f"\n{len(found)} finding(s).\n"


def as_json(found: list[dict]) -> str:
    return json.dumps({"schema_version": SCHEMA_VERSION, "findings": found}, indent=2, ensure_ascii=False)


# What a rule finds, as shown by viewers of SARIF.
DESCRIPTIONS = {
    "dead_code": "Functions that no entrypoint reaches",
    "duplication": "Duplicated code blocks",
    "complexity": "Functions with high cyclomatic complexity",
    "hotspot": "Complex functions in often changed files",
    "cycle": "Circular dependencies",
    "boundary": "Imports across forbidden layer boundaries",
}


def sarif_tool(rules: list[str], version: str = "0.1.0") -> dict:
    """The tool of a SARIF run, with the rules it names."""
    return {"driver": {"name": "codelake", "version": version, "rules": [{"id": r, "shortDescription": {"text": DESCRIPTIONS.get(r, r)}} for r in rules]}}


def sarif_pieces(rules: list[str], found: Iterable[dict], version: str = "0.1.0") -> Iterator[str]:
    """SARIF 2.1.0 piece by piece, a finding at a time: however many there are, none is kept."""
    level = {"error": "error", "warning": "warning", "info": "note"}
    text = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    frame = text({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": sarif_tool(rules, version), "results": []}]})
    head, tail = frame.rsplit("[]", 1)
    yield head + "["
    end = "]"
    for f in found:
        result = {
            "ruleId": f["rule"], "level": level[f["severity"]], "message": {"text": f["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["span"]["file"]}, "region": {"startLine": max(1, f["span"]["start_line"])}}}],
        }
        yield ("," if end != "]" else "") + f"\n{text(result)}".replace("\n", "\n" + 8 * " ")
        end = "\n" + 6 * " " + "]"
    yield end + tail


def sarif(found: list[dict], version: str = "0.1.0") -> str:
    """SARIF 2.1.0 with the rules in first-seen order."""
    return "".join(sarif_pieces(list(dict.fromkeys(f["rule"] for f in found)), found, version))
