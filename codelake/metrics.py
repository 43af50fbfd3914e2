"""Gauges and a run event of a scan, and their best-effort delivery as OTLP over HTTP."""

from __future__ import annotations

import json
import os
import sys
import time
import urllib.request

from pyspark.sql import functions as F

from .functions.text import header_map
from .plans.codegraph import Scan
from .report import metrics, totals
from .schema import SEVERITIES

PREFIX = "codelake"


def points(scan: Scan) -> list[dict]:
    """The findings' gauge by rule, severity, language and confidence, and one gauge for each number of the scan."""
    grouped = [{"name": f"{PREFIX}.findings", "value": float(r.value), "attributes": {"rule": r.rule, "severity": r.severity, "language": r.language, "confidence": r.confidence}} for r in metrics(scan.findings, scan.graph.files).toLocalIterator()]
    s, by = scan.stats, _totals(scan)
    rule = lambda name: by.get((name, None), 0)
    single = {"cycles": rule("cycle"), "boundary_violations": rule("boundary"), "duplication.regions": rule("duplication"), "complexity.max": s["cx_max"], "complexity.mean": s["cx_mean"], "files_scanned": s["files"], "functions": s["functions"], "scan.duration_ms": s["duration_ms"]}
    return grouped + [{"name": f"{PREFIX}.{k}", "value": float(v), "attributes": {}} for k, v in single.items()]


def _totals(scan: Scan) -> dict[tuple[str | None, str | None], int]:
    found = {(r.rule, r.severity): r.value for r in totals(scan.findings).collect()}  # a row for each rule and severity
    return {(None, None): 0} | found


def run_event(scan: Scan, origin: dict) -> dict:
    """Body and attributes of one scan."""
    by = _totals(scan)
    attributes: dict[str, object] = {"findings.total": by[None, None], "languages": ",".join(scan.stats["languages"])}
    attributes |= {f"findings.severity.{s}": by.get((None, s), 0) for s in SEVERITIES} | {f"findings.rule.{r}": n for (r, s), n in sorted(by.items(), key=str) if r and not s}
    attributes |= {k: v for k, v in origin.items() if v}
    return {"body": f"scan: {by[None, None]} finding(s)", "attributes": attributes}


def service_name(flag: str | None, root: str, repo: str | None) -> str:
    return flag or os.environ.get("OTEL_SERVICE_NAME") or repo or os.path.basename(os.path.abspath(root)) or PREFIX


def headers(spark, text: str | None) -> dict[str, str]:
    return dict(spark.range(1).select(header_map(F.lit(text)).alias("m")).first().m) if text else {}


def emit(scan: Scan, endpoint: str, service: str, origin: dict, head: dict[str, str], timeout: float = 5.0) -> bool:
    """Post metrics and the event; a failure is told on stderr and changes nothing else."""
    value = lambda v: {"intValue": str(v)} if isinstance(v, int) else {"stringValue": str(v)}
    pairs = lambda d: [{"key": k, "value": value(v)} for k, v in d.items()]
    now, resource = str(time.time_ns()), {"attributes": pairs({"service.name": service} | {f"vcs.{k}": v for k, v in origin.items() if v})}
    gauges: dict[str, list] = {}
    for p in points(scan):
        gauges.setdefault(p["name"], []).append({"asDouble": p["value"], "timeUnixNano": now, "attributes": pairs(p["attributes"])})
    event = run_event(scan, origin)
    bodies = {
        "metrics": {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"scope": {"name": PREFIX}, "metrics": [{"name": n, "gauge": {"dataPoints": d}} for n, d in gauges.items()]}]}]},
        "logs": {"resourceLogs": [{"resource": resource, "scopeLogs": [{"scope": {"name": PREFIX}, "logRecords": [{"timeUnixNano": now, "severityText": "INFO", "body": {"stringValue": event["body"]}, "attributes": pairs(event["attributes"])}]}]}]},
    }
    try:
        for kind, body in bodies.items():
            request = urllib.request.Request(f"{endpoint.rstrip('/')}/v1/{kind}", json.dumps(body).encode(), {"Content-Type": "application/json", **head})  # noqa: S310
            urllib.request.urlopen(request, timeout=timeout).close()  # noqa: S310
    except (OSError, ValueError) as e:
        print(f"warning: telemetry was not sent: {e}", file=sys.stderr)
        return False
    return True
