"""A tool server over lines of JSON-RPC: one tool that analyses a tree."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import SparkSession

from ..plans.codegraph import scan
from ..report import as_json, by_rule, rows
from ..schema import RULES

PROTOCOL = "2024-11-05"
VERSION = "0.1.0"
TOOL = {
    "name": "analyze",
    "description": "Find dead code, duplication, complexity, hotspots, import cycles and layer violations in a source tree; each finding has a severity and a confidence.",
    "inputSchema": {
        "type": "object",
        "properties": {"path": {"type": "string", "description": "Folder to analyse."}, "rule": {"type": "string", "description": "Only findings of this rule: " + ", ".join(RULES) + "."}},
        "required": ["path"],
    },
}


def analyzer(spark: SparkSession) -> Callable[[str, str | None], str]:
    return lambda path, rule: as_json(rows(by_rule(scan(spark, path).findings, rule)))


def handle(request: object, analyze: Callable[[str, str | None], str]) -> dict | None:
    """The response to one request; None for notifications and what is no request."""
    if not isinstance(request, dict) or request.get("id") is None and "id" not in request:
        return None
    params = request.get("params") if isinstance(request.get("params"), dict) else {}
    answer = lambda **x: {"jsonrpc": "2.0", "id": request["id"], **x}
    content = lambda text, failed: answer(result={"content": [{"type": "text", "text": text}], "isError": failed})
    match request.get("method"):
        case "initialize":
            return answer(result={"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "codelake", "version": VERSION}})
        case "tools/list":
            return answer(result={"tools": [TOOL]})
        case "tools/call":
            args = params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
            if params.get("name") != TOOL["name"]:
                return content(f"unknown tool `{params.get('name', '')}`", True)
            if not isinstance(args.get("path"), str):
                return content("missing required argument `path`", True)
            try:
                return content(analyze(args["path"], args.get("rule") if isinstance(args.get("rule"), str) else None), False)
            except Exception as e:  # noqa: BLE001  a failed analysis is the tool's answer
                return content(f"analysis failed: {e}", True)
    return answer(error={"code": -32601, "message": "method not found"})


def serve(source: IO[str], sink: IO[str], analyze: Callable[[str, str | None], str]) -> None:
    """Answer line by line until the input ends; lines that are no JSON are passed over."""
    for line in source:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if (response := handle(request, analyze)) is not None:
            sink.write(json.dumps(response) + "\n")
            sink.flush()
