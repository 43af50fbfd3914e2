"""Command line: ``python -m codelake check [path]``, ``mcp``, ``lsp``."""

from __future__ import annotations

import argparse
import os
import sys

from .metrics import emit, headers, service_name
from .plans.codegraph import scan
from .report import as_json, each, gate, human, rows, rules_seen, sarif_pieces
from .serve import lsp, mcp
from .session import get_spark
from .sources.git import origin


def check(args: argparse.Namespace) -> int:
    if not os.path.isdir(args.path):
        print(f"error: no such folder: {args.path}", file=sys.stderr)
        return 1
    spark = get_spark()
    done = scan(spark, args.path)
    if args.format == "sarif":
        sys.stdout.writelines(sarif_pieces(rules_seen(done.findings), each(done.findings)))
        print()
    else:
        print({"human": human, "json": as_json}[args.format](rows(done.findings)), end="" if args.format == "human" else "\n")
    if args.otlp_endpoint:
        where = origin(spark, args.path)
        emit(done, args.otlp_endpoint, service_name(args.project, args.path, where["repo"]), where, headers(spark, os.environ.get("OTEL_EXPORTER_OTLP_HEADERS")))
    return int(gate(done.findings, None if args.fail_on == "never" else args.fail_on))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codelake", description="Findings in source trees, on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("check", help="analyse a tree and print its findings")
    one.add_argument("path", nargs="?", default=".")
    one.add_argument("--format", choices=("human", "json", "sarif"), default="human")
    one.add_argument("--fail-on", choices=("never", "info", "warning", "error"), default="never")
    one.add_argument("--otlp-endpoint")
    one.add_argument("--project")
    commands.add_parser("mcp", help="serve the analysis as a tool, JSON lines on stdin and stdout")
    commands.add_parser("lsp", help="serve diagnostics to an editor on stdin and stdout")
    args = parser.parse_args(argv)
    if args.command == "mcp":
        mcp.serve(sys.stdin, sys.stdout, mcp.analyzer(get_spark()))
    elif args.command == "lsp":
        lsp.serve(sys.stdin.buffer, sys.stdout.buffer, lsp.analyzer(get_spark()))
    else:
        return check(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
