"""A language server: opening or saving a file analyses the workspace and publishes each file's findings."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import IO
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..plans.codegraph import scan
from ..report import diagnostics

# Fixed values of the protocol.
SEVERITY = {"error": 1, "warning": 2, "info": 3}


def analyzer(spark: SparkSession) -> Callable[[str], dict[str, list[dict]]]:
    """Root -> findings by file."""

    def run(root: str) -> dict[str, list[dict]]:
        return {r.file: [i.asDict() for i in r["items"]] for r in diagnostics(scan(spark, root).findings).orderBy("file").toLocalIterator()}

    return run


def uri_to_path(uri: str) -> str:
    return unquote(uri.removeprefix("file://"))


def workspace(params: dict) -> str | None:
    """The first workspace folder, else the root URI, else the root path."""
    folders = params.get("workspaceFolders") or []
    if folders and isinstance(folders[0], dict) and folders[0].get("uri"):
        return uri_to_path(folders[0]["uri"])
    if params.get("rootUri"):
        return uri_to_path(params["rootUri"])
    return params.get("rootPath")


class Server:
    def __init__(self, analyze: Callable[[str], dict[str, list[dict]]]) -> None:
        self.analyze, self.root, self.shown, self.done = analyze, None, set(), False

    def handle(self, message: dict) -> list[dict]:
        """What to send in answer to one message."""
        method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
        match method:
            case "initialize":
                self.root = workspace(params)
                return [{"jsonrpc": "2.0", "id": id_, "result": {"capabilities": {"textDocumentSync": {"openClose": True, "change": 0, "save": True}}, "serverInfo": {"name": "codelake"}}}]
            case "textDocument/didOpen" | "textDocument/didSave":
                return self.publish()
            case "shutdown":
                return [{"jsonrpc": "2.0", "id": id_, "result": None}]
            case "exit":
                self.done = True
        if id_ is not None and method not in (None, "exit"):
            return [{"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": "method not found"}}]
        return []

    def publish(self) -> list[dict]:
        """One notification for each file with findings, and an empty one for each that had some before."""
        if self.root is None:
            return []
        try:
            found = self.analyze(self.root)
        except Exception:  # noqa: BLE001  an analysis that fails shows nothing
            return []
        files, self.shown = sorted(found.keys() | self.shown), set(found)
        return [self._notice(f, found.get(f, [])) for f in files]

    def _notice(self, file: str, items: list[dict]) -> dict:
        spot = lambda i: {"line": max(0, i["start_line"] - 1), "character": 0}
        shown = [{"range": {"start": spot(i), "end": spot(i)}, "severity": SEVERITY[i["severity"]], "source": "codelake", "code": i["rule"], "message": i["message"]} for i in items]
        return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": "file://" + str(Path(self.root, file)), "diagnostics": shown}}


def read_message(source: IO[bytes]) -> dict | None:
    """The next framed message; {} for one that is no JSON object, None at the end."""
    size = None
    while line := source.readline():
        if not line.strip():
            if size is None:
                continue
            body = source.read(size)
            if len(body) < size:
                return None
            try:
                message = json.loads(body)
            except ValueError:
                return {}
            return message if isinstance(message, dict) else {}
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length" and value.strip().isdigit():
            size = int(value)
    return None


def write_message(sink: IO[bytes], message: dict) -> None:
    body = json.dumps(message).encode()
    sink.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    sink.flush()


def serve(source: IO[bytes], sink: IO[bytes], analyze: Callable[[str], dict[str, list[dict]]]) -> None:
    server = Server(analyze)
    while not server.done and (message := read_message(source)) is not None:
        for answer in server.handle(message):
            write_message(sink, answer)
