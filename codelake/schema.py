"""Tables of the code graph, ranks of its ordered values, and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "file string, lang string, size long, content binary"
SYMBOLS = "file string, local_id int, kind string, name string, fqn string, start_byte long, end_byte long, start_line int, visibility string, confidence string"
EDGES = "file string, from_id int, to_file string, to_id int, kind string, confidence string, edge_ord int"
ENTRYPOINTS = "file string, local_id int"
COMPLEXITY = "file string, local_id int, cx long"
UNRESOLVED = "file string, from_id int, callee string"
TOKENS = "file string, pos int, start_byte long, end_byte long, start_line int, norm string"
FINDINGS = "rule string, severity string, message string, file string, start_byte long, end_byte long, start_line int, confidence string, ord string"
CHURN = "file string, commits long"

# Names of kinds and levels, lowest level first.
SYMBOL_KINDS = ("file", "module", "class", "function", "constant", "dependency")
EDGE_KINDS = ("defines", "calls", "imports", "inherits", "references")
VISIBILITIES = ("public", "private", "unknown")
CONFIDENCES = ("unknown", "likely", "certain")
SEVERITIES = ("info", "warning", "error")
RULES = ("dead_code", "duplication", "complexity", "hotspot", "cycle", "boundary")
LANGUAGES = {"java": "java", "rb": "ruby", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "pyi": "python", "go": "go", "rs": "rust"}

# Defaults of a scan.
MIN_TOKENS = 100
COMPLEXITY_THRESHOLD = 10
HOTSPOT_THRESHOLD = 50
HOTSPOT_FLOOR = 10
UINT32 = 4294967295
SCHEMA_VERSION = 1


def rank(value: Column, levels: tuple[str, ...]) -> Column:
    """Place of a level in its order, from 0."""
    return F.array_position(F.array(*map(F.lit, levels)), value).cast("int") - 1


def finding(rule: str, severity: Column | str, message: Column, confidence: Column | str, order: Column, **span: Column | str) -> list[Column]:
    """The columns of a finding; ``order`` sorts findings within their rule."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    where = {c: F.col(c) for c in ("file", "start_byte", "end_byte", "start_line")} | span
    return [
        F.lit(rule).alias("rule"), text(severity).alias("severity"), message.alias("message"), where["file"].alias("file"),
        where["start_byte"].cast("long").alias("start_byte"), where["end_byte"].cast("long").alias("end_byte"), where["start_line"].cast("int").alias("start_line"),
        text(confidence).alias("confidence"), order.cast("string").alias("ord"),
    ]


def place(file: str = "file", local_id: str = "local_id") -> Column:
    """A sortable string of (file, id)."""
    return F.concat_ws("\x00", F.col(file), F.lpad(F.col(local_id).cast("string"), 10, "0"))
