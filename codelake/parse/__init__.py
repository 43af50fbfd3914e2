"""Parsers: one function (file, source) -> Parsed for each language."""

from __future__ import annotations

from collections.abc import Callable

from . import go, java, python, ruby, rust, typescript
from .model import Parsed

PARSERS: dict[str, Callable[[str, str], Parsed]] = {"java": java.parse, "ruby": ruby.parse, "typescript": typescript.parse, "python": python.parse, "go": go.parse, "rust": rust.parse}
