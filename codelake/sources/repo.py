"""Source trees as a Spark data source: files are listed and filtered first, and only those kept are read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import glob_to_regex
from ..schema import FILES, LANGUAGES

CHUNK_BYTES = 8 << 20
"""Source bytes that one task reads."""


def gitignore_rules(folder: str, text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(expression over root-relative paths, folders only, negated) of one ignore file in ``folder``."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        if "/" in line:
            line = line.lstrip("/")
        else:
            line = f"**/{line}"
        pattern = glob_to_regex(f"{folder}/{line}" if folder else line)
        if pattern:
            rules.append((re.compile(pattern), only_folders, negated))
    return rules


def _ignored(path: str, is_folder: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """The last rule that fits decides."""
    out = False
    for pattern, only_folders, negated in rules:
        if (is_folder or not only_folders) and pattern.match(path):
            out = not negated
    return out


def in_git(root: str) -> bool:
    return any((p / ".git").exists() for p in [Path(root).resolve(), *Path(root).resolve().parents])


def list_files(root: str, ignore: list[str]) -> list[tuple[str, int]]:
    """(root-relative path, size) of the tree's files of known endings: no hidden ones, none that git or the globs ignore."""
    skip = [re.compile(p) for g in ignore if (p := glob_to_regex(g))]
    use_git, found = in_git(root), []
    rules_of: dict[str, list] = {}
    for at, folders, names in os.walk(root):
        here = os.path.relpath(at, root).replace(os.sep, "/")
        here = "" if here == "." else here
        rules = list(rules_of.get(here.rpartition("/")[0], [])) if here else []
        for name in (".gitignore", ".ignore"):
            if name in names and (use_git or name == ".ignore"):
                rules += gitignore_rules(here, Path(at, name).read_text(encoding="utf-8", errors="replace"))
        rules_of[here] = rules
        below = lambda n: f"{here}/{n}" if here else n  # noqa: B023, E731
        folders[:] = sorted(f for f in folders if not f.startswith(".") and not _ignored(below(f), True, rules))
        for n in sorted(names):
            path = below(n)
            if not n.startswith(".") and n.rpartition(".")[2] in LANGUAGES and "." in n and not _ignored(path, False, rules) and not any(p.match(path) for p in skip):
                full = os.path.join(at, n)
                if os.path.isfile(full):
                    found.append((path, os.path.getsize(full)))
    return found


class Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"]
        self.ignore = [g for g in options.get("ignore", "").split("\n") if g]

    def partitions(self) -> list[Chunk]:
        chunks, size = [[]], 0
        for path, n in list_files(self.root, self.ignore):
            if chunks[-1] and size + n > CHUNK_BYTES:
                chunks.append([])
                size = 0
            chunks[-1].append((path, n))
            size += n
        return [Chunk(c) for c in chunks]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path, _ in partition.files:
            data = Path(self.root, path).read_bytes()
            yield path, LANGUAGES[path.rpartition(".")[2]], len(data), data


class RepoSource(DataSource):
    """``spark.read.format("repo").option("root", folder).option("ignore", "glob\\nglob")``: (file, lang, size, content)."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> RepoReader:
        return RepoReader(self.options)


def read_repo(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """The source files of a tree; a missing root is an error before anything is planned."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such folder: {root}")
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").option("root", os.path.abspath(root)).option("ignore", "\n".join(ignore or [])).load()
