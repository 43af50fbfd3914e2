"""What a parser finds in one file, and how in-file calls and places are linked."""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heappop, heappush

from .tokens import Token


def enclosing(spans: list[tuple[int, int, int]], places: list[int]) -> list[int | None]:
    """For each place the id of the shortest (start, end, id) around it, the smallest id on ties; None where there is none.

    One sweep over both in order: a heap holds the spans that have begun, and those that have ended fall off its top.
    """
    out: list[int | None] = [None] * len(places)
    todo, begun = sorted(spans, reverse=True), []
    for k in sorted(range(len(places)), key=places.__getitem__):
        while todo and todo[-1][0] <= places[k]:
            start, end, i = todo.pop()
            heappush(begun, (end - start, i, end))
        while begun and begun[0][2] <= places[k]:
            heappop(begun)
        out[k] = begun[0][1] if begun else None
    return out


@dataclass
class Parsed:
    """The tables' rows of one file; ids count from 0, the file itself, in the order of emission."""

    file: str
    symbols: list[tuple] = field(default_factory=list)  # id, kind, name, fqn, start, end, line
    edges: list[tuple] = field(default_factory=list)  # from, to, kind, confidence
    entrypoints: list[int] = field(default_factory=list)
    complexity: list[tuple] = field(default_factory=list)  # id, cx
    unresolved: list[tuple] = field(default_factory=list)  # from, callee
    tokens: list[tuple] = field(default_factory=list)  # start, end, line, norm
    error: str | None = None
    """What was damaged; the rest of the file still counts."""

    def symbol(self, kind: str, name: str, fqn: str, start: int, end: int, line: int) -> int:
        self.symbols.append((len(self.symbols), kind, name, fqn, start, end, line))
        return len(self.symbols) - 1

    def declare(self, kind: str, name: str, fqn: str, start: int, end: int, line: int, cx: int | None = None, entry: bool = False) -> int:
        """A declaration: the file defines it; a function has a complexity."""
        at = self.symbol(kind, name, fqn, start, end, line)
        self.edges.append((0, at, "defines", "certain"))
        if entry:
            self.entrypoints.append(at)
        if cx is not None:
            self.complexity.append((at, cx))
        return at

    def depend(self, key: str, start: int, end: int, line: int) -> None:
        self.edges.append((0, self.symbol("dependency", key, key, start, end, line), "imports", "certain"))

    def link(self, calls: list[tuple[int, str]], unique: bool = True, file_calls: bool = True) -> None:
        """(byte, callee) calls become edges to the file's functions, the last of a name, or unresolved names.

        A call belongs to the shortest function around it, else to the file. ``unique`` drops repetitions; without
        ``file_calls`` a call outside functions to one of the file's own is dropped.
        """
        functions = [s for s in self.symbols if s[1] == "function"]
        by_name = {s[2]: s[0] for s in functions}
        owners = enclosing([(s[4], s[5], s[0]) for s in functions], [at for at, _ in calls])
        edges, rest = [], []
        for owner, (_, callee) in zip(owners, calls, strict=True):
            if callee not in by_name:
                rest.append((owner or 0, callee))
            elif owner is not None or file_calls:
                edges.append((owner or 0, by_name[callee]))
        if unique:
            edges, rest = sorted(set(edges)), sorted(set(rest))
        self.edges += [(a, b, "calls", "likely") for a, b in edges]
        self.unresolved += rest


def normalize(tokens: list[Token], keywords: frozenset[str], norms: dict[str, str]) -> list[tuple]:
    """Token rows: words that are no keywords are ID, other kinds as ``norms`` says, everything else its own text."""
    out = []
    for t in tokens:
        if not t.text.strip():
            continue
        norm = ("ID" if t.text not in keywords else t.text) if t.kind == "word" else norms.get(t.kind, t.text)
        out.append((t.start, t.end, t.line, norm))
    return out


def joined(file: str, relative: str) -> list[str]:
    """Path segments of ``relative`` as seen from the folder of ``file``, with ``..`` popped."""
    parts: list[str] = []
    for seg in [*file.split("/")[:-1], *relative.split("/")]:
        if seg == "..":
            parts = parts[:-1]
        elif seg not in ("", "."):
            parts.append(seg)
    return parts


def parent(file: str) -> str:
    return file.rpartition("/")[0]


class Code:
    """Tokens of a brace language without comments, with partners of brackets."""

    OPEN, CLOSE = "([{", ")]}"

    def __init__(self, tokens: list[Token]) -> None:
        self.t = [t for t in tokens if t.kind != "comment"]
        self.partner = [-1] * len(self.t)
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text in ("(", "[", "{", "${"):
                stack.append(i)
            elif t.text in (")", "]", "}"):
                want = {")": ("(",), "]": ("[",), "}": ("{", "${")}[t.text]
                while stack and self.t[stack[-1]].text not in want:
                    stack.pop()
                if stack:
                    first = stack.pop()
                    self.partner[first], self.partner[i] = i, first

    def __len__(self) -> int:
        return len(self.t)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def skip(self, i: int) -> int:
        """Place after the bracket group that starts at i."""
        return self.partner[i] + 1 if self.partner[i] > i else len(self.t)

    def angle(self, i: int) -> int:
        """Place after the ``<...>`` group that starts at i."""
        depth = 0
        while i < len(self.t):
            x = self.text(i)
            depth += 1 if x == "<" else -1 if x == ">" else 0
            i = self.skip(i) if x in ("(", "[", "{") and self.t[i].kind == "op" else i + 1
            if not depth:
                return i
        return i
