"""Rust: functions, types, calls, and calls within macros."""

from __future__ import annotations

from bisect import bisect_right

from .model import Code, Parsed, normalize, parent
from .tokens import lex

# Reserved words, and primitive types, which the norms keep as they are.
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())
NORMS = {"number": "NUM", "string": "STR", "char": "STR"}
QUALIFIERS = ("async", "const", "unsafe", "extern", "default")


def _macros(code: Code) -> list[tuple[int, int]]:
    """Spans of macro invocations' brackets, outer ones only."""
    out, i = [], 0
    while i < len(code) - 2:
        if code.word(i) and code.text(i + 1) == "!" and code.text(i + 2) in ("(", "[", "{"):
            end = code.skip(i + 2)
            out.append((i + 2, end))
            i = end
        else:
            i += 1
    return out


def _inside(spans: list[tuple[int, int]], i: int) -> bool:
    k = bisect_right(spans, i, key=lambda s: s[0]) - 1  # spans are in order and apart
    return k >= 0 and i < spans[k][1]


def cyclomatic(code: Code, lo: int, hi: int, macros: list[tuple[int, int]]) -> int:
    """One, plus branches, loops but ``loop``, match arms, ``?`` and short-circuit operators; of macros only operators count."""
    cx = 1
    for i in range(lo, hi):
        x, t = code.text(i), code.t[i]
        if t.kind == "op" and x in ("&&", "||"):
            before = code.t[i - 1]
            cx += before.kind in ("word", "number", "string", "char") and before.text not in ("move", "return", "else", "in", "match", "if", "while") or before.text in (")", "]", "}", "?")
        elif _inside(macros, i):
            continue
        elif t.kind == "word":
            cx += x in ("if", "while") or x == "for" and code.text(i + 1) != "<" and code.text(i - 1) not in (">",) and not _impl_for(code, i)
        elif t.kind == "op":
            cx += x == "=>" or x == "?" and code.text(i + 1) != "Sized"
    return cx


def _impl_for(code: Code, i: int) -> bool:
    """Whether this ``for`` belongs to the head of an impl."""
    j = i - 1
    while j >= 0 and code.text(j) not in ("{", "}", ";"):
        if code.text(j) == "impl":
            return True
        j -= 1
    return False


def parse(file: str, src: str) -> Parsed:
    tokens = lex("rust", src)
    code, out = Code(tokens), Parsed(file)
    out.symbol("file", file, parent(file), 0, len(src.encode("utf-8", "surrogatepass")), 1)
    out.tokens = normalize(tokens, KEYWORDS, NORMS)
    macros = _macros(code)
    impls = []  # (first, last, whether of a trait)
    for i in range(len(code)):
        if code.word(i) and code.text(i) == "impl" and code.text(i - 1) in ("", "}", ";", "{", "]", "unsafe"):
            j, of_trait = i + 1, False
            while j < len(code) and code.text(j) not in ("{", ";"):
                of_trait |= code.text(j) == "for" and code.text(j + 1) != "<"
                j = code.angle(j) if code.text(j) == "<" else code.skip(j) if code.text(j) in ("(", "[") else j + 1
            if code.text(j) == "{":
                impls.append((j, code.skip(j), of_trait))
    found, names = [], set()
    for i in range(len(code) - 1):
        x = code.text(i) if code.word(i) else ""
        if x not in ("fn", "struct", "enum", "trait") or not code.word(i + 1) or _inside(macros, i):
            continue
        lo, public = _head(code, i)
        j = i + 2
        if x == "fn":
            names.add(i + 1)
        while j < len(code) and code.text(j) not in ("{", ";"):
            j = code.angle(j) if code.text(j) == "<" else code.skip(j) if code.text(j) in ("(", "[") else j + 1
        body = code.text(j) == "{"
        if x == "fn" and not body:
            continue
        hi = code.skip(j) - 1 if body else j
        around = [s for s in impls if s[0] < i < s[1]]
        in_trait = bool(around) and max(around)[2]
        entry = x == "fn" and (code.text(i + 1) == "main" or public or in_trait or _tested(code, lo))
        found.append(("function" if x == "fn" else "class", i + 1, lo, hi, entry))
    for kind, name, lo, hi, entry in sorted(found, key=lambda f: f[2]):
        text, t = code.text(name), code.t[lo]
        cx = cyclomatic(code, lo, min(hi + 1, len(code)), macros) if kind == "function" else None
        out.declare(kind, text, text, t.start, code.t[min(hi, len(code) - 1)].end, t.line, cx, entry)
    calls = []
    for i in range(len(code) - 1):
        if code.word(i) and code.text(i + 1) == "(" and code.text(i) not in KEYWORDS and i not in names and (code.text(i - 1) != "::" or _inside(macros, i)):
            calls.append((code.t[i].start, code.text(i)))
    out.link(calls)
    return out


def _head(code: Code, i: int) -> tuple[int, bool]:
    """First token of an item with its qualifiers and visibility, and whether it has one."""
    while code.text(i - 1) in QUALIFIERS or code.t[i - 1].kind == "string" and code.text(i - 2) == "extern":
        i -= 1
        if i == 0:
            return 0, False
    if i > 0 and code.text(i - 1) == ")" and code.text(code.partner[i - 1] - 1) == "pub":
        return code.partner[i - 1] - 1, True
    if i > 0 and code.text(i - 1) == "pub":
        return i - 1, True
    return i, False


def _tested(code: Code, i: int) -> bool:
    """Whether one of the attributes right before an item says test."""
    while i > 0 and code.text(i - 1) == "]":
        first = code.partner[i - 1]
        if first < 1 or code.text(first - 1) != "#":
            return False
        if any("test" in code.text(k) for k in range(first, i)):
            return True
        i = first - 1
    return False
