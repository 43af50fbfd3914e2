"""Lexers: source text to tokens with byte offsets, one rule table for each language."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, char, comment, op, or an opening, inner or closing part of a string
    text: str
    start: int
    end: int
    line: int


class Offsets:
    """Character positions to byte offsets and 1-based lines."""

    def __init__(self, src: str) -> None:
        self.lines = [m.end() for m in re.finditer("\n", src)]
        self.wide = None if src.isascii() else [0]
        if self.wide is not None:
            total = 0
            for c in src:
                total += len(c.encode("utf-8", "surrogatepass"))
                self.wide.append(total)

    def byte(self, at: int) -> int:
        return at if self.wide is None else self.wide[at]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) + 1


NUMBER = r"0[xXbBoO][0-9a-fA-F_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?\w*"
WORD = r"[^\W\d]\w*"
BLOCK = r"/\*.*?(?:\*/|\Z)"
LINE = r"//[^\n]*"
DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
SINGLE = r"'(?:\\.|[^'\\\n])*'?"


def _ops(*ops: str) -> str:
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True)) + r"|\S"


# Kinds and patterns of each language, tried in order.
RULES: dict[str, list[tuple[str, str]]] = {
    "java": [
        ("comment", f"{LINE}|{BLOCK}"), ("string", r'""".*?(?:"""|\Z)|' + DOUBLE), ("char", SINGLE), ("number", NUMBER), ("word", r"[^\W\d]\w*|\$\w*"),
        ("op", _ops("->", "::", "&&", "||", "==", "!=", "<=", ">=", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "...")),
    ],
    "go": [
        ("comment", f"{LINE}|{BLOCK}"), ("string", DOUBLE), ("raw", r"`[^`]*`?"), ("char", SINGLE), ("number", NUMBER), ("word", WORD),
        ("op", _ops(":=", "<-", "&&", "||", "==", "!=", "<=", ">=", "++", "--", "+=", "-=", "*=", "/=", "%=", "&^=", "&^", "<<", ">>", "...")),
    ],
    "rust": [
        ("comment", f"{LINE}|{BLOCK}"), ("string", r'b?r(#*)".*?(?:"\1|\Z)|b?"(?:\\.|[^"\\])*"?'), ("char", r"b?'(?:\\[^\n]+?|[^\\'\n])'"), ("number", NUMBER.replace(r"\.?[\d_]*|", r"(?:\.\d[\d_]*|\.(?![\.\w]))?|")), ("word", r"r#\w+|" + WORD),
        ("op", _ops("=>", "->", "::", "..=", "...", "..", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>=")),
    ],
    "typescript": [
        ("comment", f"{LINE}|{BLOCK}"), ("string", f"{DOUBLE}|{SINGLE}"), ("number", NUMBER), ("word", r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d]\w*"),
        ("op", _ops("=>", "?.", "??", "??=", "&&", "||", "===", "!==", "==", "!=", "<=", ">=", "**", "++", "--", "+=", "-=", "*=", "/=", "%=", "&&=", "||=", "...", "`")),
    ],
    "ruby": [
        ("comment", r"\#[^\n]*|^=begin\b.*?(?:^=end[^\n]*|\Z)"), ("number", r"\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?"), ("symbol", r":(?:[^\W\d]\w*[?!=]?|\"(?:\\.|[^\"\\])*\")(?!:)"),
        ("key", r"[^\W\d]\w*[?!]?:(?!:)(?=\s|\Z|[\[({\"'])"), ("word", r"@@?[^\W\d]\w*|\$\w+|[^\W\d]\w*[?!]?(?!=[^=~>])|[^\W\d]\w*"),
        ("op", _ops("&&", "||", "&.", "::", "=>", "->", "<=>", "===", "==", "!=", "=~", "!~", "<=", ">=", "**", "<<", ">>", "+=", "-=", "*=", "/=", "||=", "&&=", "..", "...")),
    ],
}
COMPILED = {lang: re.compile("|".join(f"(?P<{k}>{p})" if "\\1" not in p else f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=hashes)').replace('(#*)', '(?P<hashes>#*)')})" for k, p in rules), re.S | re.M) for lang, rules in RULES.items()}

REGEX_BEFORE = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "return", "typeof", "case", "in", "of", "==", "===", "!=", "!==", "+", "and", "or", "not", "if", "unless", "when", "elsif", "while", "until", "~", "=~"}


def lex(lang: str, src: str) -> list[Token]:
    """All tokens but white space. Strings that carry code inside are split into their parts, ruby's excepted."""
    at, n, out, where = 0, len(src), [], Offsets(src)
    match = COMPILED[lang].match
    closers: list[int] = []  # depths of braces at which a template's expression ends
    depth = 0

    def add(kind: str, a: int, b: int) -> None:
        if b > a:
            out.append(Token(kind, src[a:b], where.byte(a), where.byte(b), where.line(a)))

    def template(a: int) -> int:
        """From inside a template string to its end or to its next expression."""
        b = a
        while b < n and src[b] != "`" and not src.startswith("${", b):
            b += 2 if src[b] == "\\" else 1
        b = min(b, n)
        add("inner", a, b)
        if b < n and src[b] == "`":
            add("quote", b, b + 1)
            return b + 1
        if b < n:
            add("op", b, b + 2)
            closers.append(depth)
            return b + 2
        return n

    heredocs: list[str] = []
    while at < n:
        c = src[at]
        if c == "\n" and heredocs:
            for name in heredocs:
                end = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$", re.M).search(src, at + 1)
                stop = end.end() if end else n
                add("string", at + 1, stop)
                at = stop
            heredocs.clear()
            continue
        if c.isspace():
            at += 1
            continue
        last = out[-1].text if out else ""
        open_value = not out or last in REGEX_BEFORE or out[-1].kind == "comment"
        if lang == "ruby":
            if c in "\"'`" or c == "%" and open_value and re.match(r"%[qQwWiI]?[(\[{<|!/]", src[at : at + 3]):
                end = _ruby_string(src, at)
                add("string", at, end)
                at = end
                continue
            if c == "<" and (h := re.compile(r"<<[~-]?([\"'`]?)([A-Z_]\w*)\1").match(src, at)) and (open_value or h[0][2] in "~-"):
                add("string", at, h.end())
                heredocs.append(h[2])
                at = h.end()
                continue
            if c == "?" and open_value and at + 1 < n and re.match(r"\?\w(?!\w)", src[at : at + 3]):
                add("string", at, at + 2)
                at += 2
                continue
        if c == "/" and lang in ("ruby", "typescript") and open_value and src[at + 1 : at + 2] not in ("/", "*", "", " "):
            end, inside = at + 1, False
            while end < n and src[end] != "\n" and (inside or src[end] != "/"):
                inside = src[end] == "[" or inside and src[end] != "]"
                end += 2 if src[end] == "\\" else 1
            if end < n and src[end] == "/":
                end += len(re.match(r"[a-z]*", src[end + 1 :])[0]) + 1
                add("regex", at, end)
                at = end
                continue
        m = match(src, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hashes":
            kind = "string"
        if kind in ("string", "raw") and lang in ("typescript", "go"):
            add("quote", at, at + 1)
            closed = end > at + 1 and src[end - 1] == src[at]
            inner = end - 1 if closed else end
            for piece in re.finditer(r"\\(?:u\{[^}]*\}|u\w{4}|x\w\w|.)|[^\\]+", src[at + 1 : inner], re.S) if kind == "string" else [re.match(r".*", src[at + 1 : inner], re.S)]:
                add("escape" if piece[0].startswith("\\") and kind == "string" else "inner", at + 1 + piece.start(), at + 1 + piece.end())
            if closed:
                add("quote", inner, end)
            at = end
            continue
        add(kind, at, end)
        at = end
        if lang == "typescript":
            if c == "`":
                out[-1].kind = "quote"
                at = template(at)
            elif c == "{":
                depth += 1
            elif c == "}":
                if closers and closers[-1] == depth:
                    closers.pop()
                    at = template(at)
                else:
                    depth -= 1
    return out


def _ruby_string(src: str, at: int) -> int:
    """End of the string that starts at ``at``; expressions in it are skipped as a whole."""
    pairs = {"(": ")", "[": "]", "{": "}", "<": ">"}
    if src[at] == "%":
        head = re.match(r"%[qQwWiI]?", src[at:])[0]
        at += len(head)
    opener = src[at]
    close, depth, i, n = pairs.get(opener, opener), 1, at + 1, len(src)
    while i < n:
        if src[i] == "\\":
            i += 2
            continue
        if src.startswith("#{", i) and opener != "'":
            inner, i = 1, i + 2
            while i < n and inner:
                if src[i] in "\"'" and src[i] != opener:
                    i = _ruby_string(src, i)
                    continue
                inner += {"{": 1, "}": -1}.get(src[i], 0)
                i += 1
            continue
        if src[i] == close:
            depth -= 1
            if not depth:
                return i + 1
        elif src[i] == opener:
            depth += 1
        i += 1
    return n
