"""Ruby: methods, classes, modules, calls with and without arguments, and relative requires."""

from __future__ import annotations

import re

from .model import Parsed, joined, normalize
from .tokens import Token, lex

# The language's reserved words.
KEYWORDS = frozenset("BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__".split())
NORMS = {"number": "NUM", "string": "STR", "symbol": "STR"}
OPENERS = frozenset(("begin", "case", "class", "def", "do", "for", "if", "module", "unless", "until", "while"))
DECISIONS = frozenset(("if", "elsif", "unless", "while", "until", "for", "when", "rescue"))
CONTINUES = frozenset(("=", "(", "[", "{", ",", "and", "or", "not", "&&", "||", "then", "do", "else", "return", "=>", "+=", "||=", "<<", "!", ";", "|", "begin", "ensure", "->", "&&=", "+", "-", "*"))


def parse(file: str, src: str) -> Parsed:
    tokens = lex("ruby", src)
    out = Parsed(file)
    out.symbol("file", file, file, 0, len(src.encode("utf-8", "surrogatepass")), 1)
    out.entrypoints.append(0)
    out.tokens = normalize(tokens, KEYWORDS, NORMS)
    code = [t for t in tokens if t.kind != "comment"]
    found: list[tuple[str, int, int, int]] = []
    skip: set[int] = set()
    stack: list[tuple[str, int, int]] = []  # opener, its place, place of the name or -1
    loops: list[int] = []  # lines of loops whose do does not open a block

    def text(i: int) -> str:
        return code[i].text if 0 <= i < len(code) else ""

    def starts(i: int) -> bool:
        """Whether a keyword at i opens a statement or a value and is no modifier."""
        return i == 0 or code[i - 1].line < code[i].line or text(i - 1) in CONTINUES or text(i - 1) in KEYWORDS and text(i - 1) not in ("end", "self", "true", "false", "nil")

    for i, t in enumerate(code):
        if t.kind != "word" or t.text not in KEYWORDS or text(i - 1) in (".", "&.", "::"):
            continue
        x = t.text
        if x in ("if", "unless", "while", "until") and not starts(i):
            continue
        if x == "do" and loops and loops[-1] == t.line:
            loops.pop()
            continue
        if x in OPENERS:
            name = -1
            if x in ("while", "until", "for"):
                loops.append(t.line)
            if x == "def":
                name = i + 1
                single = text(i + 2) in (".", "::")
                at = i + 4 if single else i + 2
                skip.add(i + 3 if single else i + 1)
                if text(at) == "(":
                    depth, k = 1, at + 1
                    while k < len(code) and depth:
                        depth += {"(": 1, ")": -1}.get(text(k), 0)
                        if code[k].kind == "word" and text(k - 1) in ("(", ",", "*", "**", "&") and text(k + 1) in (",", ")"):
                            skip.add(k)
                        k += 1
                    at = k
                else:
                    k = at
                    while k < len(code) and code[k].line == t.line and text(k) not in ("=", ";"):
                        if code[k].kind == "word" and text(k + 1) != "=":
                            skip.add(k)
                        k += 1
                if text(at) == "=" and at < len(code) and code[at].line == code[at - 1].line:  # an endless method
                    last = at
                    while last + 1 < len(code) and code[last + 1].line == t.line:
                        last += 1
                    if not single:
                        found.append(("function", name, i, last))
                    continue
                if single:
                    name = -1
            elif x in ("class", "module") and i + 1 < len(code) and re.match(r"[A-Z]", text(i + 1)) and text(i + 2) != "::":
                name = i + 1
            stack.append((x, i, name))
        elif x == "end" and stack:
            opener, at, name = stack.pop()
            if opener in ("while", "until", "for") and loops:
                loops.pop()
            if name >= 0:
                found.append(({"def": "function", "class": "class", "module": "module"}[opener], name, at, i))
    for kind, name, lo, hi in sorted(found, key=lambda f: f[2]):
        cx = None
        if kind == "function":
            cx = 1 + sum(1 for k in range(lo, hi + 1) if _decides(code, k))
        out.declare(kind, text(name), text(name), code[lo].start, code[hi].end, code[lo].line, cx)
    calls = []
    for i, t in enumerate(code):
        if t.kind == "word" and t.text not in KEYWORDS and i not in skip and re.match(r"[^\W\dA-Z]", t.text):
            calls.append((t.start, t.text))
            if t.text == "require_relative":
                arg = code[i + 2] if text(i + 1) == "(" and i + 2 < len(code) else code[i + 1] if i + 1 < len(code) else None
                if arg is not None and arg.kind == "string" and len(arg.text) > 2 and "#{" not in arg.text:
                    path = "/".join(joined(file, arg.text[1:-1]))
                    out.depend(path if path.endswith(".rb") else path + ".rb", arg.start + 1, arg.end - 1, arg.line)
        elif t.kind == "string" and not t.text.startswith("'"):
            for m in re.finditer(r"#\{([^}]*)\}", t.text):
                calls += [(t.start, w.text) for w in lex("ruby", m[1]) if w.kind == "word" and w.text not in KEYWORDS and re.match(r"[^\W\dA-Z]", w.text)]
    out.link(calls)
    return out


def _decides(code: list[Token], k: int) -> bool:
    t = code[k]
    if t.kind == "word":
        return (t.text in DECISIONS or t.text in ("and", "or")) and (k == 0 or code[k - 1].text not in (".", "&.", "::"))
    return t.kind == "op" and t.text in ("&&", "||", "?")
