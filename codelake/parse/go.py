"""Go: functions, methods, types, calls and imports."""

from __future__ import annotations

from .model import Code, Parsed, normalize, parent
from .tokens import lex

# The language's reserved words.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split())
NORMS = {"number": "NUM", "char": "STR"}


def cyclomatic(code: Code, lo: int, hi: int) -> int:
    return 1 + sum(1 for i in range(lo, hi) if (code.word(i) and code.text(i) in ("if", "for", "case")) or (code.t[i].kind == "op" and code.text(i) in ("&&", "||")))


def parse(file: str, src: str) -> Parsed:
    tokens = lex("go", src)
    code, out = Code(tokens), Parsed(file)
    out.symbol("file", file, parent(file), 0, len(src.encode("utf-8", "surrogatepass")), 1)
    out.tokens = normalize(tokens, KEYWORDS, NORMS)
    names, found, depends = set(), [], []
    i = 0
    while i < len(code):
        x = code.text(i) if code.word(i) else ""
        if x == "import":
            last = code.skip(i + 1) if code.text(i + 1) == "(" else i + 5
            j = i + 1
            while j < min(last, len(code)):
                if code.t[j].kind == "inner" and code.text(j - 1) == '"':
                    depends.append(code.t[j])
                    if code.text(i + 1) != "(":
                        break
                j += 1
            i = max(j, i + 1)
            continue
        if x == "func":
            j = code.skip(i + 1) if code.text(i + 1) == "(" else i + 1
            if code.word(j) and code.text(j) not in KEYWORDS and code.text(j + 1) in ("(", "["):
                names.add(j)
                k = code.skip(j + 1) if code.text(j + 1) == "[" else j + 1
                k = code.skip(k)
                line = code.t[min(k, len(code)) - 1].line
                while k < len(code) and code.text(k) != "{" and code.t[k].line == line:
                    k = code.skip(k) if code.text(k) in ("(", "[") else k + 1
                body = k < len(code) and code.text(k) == "{"
                found.append(("function", j, i, code.skip(k) - 1 if body else k - 1))
        elif x == "type":
            spec, last = i + 1, i + 2
            if code.text(i + 1) == "(":
                spec, last = i + 2, code.skip(i + 1) - 1
            while spec < last and code.word(spec):
                k = _type_end(code, spec + 1)
                found.append(("class", spec, spec, k - 1))
                spec = k
        i += 1
    for kind, name, lo, hi in sorted(found, key=lambda f: code.t[f[2]].start):
        text, a, b = code.text(name), code.t[lo], code.t[max(lo, min(hi, len(code) - 1))]
        entry = kind == "function" and (text in ("main", "init") or text[:1].isupper())
        out.declare(kind, text, text, a.start, b.end, a.line, cyclomatic(code, lo, hi + 1) if kind == "function" else None, entry)
    for t in depends:
        out.depend(t.text, t.start - 1, t.end + 1, t.line)
    calls = [(code.t[i].start, code.text(i)) for i in range(len(code) - 1) if code.word(i) and code.text(i + 1) == "(" and code.text(i) not in KEYWORDS and i not in names]
    out.link(calls)
    return out


def _type_end(code: Code, i: int) -> int:
    """Place after a type that starts at i: brackets whole, then to the end of its line."""
    line = code.t[i].line if i < len(code) else 0
    while i < len(code) and code.t[i].line == line and code.text(i) != ")":
        if code.text(i) in ("(", "[", "{"):
            i = code.skip(i)
            line = code.t[i - 1].line
        else:
            i += 1
    return i
