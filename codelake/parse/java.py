"""Java: classes, methods, invocations and imports."""

from __future__ import annotations

from .model import Code, Parsed, normalize
from .tokens import lex

# The language's reserved words.
KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
NORMS = {"number": "NUM", "string": "STR", "char": "STR"}
DECISIONS = frozenset(("if", "for", "catch", "case", "default", "while"))
TYPES = ("class", "interface", "enum", "record")
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())


def cyclomatic(code: Code, lo: int, hi: int) -> int:
    """One, plus branches, loops, catches, switch labels, ternaries and short-circuit operators; a do-while counts once."""
    cx, ends = 1, set()
    for i in range(lo, hi):
        x, t = code.text(i), code.t[i]
        if t.kind == "word" and x in DECISIONS:
            if x == "while" and i - 1 in ends or x == "default" and code.text(i + 1) not in (":", "->"):
                continue
            cx += 1
        elif x == "do" and t.kind == "word":
            cx += 1
            if code.text(i + 1) == "{":
                ends.add(code.partner[i + 1])
        elif t.kind == "op" and (x in ("&&", "||") or x == "?" and code.text(i - 1) not in ("<", ",") and code.text(i + 1) not in (">", ",", "extends", "super")):
            cx += 1
    return cx


def parse(file: str, src: str) -> Parsed:
    tokens = lex("java", src)
    code, out = Code(tokens), Parsed(file)
    end = len(src.encode("utf-8", "surrogatepass"))
    out.symbol("file", file, file, 0, end, 1)
    out.tokens = normalize(tokens, KEYWORDS, NORMS)
    package, imports, calls, headers = "", [], [], set()
    found: list[tuple] = []
    bodies: set[int] = set()  # braces of type bodies

    i = 0
    while i < len(code):
        x = code.text(i)
        if x in ("package", "import") and code.t[i].kind == "word":
            j = i + 1
            names = []
            while j < len(code) and code.text(j) != ";":
                if code.text(j) != "static":
                    names.append(j)
                j += 1
            path = "".join(code.text(k) for k in names)
            if x == "package":
                package = path
            else:
                path = path.removesuffix(".*")
                if "." in path:
                    imports.append((path, code.t[names[0]], code.t[names[-1]]))
            i = j
        elif x in TYPES and code.t[i].kind == "word" and code.word(i + 1) and code.text(i - 1) not in (".", "::"):
            j = i + 2
            while j < len(code) and code.text(j) not in ("{", ";"):
                j = code.skip(j) if code.text(j) == "(" else j + 1
            if code.text(j) == "{":
                bodies.add(j)
                if x == "class":
                    found.append(("class", i + 1, _start(code, i), code.skip(j) - 1))
        elif x == "new":
            j = i + 1
            while code.word(j) or code.text(j) in (".", "<"):
                j = code.angle(j) if code.text(j) == "<" else j + 1
            if code.text(j) == "(" and code.text(code.skip(j)) == "{":
                bodies.add(code.skip(j))
        i += 1

    for body in sorted(bodies):
        last = code.skip(body) - 1
        i = start = body + 1
        while i < last:
            x = code.text(i)
            if x in (";", ","):
                i = start = i + 1
            elif x == "{":
                i = start = code.skip(i)
            elif x == "@" and code.word(i + 1):
                i += 2
                while code.text(i) == "." and code.word(i + 1):
                    i += 2
                if code.text(i) == "(":
                    i = code.skip(i)
            elif x == "=":
                while i < last and code.text(i) != ";":
                    i = code.skip(i) if code.text(i) in ("(", "[", "{") and code.t[i].kind == "op" else i + 1
            elif x == "(":
                headers.add(i - 1)
                j = code.skip(i)
                typed = code.word(i - 1) and i - 1 > start and (code.text(i - 2) in (">", "]") or code.word(i - 2) and (code.text(i - 2) not in KEYWORDS or code.text(i - 2) in PRIMITIVES))
                while j < last and code.text(j) not in ("{", ";", ","):
                    j = code.skip(j) if code.text(j) in ("(", "[") else j + 1
                stop = code.skip(j) - 1 if code.text(j) == "{" else j
                if typed:
                    found.append(("function", i - 1, start, min(stop, last)))
                i = start = stop + 1
            else:
                i += 1

    for kind, name, lo, hi in sorted(found, key=lambda f: f[2]):
        text, t = code.text(name), code.t[lo]
        fqn = f"{package}.{text}" if kind == "class" and package else text
        cx = cyclomatic(code, lo, hi + 1) if kind == "function" else None
        out.declare(kind, text, fqn, t.start, code.t[min(hi, len(code) - 1)].end, t.line, cx, kind == "function" and text == "main")
    for path, a, b in imports:
        out.depend(path, a.start, b.end, a.line)
    for i in range(len(code) - 1):
        if code.word(i) and code.text(i + 1) == "(" and code.text(i) not in KEYWORDS and i not in headers and not _made(code, i):
            calls.append((code.t[i].start, code.text(i)))
    out.link(calls, unique=False, file_calls=False)
    return out


def _start(code: Code, i: int) -> int:
    """First token of a declaration's modifiers and annotations."""
    while i > 0:
        x = code.text(i - 1)
        if x in KEYWORDS and x in ("public", "protected", "private", "static", "final", "abstract", "strictfp") or x in ("sealed",):
            i -= 1
        elif code.word(i - 1) and code.text(i - 2) == "@":
            i -= 2
        elif x == ")" and code.partner[i - 1] > 1 and code.text(code.partner[i - 1] - 2) == "@":
            i = code.partner[i - 1] - 2
        else:
            break
    return i


def _made(code: Code, i: int) -> bool:
    """Whether the name before a bracket belongs to an object's creation or an annotation."""
    while code.text(i - 1) == "." and code.word(i - 2):
        i -= 2
    return code.text(i - 1) in ("new", "@")
