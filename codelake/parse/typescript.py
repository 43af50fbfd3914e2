"""TypeScript: classes, functions, methods, function-valued variables, calls and relative imports."""

from __future__ import annotations

from .model import Code, Parsed, joined, normalize
from .tokens import lex

# Reserved words, types the norms keep as they are, and endings of modules.
KEYWORDS = frozenset("abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let namespace never new null number object of package private protected public readonly return satisfies set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield".split())
NORMS = {"number": "NUM", "inner": "STR"}
ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx")
SOFT = frozenset("any as async boolean declare from get is keyof namespace never number object of package readonly satisfies set string symbol type undefined unknown".split())
VALUE_BEFORE = ("=", "(", ",", ":", "return", "=>", "?", "&&", "||", "??", "!", "[", "new", "await", "typeof", "yield")


def cyclomatic(code: Code, lo: int, hi: int) -> int:
    """One, plus branches, loops, cases but default, ternaries, catches and short-circuit operators; a do-while counts once."""
    cx, ends = 1, set()
    for i in range(lo, hi):
        x, t = code.text(i), code.t[i]
        if t.kind == "word" and code.text(i - 1) not in (".", "?.") and code.text(i + 1) != ":":
            if x == "do":
                cx += 1
                if code.text(i + 1) == "{":
                    ends.add(code.partner[i + 1])
            elif x in ("if", "for", "case", "catch") or x == "while" and i - 1 not in ends:
                cx += 1
        elif t.kind == "op":
            cx += x in ("&&", "||", "??") or x == "?" and code.text(i + 1) not in (":", ")", ",", "=", ";", "]", "}", ".", "?")
    return cx


def module_key(path: str) -> str:
    for e in ENDINGS:
        if path.endswith(e):
            return path.removesuffix(e)
    return path


def parse(file: str, src: str) -> Parsed:
    tokens = lex("typescript", src)
    code, out = Code(tokens), Parsed(file)
    out.symbol("file", file, module_key(file), 0, len(src.encode("utf-8", "surrogatepass")), 1)
    out.entrypoints.append(0)
    out.tokens = normalize(tokens, KEYWORDS, NORMS)
    found, names, depends = [], set(), []
    exported = []
    i = 0
    while i < len(code):
        x = code.text(i) if code.word(i) else ""
        if code.text(i - 1) in (".", "?."):
            i += 1
            continue
        if x == "export":
            exported.append((i, _statement_end(code, i + 1)))
        elif x == "import" and code.text(i + 1) != "(":
            j = i + 1
            while j < len(code) and code.text(j) != ";" and not (code.t[j].kind == "quote"):
                j += 1
            if j + 1 < len(code) and code.t[j].kind == "quote" and code.t[j + 1].kind == "inner" and code.text(j + 1).startswith("."):
                depends.append(code.t[j + 1])
            i = j
        elif x == "class" and code.word(i + 1) and code.text(i - 1) not in (*VALUE_BEFORE, "abstract"):
            j = i + 2
            while j < len(code) and code.text(j) != "{":
                j = code.angle(j) if code.text(j) == "<" else j + 1
            found.append(("class", i + 1, i, code.skip(j) - 1 if j < len(code) else j - 1))
        elif x == "function" and code.word(i + 1):
            names.add(i + 1)
            body = _body(code, i + 2)
            first = i - 1 if code.text(i - 1) == "async" else i
            if body is not None and code.text(first - 1) not in VALUE_BEFORE:
                found.append(("function", i + 1, first, code.skip(body) - 1))
        elif code.word(i) and code.text(i + 1) in ("(", "<", "?") and (x not in KEYWORDS or x in SOFT) and not x.startswith("#") and code.text(i - 1) not in ("function", "new", "*") or x in SOFT and code.text(i + 1) == "(":
            j = i + 2 if code.text(i + 1) == "?" else i + 1
            body = _body(code, j) if code.text(j) in ("(", "<") and code.text(i - 1) in ("{", "}", ",", ";", ")", "async", "get", "set", "static", "public", "private", "protected", "readonly", "override") or code.text(j) == "(" and i and code.t[i - 1].line < code.t[i].line and code.text(i - 1) not in (".", "=", "return") else None
            if body is not None:
                names.add(i)
                first = i
                while code.text(first - 1) in ("async", "get", "set", "static", "public", "private", "protected", "readonly", "override"):
                    first -= 1
                found.append(("function", i, first, code.skip(body) - 1))
        elif x in ("const", "let", "var") and code.word(i + 1):
            end = _function_value(code, i + 1)
            if end is not None:
                found.append(("function", i + 1, i + 1, end))
        i += 1
    for kind, name, lo, hi in sorted(found, key=lambda f: code.t[f[2]].start):
        text, t = code.text(name), code.t[lo]
        entry = any(a < lo <= b for a, b in exported)
        out.declare(kind, text, text, t.start, code.t[min(hi, len(code) - 1)].end, t.line, cyclomatic(code, lo, min(hi + 1, len(code))) if kind == "function" else None, entry)
    for t in depends:
        out.depend(module_key("/".join(joined(file, t.text))), t.start, t.end, t.line)
    calls = [
        (code.t[i].start, code.text(i)) for i in range(len(code) - 1)
        if code.word(i) and code.text(i + 1) == "(" and i not in names and not _arrow(code, i) and (code.text(i) not in KEYWORDS or code.text(i) in SOFT or code.text(i - 1) in (".", "?.")) and not code.text(i).startswith("#") and not _new(code, i)
    ]
    out.link(calls)
    return out


def _arrow(code: Code, i: int) -> bool:
    """Whether this is the ``async`` of an arrow function."""
    return code.text(i) == "async" and code.text(i - 1) not in (".", "?.") and code.text(code.skip(i + 1)) in ("=>", ":")


def _new(code: Code, i: int) -> bool:
    while code.text(i - 1) == "." and code.word(i - 2):
        i -= 2
    return code.text(i - 1) in ("new", "function")


def _body(code: Code, i: int) -> int | None:
    """Brace of the body of a function whose type parameters or parameters start at i; None if there is none."""
    if code.text(i) == "<":
        i = code.angle(i)
    if code.text(i) != "(":
        return None
    i = code.skip(i)
    if code.text(i) == ":":
        i += 1
        while i < len(code):
            x = code.text(i)
            if x == "{" and code.text(i - 1) not in (":", "|", "&", "=>", "is", "extends"):
                break
            if x in (";", "}", ")", ",") or x == "=":
                return None
            i = code.angle(i) if x == "<" else code.skip(i) if x in ("(", "[", "{") else i + 1
    return i if code.text(i) == "{" else None


def _statement_end(code: Code, i: int) -> int:
    """Last token of the exported statement that goes on at i."""
    head = []
    while i < len(code):
        x = code.text(i)
        if x == ";":
            return i
        if x == "{":
            end = code.skip(i) - 1
            if {"class", "function", "interface", "enum", "namespace"} & set(head) and "=" not in head or not head:
                return end
            i = end + 1
            continue
        if head and "=" in head and code.t[i].line > code.t[i - 1].line and code.text(i - 1) in ("}", ")", "]") and x not in (".", ",", "?", ":", "=>"):
            return i - 1
        if head and code.word(i) and x in ("export", "import", "const", "let", "var", "function", "class", "interface", "type", "enum") and code.t[i].line > code.t[i - 1].line:
            return i - 1
        head.append(x)
        i = code.skip(i) if x in ("(", "[") else i + 1
    return len(code) - 1


def _function_value(code: Code, name: int) -> int | None:
    """Last token of the arrow function or function expression that a variable starts with; None for another value."""
    i = name + 1
    if code.text(i) == ":":
        while i < len(code) and code.text(i) not in ("=", ";"):
            i = code.angle(i) if code.text(i) == "<" else code.skip(i) if code.text(i) in ("(", "[", "{") else i + 1
    if code.text(i) != "=":
        return None
    i += 1
    i += code.text(i) == "async"
    if code.text(i) == "function":
        i += 2 if code.word(i + 1) else 1
        body = _body(code, i + 1 if code.text(i) == "*" else i)
        return None if body is None else code.skip(body) - 1
    if code.text(i) == "<":
        i = code.angle(i)
    if code.text(i) == "(":
        i = code.skip(i)
        if code.text(i) == ":":
            while i < len(code) and code.text(i) not in ("=>", ";"):
                i = code.angle(i) if code.text(i) == "<" else code.skip(i) if code.text(i) in ("(", "[", "{") else i + 1
    elif code.word(i):
        i += 1
    if code.text(i) != "=>":
        return None
    i += 1
    if code.text(i) == "{":
        return code.skip(i) - 1
    last = i
    while i < len(code) and code.text(i) not in (";", ",", ")", "}", "]"):
        if i > last and code.t[i].line > code.t[i - 1].line and code.text(i) not in (".", "?", ":", "&&", "||", "??", "+") and code.text(i - 1) not in ("=>", "?", ":", "&&", "||", "??", "+", "("):
            break
        i = code.skip(i) if code.text(i) in ("(", "[", "{") else i + 1
    return i - 1
