"""Python: classes, functions, calls and imports, by the standard library's own parser and tokenizer."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize

from .model import Parsed, parent
from .tokens import Offsets

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)


def module_key(file: str) -> str:
    """A file's path without its ending; a package's ``__init__`` is the package."""
    base = file.removesuffix(".pyi").removesuffix(".py")
    return "" if base == "__init__" else base.removesuffix("/__init__")


def relative_key(file: str, dots: int, module: str) -> str:
    parts = [p for p in parent(file).split("/") if p]
    for _ in range(dots - 1):
        parts = parts[:-1]
    return "/".join([*parts, *module.split(".")])


def cyclomatic(node: ast.AST) -> int:
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHES) for n in ast.walk(node))


def _tokens(src: str, line_at: list[int], where: Offsets) -> list[tuple]:
    """Rows of tokens; a string's quotes keep their text, its content is STR."""
    out = []

    def add(a: tuple[int, int], b: tuple[int, int], norm: str) -> None:
        lo, hi = line_at[a[0] - 1] + a[1], line_at[b[0] - 1] + b[1]
        if hi > lo and src[lo:hi].strip():
            out.append((where.byte(lo), where.byte(hi), a[0], norm))

    try:
        for t in tokenize.generate_tokens(io.StringIO(src).readline):
            if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                continue
            if t.type == tokenize.STRING:
                lo = line_at[t.start[0] - 1] + t.start[1]
                quote = next(k for k, c in enumerate(t.string) if c in "\"'")
                size = 3 if t.string[quote : quote + 3] in ('"""', "'''") else 1
                head, tail = t.string[: quote + size], t.string[-size:]
                end = lo + len(t.string)
                out.append((where.byte(lo), where.byte(lo + len(head)), t.start[0], head))
                if len(t.string) > len(head) + size:
                    out.append((where.byte(lo + len(head)), where.byte(end - size), t.start[0], "STR"))
                out.append((where.byte(end - size), where.byte(end), t.end[0], tail))
            elif t.type == getattr(tokenize, "FSTRING_MIDDLE", -1):
                add(t.start, t.end, "STR")
            else:
                norm = "NUM" if t.type == tokenize.NUMBER else "ID" if t.type == tokenize.NAME and not keyword.iskeyword(t.string) else t.string
                add(t.start, t.end, norm)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass  # the tokens before the damage count
    return out


def _tree(src: str) -> tuple[ast.Module, str | None]:
    """The syntax tree, without the lines that break it, and the first such line's error.

    A damaged line becomes ``pass``, or ``if 1:`` where it heads a block, so that what stands around it keeps its place;
    one that was replaced already takes the next untouched line with it. Each round replaces a line, so it ends.
    """
    lines, error, done = src.splitlines(keepends=True), None, set()
    while True:
        try:
            return ast.parse("".join(lines)), error
        except RecursionError as e:
            return ast.parse(""), f"{type(e).__name__}: {e}"
        except (SyntaxError, ValueError) as e:
            error = error or f"{type(e).__name__}: {e}"
            at = min(max((getattr(e, "lineno", None) or 1) - 1, 0), max(len(lines) - 1, 0))
            at = next((k for k in [*range(at, len(lines)), *range(at - 1, -1, -1)] if k not in done), None)
            if at is None:
                return ast.parse(""), error
            done.add(at)
            body = lines[at].rstrip("\r\n")
            indent = body[: len(body) - len(body.lstrip(" \t"))]
            lines[at] = indent + ("if 1:" if body.rstrip().endswith(":") and at + 1 < len(lines) else "pass") + lines[at][len(body) :]


def parse(file: str, src: str) -> Parsed:
    out, where = Parsed(file), Offsets(src)
    end = len(src.encode("utf-8", "surrogatepass"))
    out.symbol("file", file, module_key(file), 0, end, 1)
    out.entrypoints.append(0)
    line_at = [0, *where.lines, len(src)]
    out.tokens = _tokens(src, line_at, where)
    tree, out.error = _tree(src)
    at = lambda line, col: where.byte(line_at[line - 1]) + col  # noqa: E731  ast columns are bytes
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    for n in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
        kind = "class" if isinstance(n, ast.ClassDef) else "function"
        plain = n if kind == "class" else type(n)(**{**{f: getattr(n, f, None) for f in n._fields}, "decorator_list": []})
        out.declare(kind, n.name, n.name, at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), n.lineno, cyclomatic(plain) if kind == "function" else None)
    keys = set()
    for s in tree.body:
        if isinstance(s, ast.Import):
            keys |= {a.name.replace(".", "/") for a in s.names if a.asname is None}
        elif isinstance(s, ast.ImportFrom):
            if not s.level:
                keys.add(s.module.replace(".", "/"))
            elif s.module:
                keys.add(relative_key(file, s.level, s.module))
            else:
                keys |= {relative_key(file, s.level, a.name) for a in s.names if a.asname is None and a.name != "*"}
    for k in sorted(keys):
        out.depend(k, 0, end, 1)
    calls = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
            calls.append((at(n.lineno, n.col_offset), n.func.id if isinstance(n.func, ast.Name) else n.func.attr))
    out.link(calls)
    return out
