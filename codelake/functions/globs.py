"""Path globs as regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str | None:
    """An anchored expression, or None for a malformed glob.

    ``*`` and ``?`` stay within a path segment, ``**`` crosses them, ``{a,b}`` alternates, ``[..]`` is a class.
    """
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            before, after = i == 0 or glob[i - 1] == "/", glob[i + 2 : i + 3]
            if before and after == "/":
                out.append("(?:.*/)?")
                i += 3
                continue
            if before and after == "" and i:
                out.append(".+")
                i += 2
                continue
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in "!^]" else i + 1)
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner).replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        return None
    pattern = "^" + "".join(out) + "$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; malformed ones match nothing, no glob matches nothing."""
    patterns = [p for g in globs if (p := glob_to_regex(g))]
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
