"""Repeated runs go whole: between any neighbours, and inside one line."""

import random

from codelake.llm.line_dedup import dedup_lines, without_repeated_lines


def texts(spark, rows):
    return {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_runs_between_other_neighbours(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = lambda: " ".join(word() for _ in range(10)) + rng.choice((".\n", "\n", ". "))
    shared = [[line() for _ in range(n)] for n in (2, 3, 4, 5, 6, 9)]
    rows, want, seen = [], {}, set()
    for i in range(40):
        parts, left = [], []
        for _ in range(4):
            own, run = line(), rng.randrange(len(shared))
            parts += [own, *shared[run]]
            left += [own, *([] if run in seen else shared[run])]
            seen.add(run)
        rows.append((i, "".join(parts)))
        want[i] = ("".join(left), len(parts), len(parts) - len(left))
    got = texts(spark, rows)
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items()} == want


def test_runs_inside_one_line(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n, mark=" ": mark.join(word() for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n))
    copies = [prose(80), prose(80, " | "), prose(5, " ") + "! " + prose(60) + "? " + prose(70), han(300), "x" * 500, "y " * 400]
    inside = [prose(60) for _ in range(10)] + [han(300)]
    rows = [(i, t) for i, t in enumerate(copies)] + [(100 + i, t) for i, t in enumerate(copies)]
    rows += [(200 + 100 * d + i, f"{prose(30)} {t} {prose(30)}") for d in range(2) for i, t in enumerate(inside)]
    rows += [(400, None), (401, ""), (402, "alone " * 3), (403, "alone " * 3)]
    got, text = texts(spark, rows), dict(rows)
    assert all(got[i].text == text[i] for i in text if i < 100 or 200 <= i < 300 or i >= 400)
    assert all(got[100 + i].text == "" for i in range(len(copies)))
    for i, t in enumerate(inside):  # a piece at either end may stay
        assert len(got[300 + i].text) < len(text[300 + i]) - 0.5 * len(t)
    left = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {i for i in text if not 100 <= i < 100 + len(copies)}
