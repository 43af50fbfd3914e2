"""Language by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import texts

FIT_CHARS = 32_000
"""Symbols of labelled text in each language's automaton."""
FIT_TOTAL = 256_000
"""Symbols of all automata together, so that their tables fit in a worker: with more than 8 languages each gets an equal part."""
FIT_ROWS = 400
"""Labelled documents of each language that this text is drawn from, by smallest hash of the id. Each gives an equal piece."""
PIECE = 80
"""Symbols such a piece has at least, where the documents are long enough: with many languages fewer documents are drawn."""
LANES = 65_536
"""Parses that advance together."""
BLOCK = 4096
"""Symbols parsed at a stretch: a longer text is the sum of its blocks, so that no text takes more steps than that."""


def symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z (and their Latin-1 relatives) lowered, every run of other ASCII as one space; offsets; has a letter.

    Digits, punctuation and white space say nothing of a language and become the space.
    """
    fold = np.full(256, ord(" "), np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    for c in range(26):
        fold[[0x41 + c, 0x61 + c]] = 0x61 + c
    out = fold[buf]
    if len(buf) > 1:
        upper = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][upper] += 0x20
    keep = np.ones(len(out), bool)
    if len(out) > 1:
        keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20)
        keep[offs[:-1][offs[:-1] < len(out)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    letter = count((out >= 0x61) & (out <= 0x7A)) > 0
    for d in np.flatnonzero(~letter & (count(out >= 0x80) > 0)).tolist():  # other scripts, or none
        letter[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
    return out[keep], at[offs], letter


@dataclass
class Automata:
    """Suffix automata of all languages in one table: ``step[state * width + symbol class]`` is the next state, -1 for none."""

    names: list[str]
    width: int
    classes: np.ndarray
    step: np.ndarray
    roots: np.ndarray
    weight: np.ndarray
    """log2 of each reference text's length: the cost of naming one phrase."""


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``, from state 0."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def build(references: dict[str, bytes]) -> Automata:
    used = sorted(set(b"".join(references.values())))
    classes = np.zeros(256, np.uint8)  # class 0: a byte no reference holds
    classes[used] = np.arange(1, len(used) + 1)
    width, parts, roots, base = len(used) + 1, [], [], 0
    for text in references.values():
        rows = suffix_automaton(text)
        flat = np.full(len(rows) * width, -1, np.int32)
        for s, to in enumerate(rows):
            for c, q in to.items():
                flat[s * width + int(classes[c])] = base + q
        parts.append(flat)
        roots.append(base)
        base += len(rows)
    weight = np.log2([max(len(t), 2) for t in references.values()])
    return Automata(list(references), width, classes, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(roots, np.int64), weight)


def phrases(model: Automata, syms: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of phrases of each text (rows) in each language (columns): each phrase is the longest match from its start on.

    All (block, language) parses advance one symbol a step. Where the automaton has no transition the phrase ends and the
    symbol starts the next one; a symbol the language never holds is a phrase of its own, and a block ends a phrase.
    """
    n, m = len(offs) - 1, len(model.names)
    out = np.zeros((n, m), np.int64)
    cls = model.classes[syms]
    blocks = np.maximum(-(-np.diff(offs) // BLOCK), 1)
    text = np.repeat(np.arange(n), blocks)
    starts = offs[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    size = np.minimum(offs[text + 1] - starts, BLOCK)
    order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
    group = max(1, LANES // max(m, 1))
    for g in range(0, len(order), group):
        rows = order[g : g + group]
        length = size[rows]
        lens = np.repeat(length, m)
        at = np.repeat(starts[rows], m)
        root = np.tile(model.roots, len(rows))
        state, count = root.copy(), np.zeros(len(rows) * m, np.int64)
        running = np.searchsorted(-lens, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        for t, live in enumerate(running.tolist()):
            c = cls[at[:live] + t].astype(np.int64)
            to = model.step[state[:live] * model.width + c]
            lost = np.flatnonzero(to < 0)
            if len(lost):
                here = root[lost]
                count[lost] += state[lost] != here
                again = model.step[here * model.width + c[lost]]
                none = again < 0
                count[lost[none]] += 1
                to[lost] = np.where(none, here, again)
            state[:live] = to
        np.add.at(out, text[rows], (count + (state != root)).reshape(len(rows), m))
    return out


def fit(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, chars: int = FIT_CHARS, total: int = FIT_TOTAL) -> Automata:
    """Automata of the labelled texts that are not held out, one for every label.

    A label gets ``chars`` symbols, or an equal part of ``total`` with many labels, from at most about ``rows`` documents
    by hash of the id. Each gives a piece of the same size, from a place drawn from its id's hash, anywhere in the text.
    """
    known = documents.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out)
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # one row a label
    if not counts:
        return build({})
    size = max(1, min(chars, total // len(counts)))
    few = max(1, min(rows, size // PIECE))
    plan = documents.sparkSession.createDataFrame([(r.lang, min(1.0, few / r.n), 2 * -(-size // min(few, r.n))) for r in counts], f"p_lang {documents.schema[lang_col].dataType.simpleString()}, part double, width int")
    scale = 1 << 30
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(scale))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.greatest(F.length(text_col) - F.col("width"), F.lit(0)) + 1).cast("int") + 1
    drawn = known.select(F.col(id_col), F.col(lang_col), F.col(text_col)).join(F.broadcast(plan), F.col(lang_col) == F.col("p_lang"))  # one row a label
    drawn = drawn.filter(lot < F.col("part") * scale).select("p_lang", lot.alias("lot"), F.substring(F.col(text_col), place, F.col("width")).alias("text"))
    parts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.distinct().collect(), key=lambda r: (r.p_lang, r.lot, r.text)):  # about twice ``total`` characters
        for _, _, buf, offs in texts(pa.array([r.text])):
            parts.setdefault(r.p_lang, []).append(symbols(buf, offs)[0].tobytes())
    return build({k: b" ".join(x[: -(-size // len(v))] for x in v)[:size] for k, v in sorted(parts.items())})


def identify(df: DataFrame, model: Automata, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (0 to 1).

    A language's cost is its number of phrases times log2 of its reference's length; the least cost wins, the first name
    on ties. ``score`` is the winner's margin: one less its cost over the second's. Null texts, texts without a letter
    and all texts under a model without languages are ``und`` with score 0; with one language the score is 1.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.names, "und"])
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                syms, at, letter = symbols(buf, offs)
                if len(model.names):
                    cost = phrases(model, syms, at) * model.weight
                    best = cost.argmin(axis=1)
                    two = np.sort(cost, axis=1)
                    score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9) if len(model.names) > 1 else np.ones(len(letter))
                    best, score = np.where(letter, best, len(model.names)), np.where(letter, score, 0.0)
                else:
                    best, score = np.zeros(len(letter), np.int64), np.zeros(len(letter))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names.take(pa.array(best)), pa.array(score)], ["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
