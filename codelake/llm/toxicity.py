"""Toxic passages by maximum-scoring segments over token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import PUNCTUATION, U, hashes, spans, texts

FIT_ROWS = 20_000
"""Labelled documents a model is fitted on, by smallest hash of the id."""
MODEL_SIZE = 20_000
"""Features a model keeps, by largest z."""
PREFIXES = (6, 5, 4)
"""Bytes of a token's beginnings that count as features beside the whole token, so that forms never seen score too."""
PRIOR = 0.5
"""Dirichlet pseudo-count of each feature in each class."""
LEAST_Z, LEAST_ODDS = 3.0, 2.5
"""A feature counts as toxic from this many standard errors and this log-odds on."""
DROP = 0.5
"""Score lost on each other token."""
BIN = 0.25
"""Width of the bins in which segment scores of clean texts are counted."""


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    scale: float = 1.0
    """Karlin-Altschul's lambda: the chance that clean text reaches a segment score falls as exp(-scale * score)."""
    chance: float = 1.0
    """Karlin-Altschul's K: n clean tokens hold K * n * exp(-scale * score) segments of at least that score."""
    cut: float = 1.0
    """Evidence at which a document's score is 0.7."""

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.scores = self.keys[order], self.scores[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & U((1 << 20) - 1)).astype(np.int64)] = True


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of the whole tokens, then of their beginnings (the whole token again where it is no longer)."""
    return [hashes(buf, starts, ends), *(hashes(buf, starts, np.minimum(starts + n, ends)) + U(n) for n in PREFIXES)]


def _token_scores(model: Model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the tokens that have a feature of the model; the most specific one counts."""
    found = np.zeros(len(starts))
    if len(model.keys):
        for keys in _features(buf, starts, ends)[::-1]:
            hit = np.flatnonzero(model.maybe[(keys & U((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(model.keys, keys[hit]), len(model.keys) - 1)
            real = model.keys[at] == keys[hit]
            found[hit[real]] = model.scores[at[real]]
    places = np.flatnonzero(found)
    return places, found[places]


def segments(places: list[int], scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) in linear time: other tokens cost DROP each.

    A candidate is its sums before and after, its places, and the nearest earlier candidate of a smaller sum before. A
    search follows these links: what it skips can never be met again, so each candidate is skipped or merged once.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= DROP * (place - last - 1)
        left, right, first = total, total + score, place
        total, last = right, place
        j = len(kept) - 1
        while j >= 0 and kept[j][0] >= left:
            j = kept[j][4]
        while j >= 0 and kept[j][1] < right:
            left, _, first, _, below = kept[j]
            del kept[j:]
            j = below
        kept.append((left, right, first, place, j))
    return [(first, last, right - left) for left, right, first, last, _ in kept]


Passages = dict[int, list[tuple[int, int, float]]]


def _scan(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray], Passages]]:
    """(first row, end row, tokens of each text, scores of the hits and their offsets by text, passages by text in bytes) of each slice."""
    for lo, hi, buf, offs in texts(column):
        starts, ends, word_offs = spans(buf, offs, PUNCTUATION)
        places, scores = _token_scores(model, buf, starts, ends)
        at = np.searchsorted(places, word_offs)
        passages = {}
        for d in np.flatnonzero(np.diff(at)).tolist():
            own = slice(at[d], at[d + 1])
            found = segments((places[own] - word_offs[d]).tolist(), scores[own].tolist())
            passages[d] = [(int(starts[word_offs[d] + a] - offs[d]), int(ends[word_offs[d] + b] - offs[d]), s) for a, b, s in found]
        yield lo, hi, np.diff(word_offs), (scores, at), passages


def _evidence(model: Model, tokens: int, found: list[tuple[int, int, float]]) -> float:
    """Sum over passages of -ln of the expected number of chance passages as good in a clean text of this length."""
    return sum(max(0.0, model.scale * s - math.log(max(model.chance * tokens, 1.0))) for _, _, s in found)


def _scale(scores: np.ndarray, counts: np.ndarray, tokens: float) -> float:
    """Karlin-Altschul's lambda: the positive root of E[exp(lambda * score)] = 1 over clean tokens, of which ``counts`` have
    ``scores`` and all others lose DROP. Where clean tokens gain on average no root exists; the scale is then 0."""
    share = counts / tokens
    rest = 1 - share.sum()
    if (share * scores).sum() - rest * DROP >= 0:
        return 0.0
    over = lambda x: rest * math.exp(-DROP * x) + (share * np.exp(np.minimum(x * scores, 700.0))).sum() >= 1
    low, high = 0.0, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def training_rows(documents: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", label_col: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that are not held out; equal texts count once, toxic if any is."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic is not null and l_id is not null")
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic")).filter(~held_out)
    few = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    return documents.select(F.col(id_col).alias("l_id"), "text").join(F.broadcast(few), "l_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(rows: DataFrame) -> Model:
    """A model from (text, toxic) rows. Without toxic or without clean rows it knows no feature and scores all texts alike."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in texts(batch.column(0)):
                starts, ends, word_offs = spans(buf, offs, PUNCTUATION)
                keys = _features(buf, starts, ends)
                for kind in (0, 1):
                    own = [np.unique(np.concatenate([k[word_offs[d] : word_offs[d + 1]] for k in keys])) for d in range(hi - lo) if toxic[lo + d] == kind]
                    k, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n if kind else zero), pa.array(zero if kind else n)], ["key", "toxic", "clean"])

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # 0 and 1
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    counted = rows.select("text", "toxic").mapInArrow(count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("t >= 3")
    odds = lambda c, n: F.log((F.col(c) + PRIOR) / (n - F.col(c) + PRIOR))
    scored = counted.withColumn("odds", odds("t", n1) - odds("c", n0)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + PRIOR) + 1 / (F.col("c") + PRIOR)))
    best = scored.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "key").limit(MODEL_SIZE).select("key", "odds").collect()
    model = Model(np.array([r.key for r in best], np.int64).view(np.uint64), np.array([r.odds for r in best]))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, score, n) of clean texts: kind 0 their tokens, 1 scores of hits, 2 scores of segments, in bins."""
        for batch in batches:
            clean = batch.filter(pc.equal(batch.column(1), 0))
            for _, _, tokens, (scores, _), passages in _scan(clean.column(0), model):
                best = np.round([s / BIN for found in passages.values() for _, _, s in found]) * BIN
                for kind, values, weight in ((0, np.zeros(1), int(tokens.sum())), (1, scores, 1), (2, best, 1)):
                    value, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind)), pa.array(value), pa.array(n * weight)], ["kind", "score", "n"])

    counts = rows.select("text", "toxic").mapInArrow(histogram, "kind long, score double, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect()  # scores of the model, and bins
    of = lambda kind: np.array(sorted((r.score, r.n) for r in counts if r.kind == kind)).reshape(-1, 2)
    tokens = float(of(0)[:, 1].sum()) + 1
    hits = of(1) if len(of(1)) else np.array([[float(np.median(model.scores)) if len(model.scores) else 1.0, PRIOR]])
    model.scale = _scale(hits[:, 0], hits[:, 1], tokens) or 1.0
    best = of(2)
    if len(best):  # the segments from the median score on, as a tail of slope lambda
        upto = np.cumsum(best[:, 1])
        least = best[np.searchsorted(upto, upto[-1] / 2), 0]
        model.chance = float(best[best[:, 0] >= least, 1].sum() / tokens * math.exp(model.scale * least))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, tokens, _, passages in _scan(batch.column(0), model):
                yield pa.RecordBatch.from_arrays([pa.array(_evidences(model, lo, hi, tokens, passages)), batch.column(1).slice(lo, hi - lo)], ["x", "toxic"])

    evidence = sorted(((r.x, r.toxic) for r in rows.select("text", "toxic").mapInArrow(seen, "x double, toxic int").collect()), reverse=True)  # at most FIT_ROWS
    best_f, true = 0.0, 0
    for k, (x, toxic) in enumerate(evidence):
        true += toxic
        below = evidence[k + 1][0] if k + 1 < len(evidence) else 0.0
        if below < x and (f := 2 * true / (k + 1 + n1)) > best_f:
            best_f, model.cut = f, (x + below) / 2
    return model


def _evidences(model: Model, lo: int, hi: int, tokens: np.ndarray, passages: Passages) -> np.ndarray:
    return np.array([_evidence(model, int(tokens[d]), passages[d]) if d in passages else 0.0 for d in range(hi - lo)], np.float64)


def _scores(model: Model, lo: int, hi: int, tokens: np.ndarray, passages: Passages) -> np.ndarray:
    steep = 4.0 / max(model.cut, 1e-6)
    return 1 / (1 + np.exp(-np.clip(steep * (_evidences(model, lo, hi, tokens, passages) - model.cut) + math.log(0.7 / 0.3), -700, 700)))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, all columns as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, tokens, _, passages in _scan(batch.column(at), model):
                yield batch.slice(lo, hi - lo).filter(pa.array(_scores(model, lo, hi, tokens, passages) < threshold))

    return df.mapInArrow(run, df.schema)


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1), ``passages`` (start, end in UTF-8 bytes, score).

    Tokens are runs of letters and digits with A-Z lowered. Every maximal scoring segment of a whole text is found; its
    significance is that of Karlin and Altschul for the text's length, and the passages' significances add up. The score
    passes 0.7 at the evidence that best parts the training classes. Null and empty texts have no passage and score as
    a text without toxic features. Repeated rows score alike.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for lo, hi, tokens, _, passages in _scan(batch.column(1), model):
                score = _scores(model, lo, hi, tokens, passages)
                found = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in passages.get(d, [])] for d in range(hi - lo)], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), found], ["id", "score", "passages"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, passages array<struct<start: long, end: long, score: double>>").withColumnRenamed("id", id_col)


def fold(id_col: str | Column) -> Column:
    """CRC-32 of the id's text modulo 3; 1 is held out."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)), F.lit(0))
