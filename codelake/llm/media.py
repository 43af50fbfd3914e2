"""Media columns: payloads stored as lossless WebP, and WebP files read back as pixel arrays and features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own
from .webp import decode, encode_grey
from .words import texts

LINE = 576
"""Payload bytes, and grey pixels, of a line."""
ROWS = 32
"""Lines of an image; a longer payload is stored as several files end to end."""
DECODE_BYTES = 2 << 20
"""Media bytes decoded side by side."""


def files(media: bytes) -> list[bytes]:
    """The WebP files that a media value holds end to end."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or at + 8 > len(media):
            raise ValueError("no WebP file where one should start")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (of the text in UTF-8), ``payload_bytes``, ``media``.

    The payload is the text's bytes (null: none) and bytes 255 up to a positive multiple of LINE; the media are lossless
    WebP files of ROWS such lines at most, one grey pixel for each byte. Equal texts give equal media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                n = np.diff(offs)
                full = np.maximum(-(-n // LINE), 1) * LINE
                ends = np.cumsum(full)
                data = np.full(int(ends[-1]), 255, np.uint8)
                data[np.arange(len(buf)) + np.repeat(ends - full - offs[:-1], n)] = buf
                sizes, count = [], []
                for size in full.tolist():
                    own = [min(LINE * ROWS, size - at) for at in range(0, size, LINE * ROWS)]
                    sizes += own
                    count.append(len(own))
                found = encode_grey(data, sizes, LINE)
                at = np.concatenate([[0], np.cumsum(count)]).tolist()
                media = pa.array([b"".join(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(full), media], ["id", "n_bytes", "payload_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, media binary").withColumnRenamed("id", id_col)


def _images(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """The images of each value; None for null values and for those that are no lossless WebP."""
    split = []
    for m in media:
        try:
            split.append(None if m is None else files(m))
        except ValueError:
            split.append(None)
    try:
        flat = iter(decode([f for s in split if s for f in s]))
        return [None if s is None else [next(flat) for _ in s] for s in split]
    except (ValueError, IndexError):
        if len(media) == 1:
            return [None]
        return [x for m in media for x in _images([m])]


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and total + size > DECODE_BYTES:
            yield lo, k
            lo, total = k, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def feature(grey: np.ndarray) -> str:
    """Mean, deviation and a 64-bit difference hash of 8 x 9 cells of a grey image."""
    mean, deviation = float(grey.mean()), float(grey.std())
    edge = lambda n, k: np.arange(k) * n // k
    rows = np.repeat(grey, -(-8 // grey.shape[0]), axis=0) if grey.shape[0] < 8 else grey
    cells = np.repeat(rows, -(-9 // rows.shape[1]), axis=1) if rows.shape[1] < 9 else rows
    height, width = cells.shape
    sums = np.add.reduceat(np.add.reduceat(cells.astype(np.int64), edge(height, 8), axis=0), edge(width, 9), axis=1)
    area = np.diff(np.append(edge(height, 8), height))[:, None] * np.diff(np.append(edge(width, 9), width))[None, :]
    cell = sums * 4096 // area
    bits = (cell[:, 1:] > cell[:, :-1]).ravel()
    return f"mean={mean:.3f};std={deviation:.3f};dhash={np.packbits(bits).tobytes().hex()}"


def read_pixels(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: id and ``images``, an array of (width, height, ARGB pixels as little-endian 32-bit integers).

    Null where the media are null or no lossless WebP; an empty value has no image.
    """
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(1).to_pylist()
            for lo, hi in _runs([len(m or b"") for m in media]):
                found = [None if x is None else [{"width": w, "height": h, "pixels": p.astype("<u4").tobytes()} for w, h, p in x] for x in _images(media[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found, kind)], ["id", "images"])

    id_kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {id_kind}, images array<struct<width: int, height: int, pixels: binary>>").withColumnRenamed("id", id_col)


def payload_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``df`` without the media, plus digests and a feature of what is decoded from them (null where nothing can be):
    ``payload_sha256``, ``tail_crc32`` (of the last 32 bytes), ``media_bytes``, ``media_sha256``, ``feature`` (clashing names get a leading _)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    others = [c for c in df.columns if c != media_col]
    new = own(df, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(others)).to_pylist()
            for lo, hi in _runs([len(m or b"") for m in media]):
                rows = []
                for m, images in zip(media[lo:hi], _images(media[lo:hi]), strict=True):
                    if not images:
                        rows.append((None, None, None if m is None else len(m), None if m is None else sha(m), None))
                        continue
                    grey = np.concatenate([(p >> np.uint32(8)).astype(np.uint8) for _, _, p in images])
                    payload = grey.tobytes()
                    rows.append((sha(payload), zlib.crc32(payload[-32:]), len(m), sha(m), feature(grey.reshape(-1, images[0][0]))))
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(others))), *found], [*others, *new])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*(F.col(f"`{c}`") for c in others), F.col(media_col)).mapInArrow(run, ", ".join([schema, *(f"`{c}` {t}" for c, t in zip(new, ("string", "long", "long", "string", "string"), strict=True))]))
