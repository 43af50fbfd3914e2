"""Words of many texts at once: byte masks and 64-bit hashes over an Arrow column, in slices of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
"""Text bytes that are in work at once; one longer text is a slice of its own."""

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[:0x80] = [not chr(b).isalnum() for b in range(0x80)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(base: np.uint64, n: int, kind: str) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 1:
            _powers[kind] = have
    return have


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        size = int(offs[hi] - offs[lo])
        buf = np.frombuffer(data, np.uint8, size, int(offs[lo])) if size else np.zeros(0, np.uint8)
        yield lo, hi, buf, offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's offsets into them."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[buf]
    first, last = inside[1:-1].copy(), inside[1:-1].copy()
    first &= ~inside[:-2]
    last &= ~inside[2:]
    full = offs[1:] > offs[:-1]
    at = offs[:-1][full]
    first[at] |= inside[at + 1]
    at = offs[1:][full] - 1
    last[at] |= inside[at + 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span of folded bytes: a polynomial over random byte values, then mixed with the length."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold][buf] * _power(_ODD, n + 1, "up")[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INV, n + 1, "down")[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and the texts' offsets; a shorter text is one shingle."""
    n = np.diff(offs)
    place = U(0x2545F4914F6CDD1D)
    sums = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        sums = sums * place + words[j : j + len(sums)]
    valid = np.ones(len(words), bool)
    for j in range(1, k):
        at = offs[1:] - j
        valid[at[(at >= offs[:-1]) & (at >= 0)]] = False
    found = mix(sums[valid[: len(sums)]])
    count = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            extra[has] = extra[has] * place + words[offs[short[has]] + j]
        before = np.concatenate([[0], np.cumsum(count)])
        found = np.insert(found, before[short], mix(extra + n[short].astype(np.uint64)))
        count[short] = 1
    ends = np.concatenate([[0], np.cumsum(count)])
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        found[lo:hi].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[ends[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[ends]
