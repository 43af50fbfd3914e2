"""Byte-level BPE over a vocabulary file: contiguous rank arrays for short words, many words at once."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts

# Fixed value: the word pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48
"""Bytes up to which a word's ranks are held in an array and scanned; a longer word uses a heap."""
CACHE = 200_000
"""Words of up to SHORT characters whose ids a worker remembers; beyond it the memory starts anew. Longer words are forgotten at once."""
NONE = np.int32(1 << 30)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a file: itself if printable Latin-1, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as bytes, and merges as a hash table from a pair of ids to (rank, id)."""

    tokens: list[bytes]
    special: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    cache: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.byte_ids = np.zeros(256, np.int32)
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        size = 1 << max(4, (2 * len(self.merges)).bit_length())
        self.mask = size - 1
        self.keys, self.ranks, self.ids = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        for (a, b), (rank, merged) in self.merges.items():
            key = (a << 32) | b
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.ids[at] = key, rank, merged
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.word = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def __reduce__(self):
        return Vocabulary, (self.tokens, self.special, self.merges)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of each pair of ids; rank NONE where the pair does not merge."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._slot(keys)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] >= 0)]
        return self.ranks[at], self.ids[at]

    def merge_short(self, words: np.ndarray) -> list[bytes]:
        """Ids of equally long words, given as rows of bytes.

        Each row holds its parts and the ranks of adjacent pairs side by side. Every round scans each row for its
        smallest rank (the leftmost on ties), deletes that boundary and looks up the two ranks beside it.
        """
        parts = self.byte_ids[words]
        n, length = parts.shape
        rank, merged = (x.reshape(n, length - 1) for x in self.find(parts[:, :-1].ravel(), parts[:, 1:].ravel()))
        rank, merged, live = rank.copy(), merged.copy(), np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            go = rank[rows, at] < NONE
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            parts[rows, at] = merged[rows, at]
            width = int(live[rows].max())
            col = np.arange(width - 1)
            after = col[None, :] + (col[None, :] > at[:, None])
            parts[rows[:, None], col[None, :]] = parts[rows[:, None], after]
            if width > 2:
                col = col[:-1]
                after = col[None, :] + (col[None, :] >= at[:, None])
                for x in (rank, merged):
                    x[rows[:, None], col[None, :]] = x[rows[:, None], after]
            rank[rows, width - 2] = NONE
            live[rows] -= 1
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < live[rows])
            for some, shift in ((left, -1), (right, 0)):
                r, c = rows[some], at[some] + shift
                rank[r, c], merged[r, c] = self.find(parts[r, c], parts[r, c + 1])
        data = parts.astype("<u4")
        return [data[i, : live[i]].tobytes() for i in range(n)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word by a heap of its pairs: the same merges in n log n."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = merged, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if 0 <= x and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the cache."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                self.cache[w] = int(self.byte_ids[raw[0]]).to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.cache[w] = self.merge_long(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for length, some in by_length.items():
            for lo in range(0, len(some), 8192):
                part = some[lo : lo + 8192]
                rows = np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(-1, length)
                self.cache.update(zip((w for w, _ in part), self.merge_short(rows), strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text are themselves."""
        split: list[list[str]] = []
        for t in batch:
            if self.marks is None or not self.marks.search(t):
                split.append(self.word.findall(t))
                continue
            pieces, last = [], 0
            for m in self.marks.finditer(t):
                pieces += [*self.word.findall(t[last : m.start()]), (m[0],)]
                last = m.end()
            split.append(pieces + self.word.findall(t[last:]))
        if len(self.cache) > CACHE:
            self.cache.clear()
        for s, i in self.special.items():
            self.cache[(s,)] = i.to_bytes(4, "little")
        new = set().union(*split) - self.cache.keys()
        self.learn(new)
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
        for w in new:
            if len(w) > SHORT:
                del self.cache[w]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.diff(self.token_at)[flat]
        ends = np.cumsum(size)
        data = self.token_bytes[np.repeat(self.token_at[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizers JSON file of byte-level BPE, read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for s, i in vocab.items():
        if s not in special:
            tokens[i] = raw(s)
    for s, i in special.items():
        tokens[i] = s.encode()
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return Vocabulary(tokens, special, merges)


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes]]]:
    for batch in batches:
        for lo, hi, buf, offs in texts(batch.column(1)):
            data, cuts = buf.tobytes(), offs.tolist()
            yield batch, lo, hi, vocabulary.encode([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` array<int>. Null and empty texts have no tokens; repeated rows are coded
    alike, null ids stay, other columns are left behind, an empty table gives an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, ids in _coded(batches, shared.value):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), lists], ["id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ``text`` of its ids, special tokens included. Null ids of tokens give an empty text; rows are otherwise
    treated as by ``encode``."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids = [b"" if x is None else np.asarray(x, "<u4").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.decode(ids), pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit), ``decoded_sha256``
    (of the text decoded from them, in UTF-8), and ``ids`` if asked for; encoded and decoded in one pass.
    Null texts count as empty ones; rows are otherwise treated as by ``encode``."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, ids in _coded(batches, shared.value):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            back = [sha(t.encode()) for t in shared.value.decode(ids)]
            cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array([sha(x) for x in ids], pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
