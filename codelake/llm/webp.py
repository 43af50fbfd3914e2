"""Lossless WebP: a decoder of many images at once, and an encoder of grey payloads."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
BLACK = 0xFF000000
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
"""The 120 neighbours that short distance codes name, nearest first."""

FIRST = 8
"""Bits of a prefix code's first table; longer codes go on in a second one."""


class Bits:
    """Reads little-endian bits; past the end they are an error."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.at
        if p + n > self.end:
            raise ValueError("the image's data end early")
        self.at = p + n
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7) & ((1 << n) - 1)


def _reverse(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2)


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(length, code as read from the first bit on, symbol) of each used symbol. A code must be complete, or one symbol."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return [(0, 0, used[0][1])]
    if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
        raise ValueError("an incomplete or overfull prefix code")
    out, code, last = [], 0, used[0][0]
    for n, s in used:
        code <<= n - last
        last = n
        out.append((n, _reverse(code, n), s))
        code += 1
    return out


def table(codes: list[tuple[int, int, int]]) -> np.ndarray:
    """Entries symbol << 8 | length by the next FIRST bits; longer codes: place << 8 | 128 + bits of the second table."""
    long: dict[int, list[tuple[int, int, int]]] = {}
    out = np.zeros(1 << FIRST, np.int32)
    for n, c, s in codes:
        if n <= FIRST:
            out[c :: 1 << n] = s << 8 | n
        else:
            long.setdefault(c & ((1 << FIRST) - 1), []).append((n, c, s))
    parts, size = [out], len(out)
    for head, some in long.items():
        bits = max(n for n, _, _ in some) - FIRST
        second = np.zeros(1 << bits, np.int32)
        for n, c, s in some:
            second[c >> FIRST :: 1 << (n - FIRST)] = s << 8 | n
        out[head] = size << 8 | 128 + bits
        parts.append(second)
        size += len(second)
    return np.concatenate(parts)


def read_code(bits: Bits, alphabet: int) -> list[tuple[int, int, int]]:
    """One prefix code of the stream, in its simple or its normal form."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = [0] * max(alphabet, 256)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return canonical(lengths)
    meta = [0] * 19
    for k in range(4 + bits.read(4)):
        meta[LENGTH_ORDER[k]] = bits.read(3)
    look = [(0, 0)] * 128
    for n, c, s in canonical(meta):
        for k in range(c, 128, 1 << n):
            look[k] = (n, s)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: list[int] = []
    last, data, p = 8, bits.data, bits.at
    while len(lengths) < alphabet and left:
        left -= 1
        w = int.from_bytes(data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)
        n, s = look[w & 127]
        p += n
        w >>= n
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + (w & 3))
            p += 2
        elif s == 17:
            lengths += [0] * (3 + (w & 7))
            p += 3
        else:
            lengths += [0] * (11 + (w & 127))
            p += 7
    if len(lengths) > alphabet or p > bits.end:
        raise ValueError("code lengths beyond the alphabet or the data")
    bits.at = p
    return canonical(lengths + [0] * (alphabet - len(lengths)))


@dataclass
class Job:
    """One entropy-coded image whose pixels are still to be read, from ``bits.at`` on."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    groups: list[list[np.ndarray]]
    meta_bits: int = 0
    meta: np.ndarray | None = None
    pixels: np.ndarray | None = None
    transforms: list[tuple] = field(default_factory=list)
    size: tuple[int, int] = (0, 0)


def _open(bits: Bits, width: int, height: int, top: bool) -> Job:
    """Everything of an entropy-coded image before its pixels."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("colour cache bits out of range")
    meta_bits, meta = 0, None
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        sub = _open(bits, -(-width >> meta_bits), -(-height >> meta_bits), False)
        read_pixels([sub])
        meta = (sub.pixels >> 8 & 0xFFFF).astype(np.int64).reshape(sub.height, sub.width)
    alphabets = (LITERALS + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    groups = [[table(read_code(bits, a)) for a in alphabets] for _ in range(1 if meta is None else int(meta.max()) + 1)]
    return Job(bits, width, height, cache, groups, meta_bits, meta)


def _value(prefix: np.ndarray, take) -> np.ndarray:
    """Lengths and distances: a prefix symbol and, from 4 on, extra bits read by ``take``."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    extra[prefix < 4] = 0
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + take(extra) + 1


def read_pixels(jobs: list[Job]) -> None:
    """Read the pixels of all images side by side, one symbol of each at a time, into ``pixels`` (ARGB).

    A symbol of the green alphabet is a literal, after which red, blue and alpha follow; a back-reference, whose length
    and distance have extra bits; or a place in the colour cache, which holds every pixel under its hash.
    """
    tables, at, start = [], 0, {}
    plain = np.zeros(len(jobs), bool)
    rest = np.zeros(len(jobs), np.int64)
    first_group, codes = [], []
    for k, j in enumerate(jobs):
        first_group.append(len(codes))
        for g in j.groups:
            own = []
            for t in g:
                if id(t) not in start:
                    start[id(t)] = at
                    tables.append(t)
                    at += len(t)
                own.append(start[id(t)])
            codes.append(own)
        g = j.groups[0]
        plain[k] = len(j.groups) == 1 and all((t[0] & 0xFF) == 0 for t in g[1:4])
        rest[k] = (int(g[1][0]) >> 8) << 16 | int(g[2][0]) >> 8 | (int(g[3][0]) >> 8) << 24
    first_group, codes, flat = np.array(first_group), np.array(codes, np.int64), np.concatenate(tables).astype(np.int64)
    base = np.cumsum([0, *(len(j.bits.data) + 8 for j in jobs)])
    raw = np.frombuffer(b"".join(x for j in jobs for x in (j.bits.data, b"\0" * 8)) + b"\0" * 8, np.uint8)
    window = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        window |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    pos = np.array([8 * b + j.bits.at for b, j in zip(base, jobs, strict=False)], np.int64)
    limit = np.array([8 * (b + len(j.bits.data)) for b, j in zip(base, jobs, strict=False)], np.int64)
    sizes = np.array([j.width * j.height for j in jobs], np.int64)
    ends = np.cumsum(sizes)
    put = ends - sizes
    begin, width = put.copy(), np.array([j.width for j in jobs], np.int64)
    out = np.zeros(int(ends[-1]), np.uint32)
    cache_bits = np.array([j.cache_bits for j in jobs], np.int64)
    cache_at = np.cumsum(np.where(cache_bits, 1 << cache_bits, 0))
    caches = np.zeros(int(cache_at[-1]) + 1, np.uint32)
    cache_at -= np.where(cache_bits, 1 << cache_bits, 0)
    near_x, near_y = np.array(NEAR).T
    metas = {k: j for k, j in enumerate(jobs) if j.meta is not None}

    def symbol(rows: np.ndarray, tabs: np.ndarray) -> np.ndarray:
        p = pos[rows]
        w = (window[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64)
        e = flat[tabs + (w & ((1 << FIRST) - 1))]
        n = e & 0xFF
        deep = np.flatnonzero(n > 127)
        if len(deep):
            e[deep] = flat[tabs[deep] + (e[deep] >> 8) + ((w[deep] >> FIRST) & ((1 << (n[deep] - 128)) - 1))]
            n = e & 0xFF
        pos[rows] = p + n
        return e >> 8

    def extra(rows: np.ndarray):
        def take(n: np.ndarray) -> np.ndarray:
            p = pos[rows]
            pos[rows] = p + n
            return (window[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)

        return take

    def remember(rows: np.ndarray, colours: np.ndarray) -> None:
        has = cache_bits[rows] > 0
        rows, colours = rows[has], colours[has]
        h = ((colours.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits[rows])
        caches[cache_at[rows] + h] = colours

    live = np.flatnonzero(sizes > 0)
    any_cache = bool(cache_bits.any())
    all_plain = bool(plain.all()) and not metas
    green = codes[first_group, 0]
    while len(live):
        if metas:
            group = first_group[live].copy()
            for i, k in enumerate(live.tolist()):
                if k in metas:
                    j = metas[k]
                    y, x = divmod(int(put[k] - begin[k]), j.width)
                    group[i] += j.meta[y >> j.meta_bits, x >> j.meta_bits]
            tab = codes[group]
            s = symbol(live, tab[:, 0])
        else:
            tab = None
            s = symbol(live, green[live])
        if int(s.max()) < LITERALS and all_plain and not any_cache:
            out[put[live]] = rest[live] | s << 8
            put[live] += 1
        else:
            tab = codes[first_group[live]] if tab is None else tab
            literal = np.flatnonzero(s < LITERALS)
            if len(literal):
                rows = live[literal]
                colour = s[literal] << 8
                for c, shift in ((1, 16), (2, 0), (3, 24)):
                    colour |= symbol(rows, tab[literal, c]) << shift
                out[put[rows]] = colour
                if any_cache:
                    remember(rows, colour)
                put[rows] += 1
            known = np.flatnonzero(s >= LITERALS + LENGTHS)
            if len(known):
                rows = live[known]
                colour = caches[cache_at[rows] + s[known] - LITERALS - LENGTHS]
                out[put[rows]] = colour
                remember(rows, colour)
                put[rows] += 1
            back = np.flatnonzero((s >= LITERALS) & (s < LITERALS + LENGTHS))
            if len(back):
                rows = live[back]
                length = _value(s[back] - LITERALS, extra(rows))
                code = _value(symbol(rows, tab[back, 4]), extra(rows))
                close = np.minimum(code, len(NEAR)) - 1
                distance = np.where(code > len(NEAR), code - len(NEAR), np.maximum(near_x[close] + near_y[close] * width[rows], 1))
                if (distance > put[rows] - begin[rows]).any() or (put[rows] + length > ends[rows]).any():
                    raise ValueError("a back-reference outside its image")
                for t in range(int(length.max())):
                    go = length > t
                    to = put[rows[go]] + t
                    colour = out[to - distance[go]]
                    out[to] = colour
                    if any_cache:
                        remember(rows[go], colour)
                put[rows] += length
        if (pos[live] > limit[live]).any():
            raise ValueError("the image's data end early")
        done = put[live] >= ends[live]
        if done.any():
            live = live[~done]
    for k, j in enumerate(jobs):
        j.pixels = out[begin[k] : ends[k]]
        j.bits.at = int(pos[k] - 8 * base[k])


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def unpredict(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Add each pixel's prediction from its left, top, top-left and top-right neighbours, channel by channel modulo 256."""
    diff = pixels.reshape(height, width).view(np.uint8).reshape(height, width, 4).astype(np.int32)
    out = np.zeros((height * width + 1, 4), np.int32)
    black = np.array([0, 0, 0, 255])
    across = -(-width >> bits)
    kinds = (modes.reshape(-1, across) >> 8 & 0xFF).astype(int).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not at:
                guess = black
            elif not y:
                guess = out[at - 1]
            elif not x:
                guess = out[at - width]
            else:
                left, top, corner, right = out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1]
                kind = kinds[y >> bits][x >> bits]
                if kind == 1:
                    guess = left
                elif kind == 2:
                    guess = top
                elif kind == 3:
                    guess = right
                elif kind == 4:
                    guess = corner
                elif kind == 5:
                    guess = _average(_average(left, right), top)
                elif kind == 6:
                    guess = _average(left, corner)
                elif kind == 7:
                    guess = _average(left, top)
                elif kind == 8:
                    guess = _average(corner, top)
                elif kind == 9:
                    guess = _average(top, right)
                elif kind == 10:
                    guess = _average(_average(left, corner), _average(top, right))
                elif kind == 11:
                    guess = left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
                elif kind == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                elif kind == 13:
                    mean = _average(left, top)
                    half = mean - corner
                    guess = np.clip(mean + (np.abs(half) >> 1) * np.sign(half), 0, 255)
                else:
                    guess = black
            out[at] = (diff[y, x] + guess) & 255
    return np.ascontiguousarray(out[:-1].astype(np.uint8)).view(np.uint32).ravel()


def uncross(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray) -> np.ndarray:
    """Undo the cross-colour transform: red from green, then blue from green and the new red, by signed factors over 32."""
    y, x = np.divmod(np.arange(width * height), width)
    e = elements.reshape(-1, -(-width >> bits))[y >> bits, x >> bits]
    signed = lambda v: (v & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(pixels >> 8)
    red = (pixels >> 16).astype(np.int32) + (signed(e) * green >> 5) & 0xFF
    blue = pixels.astype(np.int64).astype(np.int32) + (signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(red) >> 5) & 0xFF
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def ungreen(pixels: np.ndarray) -> np.ndarray:
    """Undo the subtraction of green from red and blue."""
    g = pixels >> np.uint32(8) & np.uint32(0xFF)
    return pixels & np.uint32(0xFF00FF00) | (pixels + (g << np.uint32(16))) & np.uint32(0xFF0000) | (pixels + g) & np.uint32(0xFF)


def unpalette(pixels: np.ndarray, width: int, height: int, packed: int, palette: np.ndarray) -> np.ndarray:
    """Colours by index; up to 8 indices of a small palette share a pixel's green, from the low bits on."""
    index = (pixels >> 8 & 0xFF).astype(np.int64)
    if packed:
        size = 8 >> packed
        index = (index.reshape(height, -1, 1) >> (size * np.arange(1 << packed)) & ((1 << size) - 1)).reshape(height, -1)[:, :width].ravel()
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def _riff(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    if 20 + size > len(data):
        raise ValueError("the file ends early")
    return data[20 : 20 + size]


def _start(data: bytes) -> Job:
    bits = Bits(_riff(data))
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, across, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == 2:
            transforms.append((kind, across))
        elif kind == 3:
            size = bits.read(8) + 1
            sub = _open(bits, size, 1, False)
            read_pixels([sub])
            parts = np.cumsum(sub.pixels.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, across, packed, np.ascontiguousarray(parts).view(np.uint32).ravel()))
            across = -(-across >> packed)
        else:
            shift = bits.read(3) + 2
            sub = _open(bits, -(-across >> shift), -(-height >> shift), False)
            read_pixels([sub])
            transforms.append((kind, across, shift, sub.pixels))
    job = _open(bits, across, height, True)
    job.transforms, job.size = transforms, (width, height)
    return job


def decode(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB pixels) of each lossless WebP file; ValueError for what is none."""
    jobs = [_start(f) for f in files]
    if jobs:
        read_pixels(jobs)
    out = []
    for j in jobs:
        p = j.pixels
        for kind, width, *rest in reversed(j.transforms):
            if kind == 0:
                p = unpredict(p, width, j.height, *rest)
            elif kind == 1:
                p = uncross(p, width, j.height, *rest)
            elif kind == 2:
                p = ungreen(p)
            else:
                p = unpalette(p, width, j.height, *rest)
        out.append((*j.size, p))
    return out


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; counts are halved until they fit. One symbol has length 1."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    shift = 0
    while True:
        heap = [((counts[s] >> shift) or 1, k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        parent, node = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
            node += 1
        depth = [0] * node
        for k in range(node - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= most:
            for k, s in enumerate(used):
                lengths[s] = depth[k]
            return lengths
        shift += 1


class Writer:
    """Collects little-endian bits."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def write_code(out: Writer, lengths: list[int]) -> None:
    """A prefix code in its shortest usual form."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256 and all(lengths[s] == 1 for s in used):
        out.put(1, 1)
        out.put(len(used) == 2, 1)
        first = used[0] if used else 0
        out.put(first > 1, 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    runs: list[tuple[int, int, int]] = []
    k = 0
    while k < len(lengths):
        if lengths[k]:
            runs.append((lengths[k], 0, 0))
            k += 1
            continue
        end = k
        while end < len(lengths) and not lengths[end]:
            end += 1
        while k < end:
            run = min(end - k, 138)
            runs.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3) if run >= 3 else (0, 0, 0))
            k += run if run >= 3 else 1
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    meta = code_lengths(counts, 7)
    upto = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if meta[s]))
    out.put(0, 1)
    out.put(upto - 4, 4)
    for s in LENGTH_ORDER[:upto]:
        out.put(meta[s], 3)
    out.put(0, 1)
    codes = {s: (c, n) for n, c, s in canonical(meta)}
    for s, more, bits in runs:
        out.put(*codes[s])
        out.put(more, bits)


def encode_grey(data: np.ndarray, sizes: list[int], width: int) -> list[bytes]:
    """A file for each of ``sizes`` bytes of ``data``, whole lines of ``width`` grey pixels: green is coded, red and blue are green less itself.

    All images' symbols are laid out and packed together.
    """
    image = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(image * 256 + data, minlength=256 * len(sizes)).reshape(-1, 256).tolist()
    code, length = np.zeros((len(sizes), 256), np.uint64), np.zeros((len(sizes), 256), np.int64)
    heads = []
    for k, c in enumerate(counts):
        lengths = code_lengths(c, 15)
        for n, bits, s in canonical(lengths):
            code[k, s], length[k, s] = bits, n
        out = Writer()
        out.put(0x2F, 8)
        out.put(width - 1, 14)
        out.put(sizes[k] // width - 1, 14)
        out.put(0, 4)  # no alpha, version 0
        out.put(0b101, 3)  # subtract green
        out.put(0, 3)  # no more transforms, no colour cache, one group
        write_code(out, lengths + [0] * LENGTHS)
        for constant in (0, 0, 255, 0):
            write_code(out, [0] * constant + [1])
        heads.append(out)
    value, bits = code.ravel()[image * 256 + data], length.ravel()[image * 256 + data]
    stop = np.cumsum(bits)
    last = stop[np.cumsum(sizes) - 1]
    total = np.diff(np.concatenate([[0], last]))
    words = (np.array([h.n for h in heads]) + total + 63) // 32 + 1
    word_at = np.cumsum(words) - words
    at = stop - bits - np.repeat(np.concatenate([[0], last[:-1]]), sizes) + np.repeat(word_at * 32 + np.array([h.n for h in heads]), sizes)
    wide = value << (at & 31).astype(np.uint64)
    packed = np.bincount(at >> 5, wide & np.uint64(0xFFFFFFFF), int(words.sum()) + 1)
    packed[1:] += np.bincount(at >> 5, wide >> np.uint64(32), int(words.sum()) + 1)[:-1]
    packed = packed.astype("<u4")
    files = []
    for k, h in enumerate(heads):
        body = packed[word_at[k] : word_at[k] + words[k]].tobytes()
        head = h.value.to_bytes((h.n + 7) // 8, "little")
        shared = int.from_bytes(body[: len(head)], "little") | h.value
        n = (h.n + int(total[k]) + 7) // 8
        chunk = (shared.to_bytes(len(head), "little") + body[len(head) :])[:n]
        pad = b"\0" * (n & 1)
        files.append(b"RIFF" + struct.pack("<I", 12 + n + len(pad)) + b"WEBPVP8L" + struct.pack("<I", n) + chunk + pad)
    return files
