"""Lossless WebP: images written here with every feature of the format, and damaged files."""

import base64
import random

import numpy as np
import pytest

from codelake.llm import webp

GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)


def channels(p):
    return [p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24]


def pixel(c):
    return c[0] | c[1] << 8 | c[2] << 16 | c[3] << 24


def predict(mode, left, top, corner, right):
    half = lambda a, b: (a + b) // 2
    clip = lambda v: min(255, max(0, v))
    rows = list(zip(*map(channels, (left, top, corner, right)), strict=True))
    if mode == 11:
        near = sum(abs(t - c) for _, t, c, _ in rows), sum(abs(a - c) for a, _, c, _ in rows)
        return left if near[0] < near[1] else top
    each = {
        0: None, 1: lambda a, t, c, r: a, 2: lambda a, t, c, r: t, 3: lambda a, t, c, r: r, 4: lambda a, t, c, r: c, 5: lambda a, t, c, r: half(half(a, r), t),
        6: lambda a, t, c, r: half(a, c), 7: lambda a, t, c, r: half(a, t), 8: lambda a, t, c, r: half(c, t), 9: lambda a, t, c, r: half(t, r),
        10: lambda a, t, c, r: half(half(a, c), half(t, r)), 12: lambda a, t, c, r: clip(a + t - c), 13: lambda a, t, c, r: clip(half(a, t) + int((half(a, t) - c) / 2)),
    }[mode]
    return 0xFF000000 if each is None else pixel([each(*x) for x in rows])


def subtract(p, q):
    return pixel([(a - b) & 255 for a, b in zip(channels(p), channels(q), strict=True)])


def prefix(value):
    """(symbol, extra bits, their value) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    bits = v.bit_length() - 2
    return 2 * bits + 2 + (v >> bits & 1), bits, v & ((1 << bits) - 1)


def write_pixels(out, pixels, width, rng, cache_bits=0, lz=False, groups=None, top=True):
    """Entropy-code pixels; ``groups`` is (bits, group of each tile)."""
    tokens, i, cache = [], 0, {}
    put = lambda p: cache.__setitem__((p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits), p) if cache_bits else None
    while i < len(pixels):
        best = (0, 0)
        if lz and i:
            for d in {1, width, width + 1, max(1, width - 1), rng.randrange(1, i + 1), min(i, 150)}:
                n = 0
                while d <= i and i + n < len(pixels) and n < 4096 and pixels[i + n] == pixels[i + n - d]:
                    n += 1
                best = max(best, (n, d))
        slot = (pixels[i] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 2:
            n, d = best
            code = d + 120
            for k, (x, y) in enumerate(webp.NEAR):
                if max(1, x + y * width) == d and rng.random() < 0.8:
                    code = k + 1
                    break
            tokens.append((i, "copy", n, code))
        elif cache_bits and cache.get(slot, 0) == pixels[i]:
            n = 1
            tokens.append((i, "cache", slot, 0))
        else:
            n = 1
            tokens.append((i, "pixel", pixels[i], 0))
        for p in pixels[i : i + n]:
            put(p)
        i += n
    out.put(int(bool(cache_bits)), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_of = lambda at: 0
    if top:
        out.put(int(groups is not None), 1)
        if groups is not None:
            bits, image = groups
            across = -(-width >> bits)
            out.put(bits - 2, 3)
            write_pixels(out, [0xFF000000 | g << 8 for g in image], across, rng, top=False)
            group_of = lambda at: image[(at // width >> bits) * across + (at % width >> bits)]
    n_groups = 1 + max([0, *(groups[1] if groups else [])])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(n_groups)]
    for at, kind, a, b in tokens:
        c = counts[group_of(at)]
        if kind == "pixel":
            blue, green, red, alpha = channels(a)
            for k, s in ((GREEN, green), (RED, red), (BLUE, blue), (ALPHA, alpha)):
                c[k][s] += 1
        elif kind == "cache":
            c[GREEN][280 + a] += 1
        else:
            c[GREEN][256 + prefix(a)[0]] += 1
            c[DISTANCE][prefix(b)[0]] += 1
    codes = []
    for c in counts:
        own = []
        for k in c:
            k[0] += not any(k)
            lengths = webp.code_lengths(k, 15)
            webp.write_code(out, lengths)
            own.append({s: (code, n) for n, code, s in webp.canonical(lengths)})
        codes.append(own)
    for at, kind, a, b in tokens:
        c = codes[group_of(at)]
        if kind == "pixel":
            blue, green, red, alpha = channels(a)
            for k, s in ((GREEN, green), (RED, red), (BLUE, blue), (ALPHA, alpha)):
                out.put(*c[k][s])
        elif kind == "cache":
            out.put(*c[GREEN][280 + a])
        else:
            for k, v, base in ((GREEN, a, 256), (DISTANCE, b, 0)):
                s, n, rest = prefix(v)
                out.put(*c[k][base + s])
                out.put(rest, n)


def write(pixels, width, height, transforms, rng, **options):
    out = webp.Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    across = width
    for name in transforms:
        out.put(1, 1)
        out.put(("predictor", "cross", "green", "palette").index(name), 2)
        if name == "predictor":
            bits = rng.randrange(2, 5)
            wide = -(-across >> bits)
            modes = [rng.randrange(14) for _ in range(wide * -(-height >> bits))]
            out.put(bits - 2, 3)
            write_pixels(out, [0xFF000000 | m << 8 for m in modes], wide, rng, top=False)
            rest = []
            for at, p in enumerate(pixels):
                y, x = divmod(at, across)
                if not at:
                    guess = 0xFF000000
                elif not y:
                    guess = pixels[at - 1]
                elif not x:
                    guess = pixels[at - across]
                else:
                    guess = predict(modes[(y >> bits) * wide + (x >> bits)], pixels[at - 1], pixels[at - across], pixels[at - across - 1], pixels[at - across + 1])
                rest.append(subtract(p, guess))
            pixels = rest
        elif name == "cross":
            bits = rng.randrange(2, 5)
            wide = -(-across >> bits)
            tiles = [[rng.randrange(256) for _ in range(3)] for _ in range(wide * -(-height >> bits))]
            out.put(bits - 2, 3)
            write_pixels(out, [0xFF000000 | t[2] << 16 | t[1] << 8 | t[0] for t in tiles], wide, rng, top=False)
            signed = lambda v: v - 256 if v > 127 else v
            rest = []
            for at, p in enumerate(pixels):
                y, x = divmod(at, across)
                t = tiles[(y >> bits) * wide + (x >> bits)]
                blue, green, red, alpha = channels(p)
                new_red = (red - (signed(t[0]) * signed(green) >> 5)) & 255
                new_blue = (blue - (signed(t[1]) * signed(green) >> 5) - (signed(t[2]) * signed(red) >> 5)) & 255
                rest.append(pixel([new_blue, green, new_red, alpha]))
            pixels = rest
        elif name == "green":
            pixels = [pixel([(b - g) & 255, g, (r - g) & 255, a]) for b, g, r, a in map(channels, pixels)]
        else:
            colours = sorted(set(pixels))
            out.put(len(colours) - 1, 8)
            write_pixels(out, [subtract(c, p) for c, p in zip(colours, [0, *colours], strict=False)], len(colours), rng, top=False)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = {c: k for k, c in enumerate(colours)}
            size, per = 8 >> packed, 1 << packed
            rows = []
            for y in range(height):
                row = [index[p] for p in pixels[y * across : (y + 1) * across]]
                rows += [0xFF000000 | sum(v << (size * k) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, across, per)]
            across = -(-across >> packed)
            pixels = rows
    out.put(0, 1)
    write_pixels(out, pixels, across, rng, **options)
    body = out.value.to_bytes((out.n + 7) // 8, "little")
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def image(rng, width, height, colours):
    palette = [rng.randrange(1 << 32) for _ in range(colours)]
    out = []
    for at in range(width * height):
        out.append(out[at - rng.choice((1, width))] if at >= width and rng.random() < 0.6 else rng.choice(palette))
    return out


CASES = [
    ((), {}), (("green",), {"lz": True}), (("predictor",), {}), (("cross",), {"cache_bits": 4}), (("palette",), {"lz": True}), (("predictor", "cross", "green"), {"cache_bits": 7, "lz": True}),
    (("palette", "predictor"), {"lz": True, "cache_bits": 3}), (("green", "predictor", "cross"), {"lz": True}), (("cross", "green"), {"cache_bits": 11, "lz": True}),
]


@pytest.mark.parametrize(("transforms", "options"), CASES)
@pytest.mark.parametrize("colours", [1, 2, 3, 9, 40, 200])
def test_images_come_back(transforms, options, colours):
    rng = random.Random(repr((transforms, options, colours)))
    files, wanted = [], []
    for width, height in ((1, 1), (1, 9), (13, 1), (17, 11), (40, 23)):
        pixels = image(rng, width, height, colours)
        across = width
        if "palette" in transforms:
            n = len(set(pixels))
            across = -(-width >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
        own = dict(options)
        if width > 10 and rng.random() < 0.7:
            bits = rng.randrange(2, 4)
            tiles = -(-across >> bits) * -(-height >> bits)
            own["groups"] = (bits, [*range(min(tiles, 3)), *(rng.randrange(min(tiles, 3)) for _ in range(tiles - min(tiles, 3)))])
        files.append(write(pixels, width, height, transforms, rng, **own))
        wanted.append((width, height, pixels))
    got = webp.decode(files)
    assert [(w, h, p.tolist()) for w, h, p in got] == wanted
    assert [(w, h, p.tolist()) for w, h, p in webp.decode(files[3:4])] == wanted[3:4]


def test_a_file_made_elsewhere():
    (width, height, pixels), = webp.decode([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])
    assert (width, height, len(pixels)) == (1, 1, 1)


def test_grey_payloads_come_back():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, k, 24 * n).astype(np.uint8) for k, n in ((1, 1), (2, 3), (256, 5), (60, 40), (3, 1))]
    skewed = np.repeat(np.arange(22, dtype=np.uint8), [1, 1, *(int(1.62**k) for k in range(20))])
    rows.append(np.concatenate([skewed, np.zeros(-len(skewed) % 24, np.uint8)]))
    files = webp.encode_grey(np.concatenate(rows), [len(r) for r in rows], 24)
    for (width, height, p), r in zip(webp.decode(files), rows, strict=True):
        assert (width, height) == (24, len(r) // 24)
        assert (p == (r.astype(np.uint32) * 0x10101 | 0xFF000000)).all()


def test_code_lengths_are_complete_and_bounded():
    for counts in ([5], [0, 3, 9], [1] * 300, [int(1.7**k) for k in range(40)], [0, 0]):
        for most in (15, 9):
            n = webp.code_lengths(counts, most)
            used = [x for x in n if x]
            assert max(used, default=0) <= most and all(bool(a) == bool(b) for a, b in zip(n, counts, strict=True))
            assert len(used) < 2 or sum(2.0**-x for x in used) == 1


def test_damaged_files_are_errors():
    rng = random.Random(5)
    good = write(image(rng, 17, 11, 9), 17, 11, ("predictor", "green"), rng, lz=True, cache_bits=4)
    for bad in (b"", b"RIFF", good[:30], good[: len(good) // 2], b"x" + good[1:], good[:12] + b"VP8 " + good[16:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode([bad])
    for k in range(20, len(good)):
        try:
            webp.decode([good[:k] + bytes([good[k] ^ 0x55]) + good[k + 1 :]])
        except (ValueError, IndexError):
            continue


def test_neighbours():
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)
