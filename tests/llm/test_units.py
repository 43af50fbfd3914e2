"""Building blocks of the corpus operators against brute force, without a cluster."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelake.llm import bpe, language, media, minhash, toxicity, warc, words

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\té　.", max_size=60)), max_size=12)


def spoken(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 6))
def test_shingles(rows, k):
    seen = {}
    for lo, hi, buf, offs in words.texts(pa.array(rows, pa.string())):
        starts, ends, at = words.spans(buf, offs)
        found, where = words.shingles(words.hashes(buf, starts, ends), at, k)
        for d in range(hi - lo):
            ws = spoken(rows[lo + d])
            assert at[d + 1] - at[d] == len(ws)
            want = {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()
            own = found[where[d] : where[d + 1]].tolist()
            assert own == sorted(set(own)) and len(own) == len(want)
            seen.setdefault(frozenset(want), set()).add(tuple(own))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    rows = ["a" * 3, None, "b" * 25, "", "c" * 9, "d"]
    got = [buf[offs[i] : offs[i + 1]].tobytes().decode() for _, _, buf, offs in words.texts(pa.array(rows)) for i in range(len(offs) - 1)]
    assert got == [r or "" for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0.1, 9)), max_size=12, unique_by=lambda x: x[0]))
def test_segments_are_all_maximal_ones(hits):
    hits = sorted(hits)
    got = toxicity.segments([p for p, _ in hits], [s for _, s in hits])

    line = [-toxicity.DROP] * 31
    for p, s in hits:
        line[p] = s

    def split(lo, hi):
        """The best segment, then the same on either side of it."""
        best = max(((sum(line[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return []
        a, b = -best[2], -best[2] - best[1]
        return [*split(lo, a), (a, b - 1, best[0]), *split(b, hi)]

    want = split(0, 31)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


@pytest.mark.parametrize("step", [1, 3, 12])
def test_segments_take_linear_time(step):
    """A million hits: side by side, apart, and so far apart that each sum before is the lowest so far."""
    places, scores = list(range(0, 1_000_000 * step, step)), [0.5 + (i * 7919 % 97) / 40 for i in range(1_000_000)]
    began = time.perf_counter()
    found = toxicity.segments(places, scores)
    assert time.perf_counter() - began < 20 and all(a <= b < c for (a, b, _), (c, _, _) in zip(found, found[1:], strict=False))


def test_lambda_is_a_root():
    scores, counts = np.array([2.5, 4.0]), np.array([30.0, 10.0])
    x = toxicity._scale(scores, counts, 10_000.0)
    assert 0 < x and 0.996 * math.exp(-toxicity.DROP * x) + 0.003 * math.exp(2.5 * x) + 0.001 * math.exp(4 * x) == pytest.approx(1)
    assert toxicity._scale(scores, counts, 45.0) == 0.0


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    references = {n: "".join(rng.choice(alphabet) for _ in range(300)).encode() for n, alphabet in (("x", "abcde "), ("y", "abxyz "), ("z", "qrs"))}
    model = language.build(references)
    rows = ["", "a", "zzz", "é", *("".join(rng.choice("abcxyzq é") for _ in range(rng.randrange(90))) for _ in range(60))]

    def brute(text, ref):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in ref:
                size += 1
            if text[at : at + 1] not in ref:
                size = 1
            at, n = at + size, n + 1
        return n

    for _, _, buf, offs in words.texts(pa.array(rows)):
        syms, at, _ = language.symbols(buf, offs)
        got = language.phrases(model, syms, at)
        for d in range(len(rows)):
            text = syms[at[d] : at[d + 1]].tobytes()
            assert got[d].tolist() == [brute(text, references[n]) for n in model.names]


def test_symbols_keep_letters_only():
    rows = ["Ab1 2..c", "", "É é", "123"]
    (_, _, buf, offs), = words.texts(pa.array(rows))
    syms, at, letter = language.symbols(buf, offs)
    assert [syms[at[i] : at[i + 1]].tobytes().decode() for i in range(4)] == ["ab c", "", "é é", " "]
    assert letter.tolist() == [True, False, True, False]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "aaaa" * 4000, "  \n\n  x", "don't  we'LL I'm 12 ٤৫ ½", "​﻿中文 \U0001f600\U0001f44d\U0001f3fd \r\n\t z", "\x00\x01a\x85b\xa0c　d", "ab" * 23, "ab" * 24, "ab" * 25]


def test_tokens_equal_the_library(vocabulary, library):
    want = library.encode_batch(ODD, add_special_tokens=False)
    got = vocabulary.encode(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert vocabulary.decode(got) == library.decode_batch([w.ids for w in want], skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text_comes_back(vocabulary, library, rows):
    got = vocabulary.encode(rows)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in library.encode_batch(rows, add_special_tokens=False)]
    assert vocabulary.decode(got) == rows


def test_short_and_long_words_merge_alike(vocabulary):
    rng = random.Random(4)
    for n in (2, 3, 7, 30, 48):
        raw = [bytes(rng.choice(b"abcdeth in") for _ in range(n)) for _ in range(80)]
        assert vocabulary.merge_short(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, n)) == [vocabulary.merge_long(r) for r in raw]


def test_broken_bytes_decode_to_marks(vocabulary, library):
    ids = [vocabulary.encode(["\U0001f600"])[0][:4], vocabulary.encode(["é"])[0]]
    assert vocabulary.decode(ids) == library.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)


def test_linked_is_exact_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.7, 0.85, 0.95])], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)]))
        if len(other):
            common = len(np.intersect1d(base, other))
            assert minhash._linked(base, other, 80, 64) == (100 * common >= 80 * (len(base) + len(other) - common))


def test_features_of_small_images():
    for shape in ((1, 1), (1, 576), (40, 576), (3, 5)):
        assert media.feature(np.zeros(shape, np.uint8)).startswith("mean=0.000;std=0.000;dhash=0000")


def test_warc_records():
    url = "http://a/ü b\r\nX: 1"
    made = b"".join(warc._page(k, url, p, warc._sha(p), r, url) for k, p, r in ((1, b"", None), (None, b"x\r\n\r\ny" * 50, None), (3, b"z" * 200, 1)))
    import io

    got = list(warc.records(io.BytesIO(made)))
    assert [h["WARC-Type"] for h, _ in got] == ["response", "response", "revisit"]
    assert got[1][1].endswith(b"x\r\n\r\ny" * 50) and got[2][1].endswith(b"\r\n\r\n") and b"Content-Length: 200" in got[2][1]
    assert "\n" not in got[0][0]["WARC-Target-URI"] and got[2][0]["WARC-Refers-To"] == warc._urn(1, warc._uri(url, 1), warc._sha(b"z" * 200))
    for bad in (made[:-5], made[: len(made) // 2]):
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(io.BytesIO(bad)))
    head, block = got[1]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block[:-1] + b"?\r\n\r\n")
