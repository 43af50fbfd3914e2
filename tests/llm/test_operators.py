"""The corpus operators on small tables: brute force, nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import embed_dedup, language, line_dedup, minhash, toxicity
from codelake.llm.line_dedup import CUT, LONG, dedup_lines, without_repeated_lines
from codelake.llm.media import payload_features, read_pixels, store_payloads
from codelake.llm.mixing import mix_sources, mixing_plan
from codelake.llm.prefix import prefix_sums
from codelake.llm.sharding import shard_by_bytes
from codelake.llm.warc import read_warc, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty, a blank and a very long text, equal texts, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e. f g h.\nsame line here.\n", "en", "s"), (2, None, None, None), (3, "", "en", ""), (4, " \n\t", "de", "s"), (5, long, "en", "t"), (6, "é ü 中文 \U0001f600", "fr", "t"), (7, "a b c d e. f g h.\nsame line here.\n", "en", "s"), (None, "a b c d e. f g h.\nsame line here.\n", "en", None), (8, "x", "en", "s"), (8, "x", "en", "s")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab") if rng.random() < 0.9 else None, rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int")
    for group in (None, "g"):
        got = {r.i: (r.row_before, r.sum_before) for r in prefix_sums(df, [F.col("k"), F.col("i")], "v", group).collect()}
        seen = Counter(), Counter()
        for g, k, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            key = g if group else 0
            assert got[i] == (seen[0][key], seen[1][key])
            seen[0][key] += 1
            seen[1][key] += v


def test_shards(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(400), None, None) for i in range(700)]
    got = shard_by_bytes(docs(spark, rows)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
        assert r.size == len(rows[r.doc_id][1]) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
    assert max(size.values()) - min(size.values()) < 2 * 401
    order = [(r.shard, r.slot) for r in sorted(got, key=lambda r: (r.text_crc32, r.doc_id))]
    assert order == sorted(order)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    got = shard_by_bytes(odd).collect()
    assert len(got) == 10 and {r.size for r in got if r.doc_id in (2, 3)} == {1} and all(0 <= r.shard < 8 for r in got)
    assert shard_by_bytes(none).count() == 0


def filled(sizes):
    """Targets by giving out the rest again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "src10", "src2"][: 3 + 2 * seed]
    weight = [rng.choice((1, 3, 30)) for _ in names]
    rows = [(i, " ".join("w" * rng.randrange(0, 60)), None, rng.choices(names, weight)[0]) for i in range(900)]
    got = mixing_plan(docs(spark, rows)).collect()
    sizes, most, taken = Counter(), Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
        most[s] = max(most[s], len(words_of(t)))
    want = filled({s: sizes[s] for s in {r[3] for r in rows}})
    for r in got:
        assert r["size"] == len(words_of(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and sum(taken.values()) <= sum(sizes.values())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * most[s] + 1
    again = {r.doc_id: r.taken for r in mixing_plan(docs(spark, rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixing_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in mixing_plan(odd).collect()}
    assert got[2]["size"] == got[2].taken == 0 and got[5].source_size == got[5]["size"] + 4 and got[8]["size"] == 1
    assert mixing_plan(none).count() == 0 and mix_sources(none).columns == none.columns
    blank = docs(spark, [(1, None, None, "a"), (2, "", None, "b")])
    assert [r.taken for r in mixing_plan(blank).collect()] == [0, 0]
    mixed = mix_sources(odd.withColumn("mix_copies", F.lit(1)))
    assert mixed.columns == [*odd.columns, "mix_copies"] and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3 * 2


def shingle_set(text, k):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(rows, k, percent=80):
    """(size, smallest id of the component) by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets.items()}


def copies(rng, n, base, edits):
    """Near copies of one text, each with some words changed: some link, some do not."""
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "leaders"), [(256, 6), (3, 1)])
def test_near_duplicates(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LEADERS", minhash.LEADERS[:leaders])
    rng = random.Random(block)
    prose = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randrange(1, 150)) for _ in range(60)] + copies(rng, 60, prose(120), 12) + copies(rng, 12, prose(300), 30) + copies(rng, 8, prose(9), 3)
    texts += [f"{prose(rng.randrange(60))} {passage} {prose(rng.randrange(60))}" for _ in range(40)] + ["one two", "ONE  two", "one", "", None, " \t", texts[0], texts[0].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for k in (4, 5):
        got = minhash.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), shingle=k).collect()
        want = near_groups(rows, k)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_at_another_similarity(spark):
    rng = random.Random(5)
    base = " ".join(f"v{rng.randrange(3000)}" for _ in range(90))
    rows = list(enumerate(copies(rng, 50, base, 14) + [" ".join(f"v{rng.randrange(3000)}" for _ in range(40)) for _ in range(20)]))
    got = minhash.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows]), shingle=3, percent=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(rows, 3, 60)


def test_near_duplicates_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(odd, shingle=4).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[7].component_id == 1 and not by[7].kept and by[5].kept and by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0
    assert by[None].kept and by[None].component_id == 1
    assert minhash.near_duplicates(none).count() == 0
    left = minhash.drop_near_duplicates(odd.withColumn("gone", F.lit(1)), shingle=4)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 8] and left.columns == [*odd.columns, "gone"]


@pytest.mark.parametrize("tile", [512, 5])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows, vec = [], {}
    base = rng.normal(size=(12, 16))
    for i in range(150):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.3])
        v = v * rng.choice([1, 1, 3.0]) if i % 5 else base[0]
        label = int(rng.integers(0, 3))
        rows.append((i, [float(x) for x in v.astype(np.float32)], label))
        vec[i] = (v.astype(np.float32).astype(float), label)
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None] + [0.0] * 14, 1), (204, [float("inf")] * 16, 1), (205, rows[0][1], None), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    vec |= {207: (np.array([1.0, 2.0]), 1), 208: (np.array([2.0, 4.0]), 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dims", F.lit(1))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    cos = lambda a, b: len(a) == len(b) and a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= 0.98
    links = {i: {j for j in vec if j != i and vec[i][1] == vec[j][1] and cos(vec[i][0], vec[j][0])} for i in vec}
    label = {i: i for i in vec}
    for _ in vec:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in vec}
    for i in vec:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), label[i], label[i] == i)
    for i in range(200, 207):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) and got[None].kept
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_tiles_stop_early_and_lose_nothing():
    rng = np.random.default_rng(9)
    a = embed_dedup._unit(np.concatenate([rng.normal(size=(40, 64)), np.repeat(rng.normal(size=(2, 64)), 20, axis=0) + rng.normal(size=(40, 64)) * 0.1]))
    i, j = embed_dedup._linked(a, a, a, a, True, 0.98)
    want = {(x, y) for x in range(80) for y in range(x + 1, 80) if a[x] @ a[y] >= 0.98}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_toxicity_learns_and_generalises(spark, odd, none):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"n{rng.randrange(200)}" for _ in range(n))
    bad = ["clodpate", "dunder", "snarlish", "snarlen", "snarlac", "snarlom"]
    rows, truth = [], {}
    for i in range(800):
        truth[i] = int(rng.random() < 0.2)
        w = prose(rng.randrange(1, 80)).split()
        if truth[i]:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(("", ".", ",")))
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(900, "You CLODPATE!", None, None), (901, "n1 snarlunseen n2", None, None), (902, None, None, None), (903, "", None, None)]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if i % 10 < 8] + [(5, None), (None, 1), (3, truth[3])], "doc_id long, toxic int")
    held = toxicity.fold("l_id") == 1
    model = toxicity.fit(toxicity.training_rows(table, labels, held))
    got = {r.doc_id: r for r in toxicity.score_toxicity(table, model).collect()}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].score >= 0.7) == bool(truth[i]) for i in out]) > 0.98
    assert got[900].score >= 0.7 and got[901].score >= 0.7 and got[902].score == got[903].score < 0.7
    assert all(0 <= r.score <= 1 for r in got.values())
    p = got[900].passages[0]
    assert "You CLODPATE!"[p.start : p.end] == "CLODPATE"
    left = toxicity.without_toxic(table.withColumn("score", F.lit(1)), model)
    assert left.columns == [*table.columns, "score"] and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.score < 0.7}
    assert toxicity.score_toxicity(none, model).count() == 0 and toxicity.score_toxicity(odd, model).count() == 10
    blank = toxicity.fit(toxicity.training_rows(none, labels, held))
    assert {r.score < 0.7 for r in toxicity.score_toxicity(odd, blank).collect()} == {True}
    folds = {r.doc_id: r.f for r in table.select("doc_id", toxicity.fold("doc_id").alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 3 for i, f in folds.items())


def test_language(spark, odd, none):
    rng = random.Random(8)
    stems = {"en": ["the", "ing", "and", "tion", "th"], "de": ["sch", "und", "keit", "der", "ei"], "fr": ["eau", "que", "ment", "les", "oi"]}
    text = lambda l, n: " ".join("".join(rng.choice(stems[l]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(l, rng.randrange(5, 60)), l, "s") for i in range(300) for l in [rng.choice(list(stems))]] + [(400, None, "en", None), (401, "123 .", None, None), (402, "", "de", None), (403, "the and", None, None), (404, "\U0001f600 — ½", "en", None)]
    table = docs(spark, rows)
    model = language.fit(table, toxicity.fold("doc_id") == 1)
    assert model.names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.identify(table, model).collect()}
    out = [(i, l) for i, _, l, _ in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == l for i, l in out]) > 0.97
    assert [got[i].lang_pred for i in (400, 401, 402, 404, 403)] == ["und", "und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none, F.lit(False))).collect()} == {"und"}


def lines_of(text):
    """The lines by a loop over characters, over-long ones cut at words."""
    lines, at, end = [], 0, len(text)
    while at < end:
        k = at
        while k < end and not (text[k] in "\n。！？؟۔।" or text[k] in ".!?…" and text[k + 1 : k + 2] == " "):
            k += 1
        k = min(k + (2 if k < end and text[k] in ".!?…" else 1), end)
        while k < end and text[k] in " \n":
            k += 1
        lines.append(text[at:k])
        at = k
    mark = lambda c: ord(c) < 128 and not c.isalnum()
    letter = lambda c: not mark(c) and ord(c) < 0xE00
    inside = lambda c, ranges: any(a <= ord(c) <= b for a, b in ranges)
    low = lambda c: c in "048dhlptxDHLPTX" or inside(c, ((0x3B1, 0x3B6), (0x410, 0x417), (0x430, 0x437), (0x5D0, 0x5D6), (0x627, 0x62C), (0x915, 0x91F)))
    wide = lambda c: inside(c, ((0xE40, 0xE4F), (0x3060, 0x306F), (0x30C0, 0x30CF), (0x5000, 0x53FF), (0x6000, 0x63FF), (0x7000, 0x73FF), (0x8000, 0x83FF), (0x9000, 0x93FF)))

    def place(line, k):
        """Where a cut stands whose four words begin at k, or None."""
        if all(c >= "\u0e00" for c in line[k : k + 3]) and len(line) > k + 3 and wide(line[k + 3]):
            return k + 4
        if not mark(line[k]):
            return None
        k += 1
        for want in (False, False, False, True):
            if k >= len(line) or not letter(line[k]) or low(line[k]) != want:
                return None
            while k < len(line) and letter(line[k]):
                k += 1
            if want:
                return k
            if k >= len(line) or not mark(line[k]):
                return None
            while k < len(line) and mark(line[k]):
                k += 1

    out = []
    for line in lines:
        if len(line) <= LONG or CUT in line:
            out.append(line)
            continue
        k = at = 0
        while k < len(line):
            end = place(line, k)
            if end:
                out.append(line[at:end])
                at = end
            k = end or k + 1
        out += [line[at:]] if at < len(line) else []
    return out


def windows_of(text):
    """(place, lines) of each two adjacent lines and of each over-long one."""
    lines = lines_of(text)
    bare = [x.rstrip(" \n") for x in lines]
    return lines, [((i, i + 1), (bare[i], bare[i + 1])) for i in range(len(lines) - 1)] + [((i,), (bare[i],)) for i, x in enumerate(lines) if len(x) > LONG]


def without_runs(rows):
    """Brute force: {id: (text, lines, removed)} of rows with distinct ids."""
    first, out = {}, {}
    for i, text in sorted(rows):
        lines, windows = windows_of(text or "")
        gone = set()
        for at, key in windows:
            if first.setdefault(key, (i, at)) != (i, at):
                gone |= set(at)
        out[i] = (None if text is None else "".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_line_dedup(spark, odd, none, monkeypatch, weak):
    """With ``weak`` hashes clash all the time: only the bytes decide."""
    if weak:
        monkeypatch.setattr(line_dedup, "_digest", lambda *v: F.pmod(F.xxhash64(*v), F.lit(150)))
    rng = random.Random(12)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 9))) + rng.choice((".\n", "\n", ". ", "! ", "。"))
    shared = ["".join(line() for _ in range(n)) for n in (2, 3, 5, 12)] + [" ".join(f"v{rng.randrange(900)}" for _ in range(90)), "z" * 300]
    rows = [(i, "".join(rng.choice((line(), line(), rng.choice(shared))) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    rows += [(500, "spam.\n" * 50), (501, rows[3][1]), (502, "中文" * 200 + "\n\n" + CUT + "x" * 300), (503, "  \n" + CUT + "x" * 300), (504, "\n. ."), (505, "a | b " * 60)]
    table = docs(spark, [(i, t, None, None) for i, t in rows])
    want = without_runs(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(table).collect()}
    assert got == want and sum(n for *_, n in want.values()) > 200 and want[501][0] == ""
    if weak:
        return
    clash = ["n_lines", "lines", "marks", "line_rank", "m_rank", "text_key", "left", "spared"]
    left = without_repeated_lines(table.withColumns({c: F.lit("mine") for c in clash}))
    assert left.columns == [*table.columns, *clash] and 501 not in {r.doc_id for r in left.collect()}
    by = {r.doc_id: r for r in dedup_lines(odd).collect()}
    assert by[2].text is None and by[3].text == "" and by[1].text and by[7].text == "" and by[None].text == "" and by[6].n_removed == 0
    assert dedup_lines(odd).count() == 10 and dedup_lines(none).count() == 0


def test_media(spark, odd, none):
    stored = store_payloads(odd)
    rows = {(r.doc_id, r.text): r for r in odd.collect()}
    got = payload_features(stored).collect()
    assert len(got) == 10
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 7, None)}) == 1
    image = {r.doc_id: r.images for r in read_pixels(stored).collect()}[5]
    assert len(image) == -(-len(next(t for i, t in rows if i == 5)) // (576 * 32)) and image[0].width == 576
    bad = spark.createDataFrame([(1, b"RIFFnothing"), (2, None), (3, b"")], "doc_id long, media binary")
    assert {r.doc_id: r.images for r in read_pixels(bad).collect()} == {1: None, 2: None, 3: []}
    assert {r.media_bytes for r in payload_features(bad).collect()} == {11, None, 0}
    assert payload_features(store_payloads(none)).count() == 0
    assert "_feature" in payload_features(bad.withColumn("feature", F.lit(1))).columns


def test_warc(spark, tmp_path):
    big, small = "x" * 100, "y" * 99
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (1, "http://c", small), (2, "http://d", small), (4, "u", None), (6, "u", ""), (7, "ü \n", "é" * 50), (8, "v", "é" * 50), (None, "w", big), (10, "r", "unique " * 30), (10, "r", "unique " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    out = "file://" + str(tmp_path / "w")
    manifest = write_warc(pages, out, roll_bytes=900)
    got = read_warc(manifest, out).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    kinds = {r.key: (r.record_type, r.refers_to) for r in got}
    assert kinds == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7), None: ("revisit", 3), 10: ("response", None)}
    for r in got:
        html = (next(h for i, _, h in rows if i == r.key) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert r.payload == (html if r.record_type == "response" else None)
    files = sorted(p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith("."))
    assert files == sorted(r.name for r in manifest.collect())
    for r in manifest.collect():
        assert hashlib.sha256((tmp_path / "w" / r.name).read_bytes()).hexdigest() == r.sha256
    again = write_warc(pages.repartition(5), "file://" + str(tmp_path / "again"), roll_bytes=900)
    assert {(r.name, r.sha256) for r in again.collect()} == {(r.name, r.sha256) for r in manifest.collect()}
    empty = write_warc(pages.limit(0), "file://" + str(tmp_path / "e"))
    assert read_warc(empty, "file://" + str(tmp_path / "e")).count() == 0
