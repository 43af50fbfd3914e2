import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import embed_dedup


@pytest.mark.parametrize("tiles_in_strip", [1, 3])
def test_many_tiles_and_strips_lose_no_link(spark, monkeypatch, tiles_in_strip):
    monkeypatch.setattr(embed_dedup, "TILE", 8)
    monkeypatch.setattr(embed_dedup, "STRIP_BYTES", 12 * 16 * 8 * tiles_in_strip)
    rng = np.random.default_rng(tiles_in_strip)
    base = rng.normal(size=(60, 12))
    vecs = base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 12)) * rng.choice([0.0, 0.05, 0.15], size=(400, 1))
    label = rng.choice(3, 400, p=[0.8, 0.15, 0.05])
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(vecs, label, strict=True))], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("seq", "strip", "g", "at")})
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    low = np.arange(400)
    for _ in range(400):
        low = np.minimum(low, np.where(near, low[None], 400).min(axis=1))
    assert near.sum() > 400 and [(got[i].n_links, got[i].component_id) for i in range(400)] == list(zip(near.sum(axis=1).tolist(), low.tolist(), strict=True))


def test_partners_are_the_tiles_within_reach(spark, monkeypatch):
    """The ranges of strips, against every pair of tiles; ends may touch and tie."""
    monkeypatch.setattr(embed_dedup, "STRIP_BYTES", 4 * 16 * embed_dedup.TILE * 2)
    rng = np.random.default_rng(2)
    ends = np.sort(rng.choice(np.linspace(-1, 1, 41), size=80))
    rows = [(g, 4, 1000 * g + i, float(ends[2 * i]), float(ends[2 * i + 1])) for g in (1, 2) for i in range(40)]
    tiles = spark.createDataFrame(rows, "label int, dims int, tile long, low double, high double")
    reach = embed_dedup._reach(0.98)
    got = {r.tile: r for r in embed_dedup._partners(tiles, 0.98).collect()}
    for g in (1, 2):
        mine = [r for r in rows if r[0] == g]
        assert [got[r[2]].seq for r in mine] == list(range(40))
        for r in mine:
            met = [i // 2 for i, o in enumerate(mine) if o[3] <= r[4] + reach and r[3] <= o[4] + reach]
            assert (got[r[2]].strip, got[r[2]].first, got[r[2]].last) == (got[r[2]].seq // 2, min(met), max(met))
