import hashlib
import random
from bisect import bisect_right

import pandas as pd
from pyspark.sql import functions as F

from codelake.llm import warc


def test_shard_of_is_the_rank_among_starts(spark):
    rng = random.Random(3)
    sha = lambda: hashlib.sha256(str(rng.random()).encode()).hexdigest()
    keys = [None, None, 2**62 + 1, 2**62 + 2, -5, 0, 7]
    units = [(rng.choice(keys), sha()) for _ in range(400)]
    order = lambda u: (u[0] is not None, u[0] or 0, u[1])
    starts = sorted(rng.sample(units, 30), key=order)
    df = spark.createDataFrame(units, "key long, digest string")
    place = warc._shard_of(starts)
    got = {(r.key, r.digest): r.shard for r in df.withColumn("shard", place(F.col("key").isNull(), F.coalesce("key", F.lit(0)), "digest")).collect()}
    assert got == {u: bisect_right([order(s) for s in starts], order(u)) for u in units}
    assert warc._shard_of([]).func(pd.Series([True]), pd.Series([0]), pd.Series(["a"])).tolist() == [0]


def test_copies_and_pages_without_a_key_spread_over_shards(spark, tmp_path):
    """A page copied into a third of the rows, and a third of them without a key: tasks read near equal parts."""
    rng = random.Random(4)
    page = lambda n: "".join(rng.choices("abcdef <>", k=n))
    common = page(3000)
    rows = [(i, f"u{i}", common) for i in range(200)] + [(200 + i, f"u{i}", page(3000)) for i in range(200)] + [(None, f"n{i}", page(3000)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    out = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, out)
    per = sorted(r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect())
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(per) == 600 and per[-1] <= 2 * per[len(per) // 2] and per[0] > 0
    got = warc.read_warc(manifest, out).collect()
    assert sorted(((r.key is None, r.key, r.payload_digest) for r in got), key=str) == sorted(((k is None, k, hashlib.sha256(h.encode()).hexdigest()) for k, _, h in rows), key=str)
    assert sum(r.record_type == "revisit" for r in got) == 199 and {r.refers_to for r in got if r.record_type == "revisit"} == {0}


def test_shards_grow_with_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 4000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * 300) for i in range(100)], "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, out)
    keys = [[r.key for r in warc.read_warc(manifest.filter(F.col("name") == f.name), out).collect()] for f in manifest.orderBy("name").collect()]
    assert len(keys) > 20 and sum(keys, []) == list(range(100))
