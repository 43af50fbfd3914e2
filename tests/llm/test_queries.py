"""The registered corpus queries and the pipeline on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(DATA):
    pytest.skip("no test tables here", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from codelake.llm import queries  # noqa: E402

COLUMNS = {
    "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_removed", "text"],
    "op10_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
}


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    assert set(queries.queries()) == set(COLUMNS)
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = [tuple(map(plain, r)) for r in df.collect()]
    table = "pages" if "page_id" in df.columns else "embeddings" if "vec_id" in df.columns else "documents"
    assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = con.sql(queries.oracle_sql()[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(seen[name], out.schema)
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert all(r["text"] == before[r["doc_id"]] for r in seen["toxicity"])
    assert {i for i, t in labels.items() if t == 0} <= kept
    lines = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert set(lines) <= kept and all(r["n_chars"] == len(r["text"]) for r in lines.values())
    assert {r["doc_id"] for r in seen["near_dedup"]} <= set(lines)
    assert all(r == lines[r["doc_id"]] for r in seen["near_dedup"] + seen["mixing"])
    assert sorted(r["doc_id"] for r in seen["tokens"]) == sorted(r["doc_id"] for r in seen["mixing"])
    assert all(len(r["ids"]) == r["n_tokens"] for r in seen["tokens"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r["doc_id"] for r in seen["tokens"])
