"""BPE over DataFrames: odd rows against the tokenizers library, tables without rows, clashing columns, bounded memory."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "don't stop <|endoftext|> now"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, "é ü 中文 \U0001f600"), (7, "ab" * 9000), (None, "don't stop"), (None, None), (8, "x"), (8, "x")]
sha = lambda x: hashlib.sha256(x).hexdigest()
order = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def frame(spark):
    """Extra columns bear the names of the outputs."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"ids": F.lit("mine"), "n_tokens": F.lit("mine"), "id": F.lit(-1), "ids_sha256": F.lit(None).cast("string")})


def expected(library):
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        yield i, ids, library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode(spark, frame, library):
    coded = bpe.encode(frame, PATH)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    want = list(expected(library))
    assert order((r.doc_id, r.n_tokens, r.ids) for r in coded.collect()) == order((i, len(ids), ids) for i, ids, _ in want)
    back = bpe.decode(coded.withColumn("text", F.lit("mine")), PATH)
    assert back.columns == ["doc_id", "text"]
    assert order(map(tuple, back.collect())) == order((i, t) for i, _, t in want)
    odd = spark.createDataFrame([(1, None), (None, []), (2, [256])], "doc_id long, ids array<int>")
    assert order((r.doc_id, r.text) for r in bpe.decode(odd, PATH).collect()) == order([(1, ""), (None, ""), (2, library.decode([256], skip_special_tokens=False))])


@pytest.mark.parametrize("keep", [False, True])
def test_round_trip(frame, library, keep):
    got = bpe.round_trip(frame, PATH, keep_ids=keep)
    want = [(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()), *([ids] if keep else [])) for i, ids, t in expected(library)]
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep]
    assert order(map(tuple, got.collect())) == order(want)


def test_tables_without_rows(frame):
    none = frame.limit(0)
    assert bpe.encode(none, PATH).count() == bpe.round_trip(none, PATH).count() == bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_long_words_are_not_remembered(library):
    vocabulary = bpe.load(PATH)
    for _ in range(2):
        words = ["q" * n for n in (3, bpe.SHORT, bpe.SHORT + 1, 5000)]
        got = vocabulary.encode([" ".join(words)])[0]
        assert np.frombuffer(got, "<u4").tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
        assert max(len(w) for w in vocabulary.cache) <= bpe.SHORT
