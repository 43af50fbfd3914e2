"""What the language model learns from."""

from pyspark.sql import functions as F

from codelake.llm import language


def test_learns_beyond_a_header(spark):
    head = "the and tion ing that with " * 40
    rows = [(i, head + "schaft und keit der zwischen " * 400, "xx") for i in range(60)] + [(100 + i, head * 12, "en") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(False))
    new = spark.createDataFrame([(1, "der zwischen und schaft keit der und zwischen"), (2, "and the with that ing tion and")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(new, model).collect()} == {1: "xx", 2: "en"}
