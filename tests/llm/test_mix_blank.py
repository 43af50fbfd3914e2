"""Documents without words pass the mixing once."""

from collections import Counter

from codelake.llm.mixing import mix_sources


def test_documents_without_words_stay_once(spark):
    rows = [(i, "a b c d", "abc"[i % 3]) for i in range(60)]
    blank = [(100 + i, (None, "", " \n")[i % 3], "abc"[i // 3 % 3]) for i in range(36)]
    table = spark.createDataFrame(rows + blank + [(0, "", "a")], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in mix_sources(table).collect())
    assert all(got[i, t] == 1 for i, t, _ in blank) and got[0, ""] == 1
    assert max(got[i, t] for i, t, _ in rows) > 1 and min(got[i, t] for i, t, _ in rows) == 0
