"""Repeated runs of lines, found by rolling hashes over line hashes, confirmed by their bytes. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Spare, own

LINE = r"(?s)[^\n.!?\x{600}-\x{10FFFF}]*.*?(?:\n|[.!?…] |[。！？؟۔।]|\z)[ \n]*"
"""A line ends with a line break, a full stop of any script, or one of . ! ? … and a blank; lines join to the text. The first
class only runs ahead to where an end can be."""
LONG = 200
"""Characters beyond which a line is cut at words."""
ALNUM = string.digits + string.ascii_letters
LOW = "048dhlptxDHLPTX"
"""About a quarter of words begin with one of these, or with a letter of the first part of its alphabet in other scripts. Single
characters make a table of a pattern's class, ranges do not: hence no a-z."""
OTHER = r"\x{3B1}-\x{3B6}\x{410}-\x{417}\x{430}-\x{437}\x{5D0}-\x{5D6}\x{627}-\x{62C}\x{915}-\x{91F}"
REST = r"\x{80}-\x{3B0}\x{3B7}-\x{40F}\x{418}-\x{42F}\x{438}-\x{5CF}\x{5D7}-\x{626}\x{62D}-\x{914}\x{920}-\x{DFF}"
WIDE = r"\x{E40}-\x{E4F}\x{3060}-\x{306F}\x{30C0}-\x{30CF}\x{5000}-\x{53FF}\x{6000}-\x{63FF}\x{7000}-\x{73FF}\x{8000}-\x{83FF}\x{9000}-\x{93FF}"
"""The same of the letters from U+0E00 on: many of those scripts set no blanks, and each letter is a word."""
MARK, LETTER = rf"[^{ALNUM}\x{{80}}-\x{{10FFFF}}]", rf"[{ALNUM}\x{{80}}-\x{{DFF}}]"
PLACE = rf"{MARK}(?:[{''.join(c for c in ALNUM if c not in LOW)}{REST}]{LETTER}*{MARK}+){{3}}[{LOW}{OTHER}]{LETTER}*|[\x{{E00}}-\x{{10FFFF}}]{{3}}[{WIDE}]"
"""A line is cut behind such a word that three others stand before: a place that depends on four words only."""
CUT = "\uffff"
"""Stands between pieces while a line is cut. It is no character of any text; a line that holds it stays whole."""


def _digest(*values: Column) -> Column:
    return F.xxhash64(*values)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus a column that is computed once a row: a plain projection would be folded into each lambda that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def lines_of(text: Column) -> Column:
    """The lines of a text, over-long ones in pieces; they join to the text. Null gives null."""
    pieces = lambda x: F.filter(F.split(F.regexp_replace(x, PLACE, f"$0{CUT}"), CUT), lambda p: p != "")
    cut = lambda x: F.when((F.length(x) > LONG) & ~F.contains(x, F.lit(CUT)), pieces(x)).otherwise(F.array(x))
    return F.flatten(F.transform(F.filter(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda x: x != ""), cut))


def _bare(line: Column) -> Column:
    """Without the blanks and line breaks at the end; a line has breaks nowhere else."""
    return F.rtrim(F.replace(line, F.lit("\n"), F.lit(" ")))


def _hashes(lines: str) -> Column:
    return F.transform(lines, lambda x: _digest(_bare(x)))


def _rolled(hashed: str, k: Column) -> Column:
    """Hash of the window k: over lines k and k + 1, or over line -1 - k alone."""
    at = lambda i: F.get(F.col(hashed), i)
    return F.when(k < 0, _digest(at(-1 - k))).otherwise(_digest(at(k), at(k + 1)))


def windows(df: DataFrame, lines: str) -> DataFrame:
    """``df`` without its lines, a row (hash, k) for each window: a hash rolled over the hashes of lines k and k + 1, and one
    of each line that is still over-long alone, with k its place negative and less 1. Besides, a row (null, number of lines)
    for each row with lines, be they none."""
    hashed, n, at = own(df, "line_hashes", "n", "at")
    out = _held(df, hashed, _hashes(lines))
    last = F.size(hashed) - 1
    pairs = F.transform(F.col(hashed), lambda x, i: F.when(i < last, _digest(x, F.get(F.col(hashed), i + 1))))
    alone = F.transform(F.col(lines), lambda x, i: F.when(F.length(x) > LONG, _digest(F.get(F.col(hashed), i))))
    rest = [F.col(f"`{c}`") for c in df.columns if c != lines]
    out = out.select(*rest, F.size(hashed).alias(n), F.posexplode(F.concat(pairs, alone, F.array(F.lit(None).cast("long")))).alias(at, "hash"))
    out = out.filter(F.col("hash").isNotNull() | (F.col(at) == 2 * F.col(n)))
    k = F.when(F.col(at) < F.col(n), F.col(at)).when(F.col(at) < 2 * F.col(n), F.col(n) - 1 - F.col(at)).otherwise(F.col(n))
    return out.select(*rest, "hash", k.alias("k"))


def _places(found: Column) -> Column:
    """Places of the lines in an array of windows."""
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.when(w["k"] < 0, F.array(-1 - w["k"])).otherwise(F.array(w["k"], w["k"] + 1)))))


def _clashes(marked: DataFrame, lines: str, marks: str) -> DataFrame:
    """(hash) of line hashes that stand for different bytes and of windows' that stand for different lines' hashes.

    The hash of a window and of its first line settle the second line's, as the last step of the hash is one to one.
    """
    hashed, = own(marked, "line_hashes")
    marked, none, at = _held(marked, hashed, _hashes(lines)), F.lit(None), lambda i: F.get(F.col(hashed), i)
    texts = F.transform(_places(F.col(marks)), lambda i: F.struct(at(i).alias("hash"), none.cast("long").alias("head"), _bare(F.get(F.col(lines), i)).alias("bytes")))
    heads = F.transform(F.col(marks), lambda w: F.struct(w["hash"].alias("hash"), at(F.when(w["k"] < 0, -1 - w["k"]).otherwise(w["k"])).alias("head"), none.cast("string").alias("bytes")))
    rows = marked.select(F.explode(F.concat(texts, heads)).alias("x")).groupBy("x.hash", "x.head", "x.bytes").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")


def _spared(marked: DataFrame, lines: str, marks: str, rank: str, key: str, clashes: DataFrame) -> DataFrame:
    """(rank, key, spared): windows that only a clash of hashes called repeated. The windows of clashing hashes are grouped by their bytes."""
    line = lambda i: _bare(F.get(F.col(lines), i))
    two = lambda k, f: F.struct(f(F.when(k < 0, -1 - k).otherwise(k)).alias("a"), F.when(k >= 0, f(k + 1)).alias("b"))
    full = F.transform(F.col(marks), lambda w: F.struct(w["hash"].alias("hash"), w["k"].alias("k"), w["lost"].alias("lost"), two(w["k"], lambda i: _digest(line(i))).alias("h"), two(w["k"], line).alias("t")))
    rows = marked.select(F.col(rank).alias("rank"), F.col(key).alias("key"), F.explode(full).alias("w")).select("rank", "key", "w.hash", "w.k", "w.lost", F.col("w.h.a").alias("ha"), F.col("w.h.b").alias("hb"), "w.t")
    for c in ("hash", "ha", "hb"):
        rows = rows.join(clashes.select(F.col("hash").alias(f"{c}_c")).distinct().withColumn(f"{c}_bad", F.lit(True)), F.col(c) == F.col(f"{c}_c"), "left")
    rows = rows.filter("hash_bad or ha_bad or hb_bad").select("rank", "key", "k", "lost", "t")
    first = rows.groupBy("t").agg(F.min("rank").alias("first")).withColumnRenamed("t", "t_f")
    here = rows.groupBy("t", "rank", "key").agg(F.min(F.abs("k")).alias("at")).select(F.col("t").alias("t_h"), F.col("rank").alias("rank_h"), F.col("key").alias("key_h"), "at")
    known = rows.join(first, F.col("t") == F.col("t_f")).join(here, (F.col("t") == F.col("t_h")) & (F.col("rank") == F.col("rank_h")) & (F.col("key") == F.col("key_h")))
    return known.filter("lost and rank = first and abs(k) = at").groupBy("rank", "key").agg(F.collect_set("k").alias("spared"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df``, the text without its repeated runs, plus ``n_lines`` and ``n_removed`` (clashing names get a leading _).

    A hash is rolled over the line hashes two by two, and over each line that no word could cut below LONG characters.
    Where a window stands in a row of smaller id, or further ahead in its own text, its lines go. So a chunk runs as
    long as its windows are repeated ones: its boundaries follow from the content, whatever stands around it, and a
    repeated run of two lines or more goes whole but where it stands first. Lines are equal byte for byte, blanks and
    line breaks at their end aside: hashes only find them. Every line of a repeated window meets the others of its hash, and windows
    whose hashes stand for more than one text are grouped again by their bytes.

    Null texts stay null and empty ones empty, with 0 lines. A null id comes after all others. Rows of equal ids, or both
    without, take nothing from each other; where they share the text too they are one document.
    """
    rank, key, lines, marks, spared, n_lines, n_removed = own(df, "line_rank", "text_key", "lines", "marks", "spared", "n_lines", "n_removed")
    m_rank, m_key, s_rank, s_key, left, codes, found, hashed = own(df, "m_rank", "m_key", "s_rank", "s_key", "left", "codes", "found", "line_hashes")
    n, = own(df, "n")
    cut = Spare()
    named = df.withColumns({rank: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), key: F.xxhash64(text_col)})
    slim = named.select(F.col(rank).alias("rank"), F.col(key).alias("key"), F.explode(F.array(lines_of(F.col(text_col)))).alias("lines"))
    every = cut(windows(slim, "lines"), "windows")
    first = cut(every.filter("hash is not null").groupBy("hash").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "first"), "first")
    met = every.hint("merge").join(first.hint("merge"), "hash")  # one kind of join at every size, of which hot hashes are split
    code = F.col("k") * 2 + (F.col("rank") > F.col("first")).cast("int")
    met = met.select("rank", "key", code.alias("code"), F.lit(None).cast("int").alias("n"))
    sizes = every.filter("hash is null").select("rank", "key", F.lit(None).cast(met.schema["code"].dataType).alias("code"), F.col("k").alias("n"))
    known = met.union(sizes).groupBy(F.col("rank").alias(m_rank), F.col("key").alias(m_key))
    known = cut(known.agg(F.collect_set("code").alias(codes), F.max("n").alias(n)).withColumn(codes, F.when(F.size(codes) > 0, F.col(codes))), "marks")  # a text's own windows
    cut.drop_but(known)
    joined = named.hint("merge").join(known.hint("merge"), (F.col(rank) == F.col(m_rank)) & (F.col(key) == F.col(m_key)), "left").drop(m_rank, m_key)
    split = F.when(F.col(codes).isNotNull(), lines_of(F.col(text_col))).when(F.col(text_col).isNotNull(), F.array(text_col))  # what stays whole is not split again
    joined = _held(joined, lines, split).drop(text_col)
    joined = _held(joined, hashed, F.when(F.col(codes).isNotNull(), _hashes(lines)))
    place = lambda c: F.floor(c / 2).cast("int")
    ordered = F.sort_array(F.transform(F.col(codes), lambda c: F.struct(_rolled(hashed, place(c)).alias("hash"), place(c).alias("k"), (F.pmod(c, F.lit(2)) == 1).alias("later"))))
    again = lambda i: F.coalesce((i > 0) & (F.get(F.col(found), i - 1)["hash"] == F.get(F.col(found), i)["hash"]), F.lit(False))
    lost = F.transform(F.col(found), lambda w, i: F.struct(w["hash"].alias("hash"), w["k"].alias("k"), (w["later"] | again(i)).alias("lost")))
    whole = cut(_held(joined, found, ordered).withColumn(marks, lost).drop(found, codes, hashed), "lines")
    cut.drop_but(whole)
    known = whole.filter(F.col(marks).isNotNull())
    clashes = cut(_clashes(known, lines, marks), "clashes")
    if clashes.isEmpty():
        whole = whole.withColumn(spared, F.lit(None).cast("array<int>"))
    else:
        rest = cut(_spared(known, lines, marks, rank, key, clashes), "spared").select(F.col("rank").alias(s_rank), F.col("key").alias(s_key), F.col("spared").alias(spared))
        whole = whole.join(rest, (F.col(rank) == F.col(s_rank)) & (F.col(key) == F.col(s_key)), "left").drop(s_rank, s_key)
    lost = F.filter(F.col(marks), lambda w: w["lost"] & ~F.coalesce(F.array_contains(F.col(spared), w["k"]), F.lit(False)))
    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    kept = _held(whole, left, F.when(F.col(marks).isNull(), every).otherwise(F.array_except(every, _places(lost))))
    text = F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(lines), i)), "")
    text = F.when(F.col(lines).isNull(), F.lit(None).cast("string")).when(F.col(marks).isNull(), F.array_join(lines, "")).otherwise(text)
    size = F.coalesce(F.col(n), F.lit(0))
    return kept.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns),
        size.alias(n_lines), F.when(F.col(marks).isNull(), F.lit(0)).otherwise(size - F.size(left)).alias(n_removed),
    )


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with repeated runs removed from the text (``dedup_lines``); rows of which nothing is left go."""
    n_lines, n_removed = own(df, "n_lines", "n_removed")
    done = dedup_lines(df, id_col, text_col)
    return done.filter((F.col(n_lines) == 0) | (F.col(n_removed) < F.col(n_lines))).select(*(F.col(f"`{c}`") for c in df.columns))
