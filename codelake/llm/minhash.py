"""Near-duplicate documents by bottom-k sketches of one hash function, confirmed by exact Jaccard on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Spare, own, partitions
from .words import U, hashes, mix, shingles, spans, texts

SKETCH = 64
"""Values of a sketch."""
SPREAD = 4.75
"""Standard deviations below its expectation at which a pair's share of common sketch values no longer makes it a candidate."""
BLOCK = 256
"""Members of an inverted list on each side of a block; longer lists are compared block by block."""
LEADERS = tuple(int(x) for x in np.random.default_rng(11).integers(0, 1 << 62, 6))
"""Masks for the second round: a list's members meet the one whose id, under each mask, is smallest."""


def shared_part(percent: int, k: int = SKETCH) -> float:
    """Share of a sketch's values that a candidate's must hold. A pair at Jaccard p shares Binomial(k, p) values of the
    union's sketch: at 0.8 and 64 values 51 on average, and fewer than 36 with a probability of 4e-6. Sets within the
    sketch are exact."""
    p = percent / 100
    return max(0.0, p - SPREAD * (p * (1 - p) / k) ** 0.5)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in texts(batch.column(1)):
            starts, ends, word_offs = spans(buf, offs)
            found, at = shingles(hashes(buf, starts, ends), word_offs, shingle)
            n = np.diff(at)
            sums = [np.concatenate([[U(0)], np.cumsum(mix(found ^ U(c)))]) for c in (0x51ED270B0A1F39C1, 0x2127599BF4325C37)]
            a, b = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            take = np.arange(len(found)) - np.repeat(at[:-1], n) < k
            offsets = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(a), pa.array(b), sketch], ["id", "n", "sig_a", "sig_b", "sketch"])


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, k: int = SKETCH) -> DataFrame:
    """(id, n, sig_a, sig_b, sketch): set size, a 128-bit signature of the set, and its k smallest hashes, ascending as unsigned."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _sketch(it, shingle, k), "id long, n long, sig_a long, sig_b long, sketch array<long>")


def _whole(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in texts(batch.column(1)):
            starts, ends, word_offs = spans(buf, offs)
            found, at = shingles(hashes(buf, starts, ends), word_offs, shingle)
            blobs = pa.array([found[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blobs], ["id", "whole"])


def _estimate(x: np.ndarray, y: np.ndarray, percent: int, k: int) -> bool:
    """Whether enough of the union's sketch lies in both sets; sets within the sketch are left to the exact test."""
    if max(len(x), len(y)) <= k:
        return True
    merged = np.sort(np.concatenate([x[:k], y[:k]]))
    twice = merged[1:] == merged[:-1]
    union = np.concatenate([merged[:1], merged[1:][~twice]])[:k]
    return np.count_nonzero(twice & (merged[1:] <= union[-1])) >= shared_part(percent, k) * len(union) - 1e-9


def _linked(x: np.ndarray, y: np.ndarray, percent: int, k: int) -> bool:
    """Size bound, union-sketch estimate, then exact Jaccard of two whole sets, sorted as unsigned."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not _estimate(x, y, percent, k):
        return False
    common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, k: int) -> Iterator[pa.RecordBatch]:
    """(a, b, whole_a, whole_b) -> the pairs that link."""
    for batch in batches:
        a, b, sets_a, sets_b = (batch.column(i) for i in range(4))
        view = lambda s, i: np.frombuffer(s[i].as_buffer(), np.uint64)
        keep = pa.array([_linked(view(sets_a, i), view(sets_b, i), percent, k) for i in range(len(a))], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _block(rows: pa.Table, percent: int, k: int) -> pa.RecordBatch:
    """The links between different components in one block.

    Rows of side 0 meet those of side 1, or all meet all where there is no side 0. A pair that meets in several inverted
    lists is left to the one of its smallest common value.
    """
    ids, n, comp, side = (rows.column(c).to_numpy() for c in ("id", "n", "comp", "side"))
    whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("whole")]
    prefix = [np.asarray(x or (), np.int64) for x in rows.column("prefix").to_pylist()]
    size = np.minimum(n, k)
    values, at, count = np.unique(np.concatenate([x[:k] for x in whole]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), size)
    common = np.flatnonzero(count > 1)
    shared = np.zeros((len(ids), len(ids)), np.float32)
    for lo in range(0, len(common), 4096):
        column = np.full(len(values), -1)
        column[common[lo : lo + 4096]] = np.arange(len(common[lo : lo + 4096]))
        has = column[at] >= 0
        held = np.zeros((len(ids), len(common[lo : lo + 4096])), np.float32)
        held[owner[has], column[at][has]] = 1
        shared += held @ held.T
    ok = (shared >= shared_part(percent, k) * np.maximum(size[:, None], size[None, :]) - 1e-6) & (comp[:, None] != comp[None, :])
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    ok &= (side[:, None] < side[None, :]) if (side == 0).any() else (ids[:, None] < ids[None, :])
    key = rows.column("key")[0].as_py()
    mine = (lambda i, j: np.intersect1d(prefix[i], prefix[j])[0] == key) if rows.column("as_lists")[0].as_py() else (lambda i, j: True)
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(ok), strict=True) if mine(i, j) and _linked(whole[i], whole[j], percent, k)]
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in pairs], pa.int64()) for c in (0, 1)], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (as_lists, key, i, j), each such run being one block."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        keys = np.stack([rows.column(c).to_numpy() for c in ("as_lists", "key", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield _block(rows.slice(lo, hi - lo), percent, k)
        held = rows.slice(cuts[-1])
    if held is not None and len(held):
        yield _block(held, percent, k)


def _alike(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _crowds(rows: DataFrame, cut: Spare) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, n, comp, cluster), and for each key its largest component, the number of its members and of the
    others, and the blocks that each of both fill."""
    rows = cut(rows, "group-members")
    counts = rows.groupBy("key", "cluster", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key", "cluster")
    crowd = counts.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("all")).filter("mains < all")
    crowd = crowd.withColumn("others", F.col("all") - F.col("mains")).drop("all")
    return rows, cut(crowd.withColumns({"mb": F.ceil(F.col("mains") / BLOCK), "ob": F.ceil(F.col("others") / BLOCK)}), "crowds")


def _meetings(rows: DataFrame) -> DataFrame:
    """Each row once for each block it is in: members of a key's largest component (side 0) meet each block of the
    others (side 1), and the others' blocks meet each other and, as side 2, themselves."""
    other = F.col("comp") != F.col("main")
    at = F.pmod(F.xxhash64("id"), F.when(other, F.col("ob")).otherwise(F.col("mb")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    meet = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    block = F.col("at")
    inside = F.when(block == F.col("x"), F.lit(2)).otherwise((block > F.col("x")).cast("int"))
    rows = rows.withColumn("at", at)
    mains = rows.filter(~other).withColumn("x", F.explode(upto("ob"))).withColumn("to", meet(block, -1 - F.col("x"), F.lit(0)))
    met = rows.filter(other).withColumn("x", F.explode(upto("mb"))).withColumn("to", meet(F.col("x"), -1 - block, F.lit(1)))
    among = rows.filter(other).withColumn("x", F.explode(upto("ob"))).withColumn("to", meet(F.least(block, F.col("x")), F.greatest(block, F.col("x")), inside))
    keep = ["as_lists", "key", "to.i", "to.j", "to.side", "id", "n", "comp"]
    return mains.select(*keep).union(met.select(*keep)).union(among.select(*keep))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` (is that id).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered. Texts link where 100 * |A & B| >= percent * |A | B|
    over their distinct ``shingle``-word shingles (64-bit hashes). A text of fewer words is one shingle; null texts and
    texts without words are empty and link with nothing. Equal sets meet first, by a 128-bit signature; the rest runs
    over one row per set. Of each sketch the values rarest in the corpus enter the inverted lists, as many as a pair
    that shares enough values must have one in common among: passages that many texts hold then make no lists unless
    most of a text is such. A list's members are first compared with its smallest id, then, where they are still in
    different components, with a few others; in the lists that still hold several components all members outside the
    largest one are compared with all others, block by block, list by list or over all connected lists at once, whichever
    sends fewer rows. So no link between components is lost, and a large group of near copies costs a multiple of its
    size, not its square. Rows that share an id should share a text. A null id names no component: such a row is kept, with its text's component
    if a row with an id has the same set.
    """
    spark, cut = df.sparkSession, Spare()
    base = cut(sketches(df, id_col, text_col, shingle), "sketches")
    first = base.filter("n > 0 and id is not null").groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("rep"))
    first = cut(first, "sets")
    reps = base.join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "sketch")
    reps = cut(reps, "reps")

    size = F.size("sketch")
    need = F.greatest(F.ceil(size * F.lit(shared_part(percent) - 1e-9)), F.lit(1))
    values = reps.select("id", "n", size.alias("m"), (size - need + 1).alias("width"), F.explode("sketch").alias("value"))
    frequent = cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    shared = values.join(frequent, "value")
    prefixes = cut(
        shared.groupBy("id", "n", "m", "width").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))  # at most a sketch
        .withColumn("left", F.col("width") - (F.col("m") - F.size("vs"))).filter("left > 0")
        .select("id", "n", F.slice("vs", F.lit(1), F.col("left"))["value"].alias("prefix")),
        "prefixes",
    )
    lists = prefixes.select("id", "n", F.explode("prefix").alias("value"))
    mark = lambda k: F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark_{k}")
    ends = lists.groupBy("value").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("len"), mark(1), mark(2)).filter("len > 1")
    ends = cut(ends.groupBy("leader", "len", "mark_1", "mark_2").agg(F.min("value").alias("value")).select("value", "leader", "len"), "ends")  # one of the lists with the same members
    members = cut(lists.join(ends, "value"), "members")

    near = members.select("id").distinct()  # texts and sets meet by merge joins at every size: the sides that could be broadcast grow with the corpus
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(near.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    whole = cut(chosen.mapInArrow(lambda it: _whole(it, shingle), "id long, whole binary"), "wholes")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: whole.select(F.col("id").alias(c), F.col("whole").alias(f"whole_{c}"))
        both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "whole_a", "whole_b")
        return cut(both.mapInArrow(lambda it: _confirm(it, percent, SKETCH), "a long, b long"), "links")

    def grouped(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members with their components so far, and the lists that hold more than one."""
        known = cut(components(links).select(F.col("node").alias("id"), F.col("component").alias("comp")), "known")
        placed = cut(members.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
        ends = placed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("value")
        return known, placed.join(cut(ends, "mixed"), "value")

    sizes = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    both = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    fits = lambda pairs: pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(_alike(percent)).select("a", "b")
    links = confirmed(fits(members.filter("id <> leader").select(*both("id", "leader")).distinct()))

    known, mixed = grouped(links)
    mixed = cut(mixed, "mixed-members")
    more = cut(mixed.groupBy("value").agg(F.array(*(F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in LEADERS)).alias("leaders")), "leaders")
    pairs = mixed.join(more, "value").select("id", "comp", F.explode(F.array_distinct("leaders")).alias("leader")).filter("id <> leader")
    pairs = pairs.distinct().join(known.select(F.col("id").alias("leader"), F.col("comp").alias("to")), "leader", "left").filter(F.col("comp") != F.coalesce("to", "leader"))
    links = links.union(confirmed(fits(pairs.select(*both("id", "leader")).distinct())))

    _, mixed = grouped(links)
    mixed = cut(mixed, "mixed-members")
    clusters = cut(components(mixed.select(F.col("id").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    whole_cluster = mixed.join(clusters, "id").select(F.col("cluster").alias("key"), "id", "n", "comp", "cluster").distinct()
    by_list = mixed.join(clusters.withColumnRenamed("id", "leader"), "leader").select(F.col("value").alias("key"), "id", "n", "comp", "cluster")
    by_list, whole_cluster = _crowds(by_list, cut), _crowds(whole_cluster, cut)
    cost = lambda crowd, name: crowd.groupBy("cluster").agg(F.sum(F.col("mains") * F.col("ob") + F.col("others") * (F.col("mb") + F.col("ob"))).alias(name))
    cheaper = cut(cost(by_list[1], "lists").join(cost(whole_cluster[1], "whole"), "cluster").select("cluster", (F.col("lists") <= F.col("whole")).alias("as_lists")), "cheaper")
    placed = [rows.join(crowd.drop("cluster"), "key").join(cheaper, "cluster").filter(F.col("as_lists") == kind) for (rows, crowd), kind in ((by_list, True), (whole_cluster, False))]
    kept = members.groupBy("id").agg(F.collect_list("value").alias("prefix"))  # at most a prefix
    blocks = (
        _meetings(placed[0].union(placed[1])).join(whole.join(kept, "id"), "id")
        .withColumn("prefix", F.when(F.col("as_lists"), F.col("prefix")))
        .repartition(partitions(spark), "as_lists", "key", "i", "j").sortWithinPartitions("as_lists", "key", "i", "j")
    )
    rest = cut(blocks.mapInArrow(lambda it: _blocks(it, percent, SKETCH), "a long, b long"), "links")
    found = components(links.union(rest)).withColumnRenamed("node", "rep")
    cut.drop_but(base, first)

    classes = first.join(found, "rep", "left").select("sig_a", "sig_b", F.col("n").alias("n_c"), F.coalesce("component", "rep").alias("component"))
    at = [base["sig_a"] == classes["sig_a"], base["sig_b"] == classes["sig_b"], base["n"] == classes["n_c"], base["n"] > 0]
    comp = F.coalesce("component", base["id"])
    return base.join(classes, at, "left").select(base["id"].alias(id_col), base["n"].alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == base["id"], F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group of near duplicates. Rows with a null id stay; rows that share an id share its fate."""
    gone, = own(df, "gone")
    lost = near_duplicates(df, id_col, text_col, shingle, percent).filter("not kept").select(F.col(id_col).alias(gone)).distinct()
    return df.join(lost, F.col(id_col) == F.col(gone), "left_anti")
