"""Near-duplicate vectors within a label: PCA-ordered tiles, leading dimensions first, stopped by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .prefix import prefix_sums
from .shared import Spare, partitions

TILE = 512
"""Vectors of a tile."""
FIT_ROWS = 20_000
"""Vectors on which the principal axes are fitted, by smallest hash: the axes set the order of work, never a result."""
SLACK = 1e-9
"""Far above the rounding of a projection: pairs this close to the threshold are decided on the vectors as given."""
STRIP_BYTES = 8 << 20
"""Bytes of the neighbouring tiles that travel together: two such strips are one task's unit of work."""
STEPS = (8, 16, 32)
"""Leading dimensions after which pairs that cannot reach the threshold any more are dropped."""


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vec): float64 bytes of vectors that have a direction, null for all others."""
    for batch in batches:
        out = []
        for x in batch.column(2):
            v = x.values
            v = None if v is None or not len(v) or v.null_count else v.to_numpy(zero_copy_only=False).astype(np.float64)
            out.append(None if v is None or not np.isfinite(v).all() or not v.any() else (v + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def principal_axes(sample: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes of the sample's second moments, largest first; the executors send dims x dims sums."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            rows = _unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dims)) if len(batch) else np.zeros((0, dims))
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    total = np.zeros((dims, dims))
    for r in sample.select("vec").mapInArrow(moments, "m binary").toLocalIterator():
        total += np.frombuffer(bytes(r.m)).reshape(dims, dims)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _project(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds each vector's unit form on the axes (its own where it has another length) and its first coordinate."""
    for batch in batches:
        x, p = [], []
        for v in batch.column("vec"):
            u = _unit(np.frombuffer(v.as_buffer(), np.float64).reshape(1, -1))
            u = u @ axes if u.shape[1] == len(axes) else u
            x.append(u[0, 0])
            p.append(u.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.float64()), pa.array(p, pa.binary())], [*batch.schema.names, "x", "p"])


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label, length and first coordinate -> one row for each run of at most ``size`` of them."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def tile(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        number += 1
        x = rows.column("x").to_numpy()
        blobs = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "n")] + [b"".join(rows.column(c).to_pylist()) for c in ("p", "vec")]
        head = rows.slice(0, 1).select(["label", "dims"]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*head.columns, pa.array([number]), pa.array([x.min()]), pa.array([x.max()]), *(pa.array([b], pa.binary()) for b in blobs)], ["label", "dims", "tile", "low", "high", "ids", "ns", "ps", "vs"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        label, dims = (rows.column(c).to_numpy() for c in ("label", "dims"))
        cuts = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            while hi - lo >= size or (hi < len(rows) and hi > lo):
                yield tile(rows.slice(lo, min(size, hi - lo)))
                lo += min(size, hi - lo)
        held = rows.slice(lo)
    if held is not None and len(held):
        yield tile(held)


def _linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs at or over the threshold; ``same`` keeps i < j."""
    dims, done = a.shape[1], 0
    i = j = dot = None
    for upto in (*(s for s in STEPS if s < dims), dims):
        tail_a, tail_b = (np.sqrt((p[:, upto:] ** 2).sum(axis=1)) for p in (a, b))
        if i is None:
            every = a[:, :upto] @ b[:, :upto].T
            i, j = np.nonzero(every + np.outer(tail_a, tail_b) >= cosine - SLACK)
            if same:
                i, j = i[i < j], j[i < j]
            dot = every[i, j]
        else:
            for k in range(0, len(i), 65_536):
                at = slice(k, k + 65_536)
                dot[at] += np.einsum("ij,ij->i", a[i[at], done:upto], b[j[at], done:upto])
            keep = dot + tail_a[i] * tail_b[j] >= cosine - SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
        done = upto
    close = np.abs(dot - cosine) <= SLACK  # the axes' rounding must not decide: the vectors themselves do
    if close.any():
        u, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (raw_a[i[close]], raw_b[j[close]]))  # no square overflows
        dot[close] = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
    return i[dot >= cosine], j[dot >= cosine]


def _compare(rows: pa.Table, cosine: float) -> pa.Table:
    """The tiles of two strips (or one) that have partners there -> for each pair of tiles that lies close enough a forest
    of its links (degree 0) and each vector's number of links (a = b)."""
    dims, tiles = rows.column("dims")[0].as_py(), []
    rows = rows.sort_by("seq").combine_chunks()
    for r in range(len(rows)):
        get = lambda c, t: np.frombuffer(rows.column(c)[r].as_buffer(), t)  # noqa: B023, E731
        p = get("ps", np.float64).reshape(-1, dims)
        lead = p[:, : STEPS[0]]
        tiles.append((rows.column("strip")[r].as_py(), lead.min(axis=0), lead.max(axis=0), get("ids", np.int64), get("ns", np.int64), p, get("vs", np.float64).reshape(-1, dims)))
    one = rows.column("sa")[0].as_py() == rows.column("sb")[0].as_py()
    out: list[list[np.ndarray]] = []
    for x in range(len(tiles)):
        for y in range(x, len(tiles)):
            (strip_a, low_a, high_a, ids_a, ns_a, a, raw_a), (strip_b, low_b, high_b, ids_b, ns_b, b, raw_b) = tiles[x], tiles[y]
            gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))  # between the boxes around their leading coordinates
            if (not one and strip_a == strip_b) or (gap**2).sum() > (_reach(cosine) + SLACK) ** 2:
                continue
            i, j = _linked(a, b, raw_a, raw_b, x == y, cosine)
            if len(i):
                out.append(_forest(i, j, ids_a, ns_a) if x == y else _forest(i, j + len(ids_a), np.concatenate([ids_a, ids_b]), np.concatenate([ns_a, ns_b])))
    cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
    return pa.table([pa.array(c) for c in cols], ["a", "b", "degree"])


def _reach(cosine: float) -> float:
    """How far apart unit vectors of that cosine are, and hence their coordinates at most."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK


def _forest(i: np.ndarray, j: np.ndarray, nodes: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Links between places of ``nodes``, which stand for ``count`` rows each -> columns (a, b, degree)."""
    degree = np.bincount(i, count[j], len(nodes)).astype(np.int64) + np.bincount(j, count[i], len(nodes)).astype(np.int64)
    low = np.arange(len(nodes))
    before = None
    while before is None or (low != before).any():
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
    joined, has = np.flatnonzero(low != np.arange(len(nodes))), np.flatnonzero(degree)
    return [np.concatenate([nodes[joined], nodes[has]]), np.concatenate([nodes[low[joined]], nodes[has]]), np.concatenate([np.zeros(len(joined), np.int64), degree[has]])]


def _partners(tiles: DataFrame, cosine: float) -> DataFrame:
    """(tile, seq, strip, first, last): a tile's place among those of its label and length, its strip, and the strips of its partners.

    Tiles are sorted and apart, so the lower and upper ends of their first coordinates ascend alike. In one sorted list of
    the lower ends and of the upper ends plus the reach, a tile's partners begin behind the upper ends before its lower
    end, and end with the lower ends before its upper end: two prefix sums, and no pair of tiles is looked at.
    """
    end = lambda c, kind: tiles.select(F.struct("label", "dims").alias("g"), "dims", "tile", c.alias("at"), F.lit(kind).alias("kind"), F.lit(1 - kind).alias("lower"))
    run = prefix_sums(end(F.col("low"), 0).union(end(F.col("high") + _reach(cosine), 1)), [F.col("at"), F.col("kind"), F.col("tile")], "lower", "g")
    lower, upper = F.col("kind") == 0, F.col("kind") == 1
    found = run.groupBy("tile", "dims").agg(
        F.max(F.when(lower, F.col("sum_before"))).alias("seq"), F.max(F.when(lower, F.col("row_before") - F.col("sum_before"))).alias("first"),
        F.max(F.when(upper, F.col("sum_before") - 1)).alias("last"),
    )
    many = F.greatest(F.lit(1), F.floor(F.lit(STRIP_BYTES) / (F.col("dims") * 16 * TILE))).cast("long")
    return found.select("tile", "seq", *(F.floor(F.col(c) / many).alias(n) for c, n in (("seq", "strip"), ("first", "first"), ("last", "last"))))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal non-null labels and equal lengths link at a cosine, in double precision, of at least ``cosine``.
    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing and is its own
    component, as is one whose label is null. Equal vectors of a label are compared once; each counts as a link of the
    others. The distinct ones are sorted by their first principal coordinate and cut into tiles of TILE vectors. Two
    tiles meet unless their leading coordinates lie further apart than the threshold allows. Neighbouring tiles travel in
    strips of about STRIP_BYTES, so a tile is sent once for each strip within reach, not once for each tile there. Tasks send
    link counts and a forest for each pair of tiles, never the pairs, so a large group of close vectors stays small. The work
    is quadratic in a label's distinct vectors as far as leading coordinates overlap. Rows that share an id are one node.
    """
    spark, cut = df.sparkSession, Spare()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    label = rows.schema["label"].dataType.simpleString()
    base = cut(rows.mapInArrow(_usable, f"id long, label {label}, vec binary"), "vectors")
    classes = cut(base.filter("label is not null and vec is not null and id is not null").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("dims", (F.length("vec") / 8).cast("int")), "classes")

    common = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "dims").limit(1).collect()
    axes = np.zeros((0, 0))
    if common:
        part = min(1.0, FIT_ROWS / common[0].rows)
        axes = principal_axes(classes.filter((F.col("dims") == common[0].dims) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20))), common[0].dims)
    projected = classes.select("id", "n", "label", "dims", "vec").mapInArrow(lambda it: _project(it, axes), f"id long, n long, label {label}, dims int, vec binary, x double, p binary")
    order, size = ["label", "dims", "x", "id"], TILE
    tiles = cut(
        projected.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .mapInArrow(lambda it: _tiles(it, size), f"label {label}, dims int, tile long, low double, high double, ids binary, ns binary, ps binary, vs binary"),
        "tiles",
    )
    sent = tiles.join(cut(_partners(tiles, cosine), "tile-order"), "tile").withColumn("other", F.explode(F.sequence("first", "last")))
    sent = sent.select("label", "dims", F.least("strip", "other").alias("sa"), F.greatest("strip", "other").alias("sb"), "strip", "seq", "ids", "ns", "ps", "vs")
    links = cut(sent.groupBy("label", "dims", "sa", "sb").applyInArrow(lambda rows: _compare(rows, cosine), "a long, b long, degree long"), "tile-links")

    found = components(links.filter("degree = 0").select("a", "b"))
    degrees = links.filter("degree > 0").groupBy(F.col("a").alias("id")).agg(F.sum("degree").alias("degree"))
    known = cut(classes.select("label", "vec", "id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").join(degrees, "id", "left"), "class-links")
    cut.drop_but(base, known)
    right = known.select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), F.coalesce("component", "id").alias("component"), (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("links"))
    comp = F.coalesce("component", "id")
    return base.join(right, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")) & F.col("id").isNotNull(), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept")
    )
