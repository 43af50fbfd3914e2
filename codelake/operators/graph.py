"""Graph operators over edge tables: reachability with two strengths, weak components, cycles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

LOCAL_EDGES = 200_000
"""Edges and roots up to which a closure runs as one task: rounds of joins cost more than the whole walk."""


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (src, dst, strong), a root being a row without dst -> (node, strong)."""
    rows = pd.concat([pd.DataFrame(columns=["src", "dst", "strong"]), *(b for b in batches if len(b))], ignore_index=True)
    step: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    seen: dict[str, bool] = {}
    work = []
    for src, dst, strong in rows.itertuples(index=False):
        if dst is None:
            seen[src] = True
            work.append(src)
        else:
            step[src].append((dst, strong))
    while work:
        node = work.pop()
        strong = seen[node]
        for to, edge in step[node]:
            best = strong and edge
            if to not in seen or best and not seen[to]:
                seen[to] = best
                work.append(to)
    yield pd.DataFrame({"node": list(seen), "strong": list(seen.values())}).astype({"node": "object", "strong": "bool"})


def reachable(roots: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """roots(node), edges(src, dst, strong) of strings -> (node, strong): all reachable nodes, and whether strong edges alone reach them.

    A node is visited again when a strong way to it turns up, so the result is that of two closures. Up to ``local_edges``
    edges and roots one task walks the graph; beyond, each round is a join of the frontier with the edges.
    """
    edges, roots = cut(edges.groupBy("src", "dst").agg(F.bool_or("strong").alias("strong"))), cut(roots.select("node").distinct())
    if edges.count() + roots.count() <= local_edges:
        rows = edges.unionByName(roots.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(True).alias("strong")))
        return rows.coalesce(1).mapInPandas(_walk, "node string, strong boolean")
    seen = frontier = cut(roots.select("node", F.lit(True).alias("strong")).distinct())
    while not frontier.isEmpty():
        to = frontier.withColumnRenamed("strong", "way").join(edges, F.col("node") == F.col("src"))
        to = to.groupBy(F.col("dst").alias("node")).agg(F.bool_or(F.col("way") & F.col("strong")).alias("strong"))
        known = seen.withColumnRenamed("strong", "had")
        frontier = cut(to.join(known, "node", "left").filter(F.col("had").isNull() | (F.col("strong") & ~F.col("had"))).select("node", "strong"))
        seen = cut(seen.union(frontier).groupBy("node").agg(F.bool_or("strong").alias("strong")))
    return seen


def weak_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (node, component): the smallest node that undirected edges reach."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("component")))
    pairs = cut(pairs)
    while not pairs.isEmpty():
        both = pairs.select(F.col("a").alias("label"), F.col("b").alias("by")).union(pairs.select("b", "a"))
        near = cut(both.groupBy("label").agg(F.min("by").alias("by")).select("label", F.least("label", "by").alias("next")))
        far = near.select(F.col("label").alias("next"), F.col("next").alias("far"))
        near = cut(near.join(far, "next", "left").select("label", F.coalesce("far", "next").alias("next")))
        move = lambda df, c: df.join(near.select(F.col("label").alias(c), F.col("next").alias(f"to_{c}")), c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")  # noqa: B023, E731
        nodes = cut(move(nodes, "component"))
        pairs = cut(move(move(pairs, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return nodes


def find_cycles(step: dict[str, list[str]]) -> list[list[str]]:
    """The cycles that back edges of a depth-first walk close, nodes and neighbours in sorted order.

    Each cycle is turned so that its smallest node comes first; a cycle is listed once. The walk keeps its own stack.
    """
    state: dict[str, int] = {}
    found: set[tuple[str, ...]] = set()
    for start in sorted(step):
        if start in state:
            continue
        path, todo = [start], [iter(sorted(step[start]))]
        place = {start: 0}
        state[start] = 1
        while todo:
            for to in todo[-1]:
                if state.get(to) == 1:
                    cycle = path[place[to] :]
                    low = cycle.index(min(cycle))
                    found.add(tuple(cycle[low:] + cycle[:low]))
                elif to not in state:
                    state[to], place[to] = 1, len(path)
                    path.append(to)
                    todo.append(iter(sorted(step.get(to, ()))))
                    break
            else:
                state[path[-1]] = 2
                del place[path.pop()]
                todo.pop()
    return [list(c) for c in sorted(found)]


def _cycles_of(group: pd.DataFrame) -> pd.DataFrame:
    step: dict[str, list[str]] = defaultdict(list)
    for src, dst in zip(group.src, group.dst, strict=True):
        step[src].append(dst)
        step.setdefault(dst, [])
    return pd.DataFrame({"cycle": find_cycles(step)})


def cycles(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (cycle): one array of nodes for each back edge's cycle of the sorted depth-first walk.

    Nodes without an edge onwards are on no cycle and cannot choose where a walk enters one: they are trimmed, over and
    over. What is left falls into weak components, which the walk visits one after another, so walking each on its own
    gives the walk's own result.
    """
    edges = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    size = edges.count()
    while size:
        left = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        edges, before, size = left, size, left.count()
        if size == before:
            break
    parts = weak_components(edges).select(F.col("node").alias("src"), "component")
    return edges.join(parts, "src").groupBy("component").applyInPandas(_cycles_of, "cycle array<string>")


def mutual_reach(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (node, component): members of strongly connected components of two nodes or more, by smallest member.

    Sinks and sources are trimmed over and over; what is left is walked component by weak component.
    """
    edges = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    size = edges.count()
    while size:
        inner = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = cut(inner.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        edges, before, size = inner, size, inner.count()
        if size == before:
            break
    parts = weak_components(edges).select(F.col("node").alias("src"), "component")
    return edges.join(parts, "src").groupBy("component").applyInPandas(_strong_of, "node string, component string")


def _strong_of(group: pd.DataFrame) -> pd.DataFrame:
    """Strong components by two walks: an order of finishing, then the reversed edges in that order."""
    step, back = defaultdict(list), defaultdict(list)
    for src, dst in zip(group.src, group.dst, strict=True):
        step[src].append(dst)
        back[dst].append(src)
    seen: set[str] = set()
    order: list[str] = []
    for start in sorted({*step, *back}):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(step[start]))]
        while stack:
            node, rest = stack[-1]
            to = next((t for t in rest if t not in seen), None)
            if to is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(to)
                stack.append((to, iter(step[to])))
    owner: dict[str, int] = {}
    for k, start in enumerate(reversed(order)):
        work = [start] if start not in owner else []
        while work:
            node = work.pop()
            if node not in owner:
                owner[node] = k
                work += [t for t in back[node] if t not in owner]
    members = defaultdict(list)
    for node, k in owner.items():
        members[k].append(node)
    rows = [(n, min(m)) for m in members.values() if len(m) > 1 for n in m]
    return pd.DataFrame(rows, columns=["node", "component"])
