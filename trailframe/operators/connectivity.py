"""Weak and strong components, and their diameters, over numbered nodes.

Node names are numbered once and joined back, so no hash of a name stands for
it. Components come from rounds of joins; what fits a task (`local` edges of a
weak component) is solved there, at once for many small components, and larger
components go through distributed rounds with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.operators.components import components
from trailframe.storage import cut, discard

#: Edges of a weak component that one task takes.
LOCAL = 200_000
#: Nodes up to which a component's diameter is computed, as in the reported statistics.
DIAMETER_NODES = 5000


def numbered_ends(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names (node, id) of all ends (and nodes), and the edges with their ends' numbers a and b."""
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if nodes is not None:
        names = names.union(nodes.select("node"))
    names = cut(edges.sparkSession, names.distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    out = edges
    for end, number in (("src", "a"), ("dst", "b")):
        out = out.join(names.select(F.col("node").alias(end), F.col("id").alias(number)), end)
    return names, out.select(*edges.columns, "a", "b")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node name of those reachable either way."""
    names, ends = numbered_ends(edges, nodes)
    roots = components(ends.select("a", "b")).select(F.col("node").alias("id"), "root")
    named = names.join(roots, "id", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("node").alias("component"))
    labelled = named.join(least, "root", "left").select("node", F.coalesce("component", "node").alias("component"))
    return nodes.select("node").join(labelled, "node")


def strong_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's strong component: one depth-first pass with a path stack."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    src, dst = ends[: len(a)], ends[len(a) :]
    order = np.argsort(src, kind="stable")
    head = np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist()
    to = dst[order].tolist()
    index, low = [-1] * len(nodes), [0] * len(nodes)
    out = np.arange(len(nodes))
    path: list[int] = []
    clock = 0
    for start in range(len(nodes)):
        if index[start] >= 0:
            continue
        work = [start]
        at = {start: head[start]}
        index[start] = low[start] = clock
        clock += 1
        path.append(start)
        while work:
            n = work[-1]
            if at[n] < head[n + 1]:
                m = to[at[n]]
                at[n] += 1
                if index[m] < 0:
                    index[m] = low[m] = clock
                    clock += 1
                    path.append(m)
                    work.append(m)
                    at[m] = head[m]
                elif low[m] < len(nodes):  # not closed yet
                    low[n] = min(low[n], index[m])
                continue
            work.pop()
            if low[n] == index[n]:
                own = []
                while not own or own[-1] != n:
                    own.append(path.pop())
                out[own] = min(own)
                for m in own:
                    low[m] = len(nodes)
            if work:
                low[work[-1]] = min(low[work[-1]], low[n])
    return nodes, nodes[out]


def _strong_rounds(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Rows (node, scc) of the nodes on cycles, by colouring.

    Nodes without an edge in or out are trimmed; every other one takes the greatest number that reaches it; the nodes of a
    colour that reach its source form its component and leave, with all edges between colours. Each step is written; the
    rounds grow with the longest shortest path and the depth of components, not with the edges.
    """
    spark = edges.sparkSession
    live = cut(spark, edges.where("a <> b").distinct(), "strong")
    found = spark.createDataFrame([], "node bigint, scc bigint")
    left = live.count()
    while left:
        core = live.select(F.col("a").alias("n")).intersect(live.select(F.col("b").alias("n")))
        kept = cut(spark, live.join(core.withColumnRenamed("n", "a"), "a", "left_semi").join(core.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b"), "strong")
        discard(live)
        live, before, left = kept, left, kept.count()
        if left < before or not left:
            continue
        colour = cut(spark, live.select(F.col("a").alias("n")).distinct().withColumn("c", F.col("n")), "colours")
        moved = colour
        while True:  # only nodes whose colour rose pass it on
            offer = live.join(moved.withColumnRenamed("n", "a"), "a").groupBy(F.col("b").alias("n")).agg(F.max("c").alias("o"))
            after = cut(spark, colour.join(offer, "n", "left").select("n", F.greatest("c", F.coalesce("o", "c")).alias("c"), (F.coalesce("o", "c") > F.col("c")).alias("rose")), "colours")
            colour, moved = after.select("n", "c"), after.where("rose").select("n", "c")
            if moved.isEmpty():
                break
        side = lambda n: colour.select(F.col("n").alias(n), F.col("c").alias(f"c{n}"))
        inside = cut(spark, live.join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b"), "strong")
        seen = cut(spark, colour.where("n = c"), "reached")
        front = seen
        while True:  # backwards from each colour's source
            new = inside.join(front.withColumnRenamed("n", "b"), "b").select(F.col("a").alias("n"), "c").distinct().join(seen, "n", "left_anti")
            front = cut(spark, new, "reached")
            if front.isEmpty():
                break
            seen = cut(spark, seen.union(front), "reached")
        found = cut(spark, found.union(seen), "found")
        live = cut(spark, inside.join(seen.select(F.col("n").alias("a")), "a", "left_anti").join(seen.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b"), "strong")
        left = live.count()
    return found


def parted(ends: DataFrame, local: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b and more) with the root of their weak component: of those that fit a task, and of the larger ones."""
    roots = components(ends.select("a", "b")).select(F.col("node").alias("a"), "root")
    rows = cut(ends.sparkSession, ends.join(roots, "a"), "parted")
    large = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("root")
    return rows.join(large, "root", "left_anti"), rows.join(large, "root", "left_semi")


def strong_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, scc): the least name of the nodes on common cycles, for every node with an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        root, size = None, 0

        def solve() -> pa.RecordBatch:
            nodes, scc = strong_of(*(np.concatenate([x[i] for x in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(scc)], names=["node", "scc"])

        for batch in batches:  # components are disjoint, so that several are solved in one pass
            a, b, r = (np.asarray(batch.column(i)) for i in range(3))
            for i, j in zip(*_runs(r)):
                if r[i] != root and size >= local:
                    yield solve()
                    held, size = [], 0
                root = r[i]
                held.append((a[i:j], b[i:j]))
                size += j - i
        if held:
            yield solve()

    names, ends = numbered_ends(edges)
    small, large = parted(ends.where("a <> b").select("a", "b").distinct(), local)
    found = small.select("a", "b", "root").repartition("root").sortWithinPartitions("root").mapInArrow(run, "node bigint, scc bigint")
    if not large.isEmpty():
        found = found.union(_strong_rounds(large.select("a", "b")))
    named = names.join(found.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("scc", "id").alias("scc"))
    named = cut(edges.sparkSession, named, "strong")
    return named.join(named.groupBy("scc").agg(F.min("node").alias("least")), "scc").select("node", F.col("least").alias("scc"))


def _runs(key: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of runs of equal values."""
    if not len(key):
        return [], []
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first.tolist(), np.append(first[1:], len(key)).tolist()


def diameter_of(a: np.ndarray, b: np.ndarray) -> int:
    """Longest shortest path of a connected undirected graph: breadth-first from 64 nodes at a time, a bit for each."""
    _, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = int(ends.max(initial=-1)) + 1
    src, dst = ends[: len(a)], ends[len(a) :]
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    to = pairs % n
    head = np.searchsorted(pairs // n, np.arange(n))
    widest = 0
    for at in range(0, n, 64):
        own = np.arange(at, min(at + 64, n))
        seen = np.zeros(n, np.uint64)
        seen[own] = np.uint64(1) << (own - at).astype(np.uint64)
        steps = 0
        while True:  # a node has seen what its neighbours have
            after = seen | np.bitwise_or.reduceat(seen[to], head)
            if (after == seen).all():
                break
            seen, steps = after, steps + 1
        widest = max(widest, steps)
    return widest


def component_stats(edges: DataFrame, most: int = DIAMETER_NODES) -> DataFrame:
    """Per weak component: least name, nodes, edges, mean simple degree and undirected diameter (-1 beyond `most` nodes).

    Only components of at most `most` nodes reach a task, as distinct pairs of numbers.
    """
    names, ends = numbered_ends(edges)
    spark = edges.sparkSession
    roots = cut(spark, components(ends.select("a", "b")).select(F.col("node").alias("id"), "root"), "roots")
    inside = cut(spark, names.join(roots, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root")), "roots")
    per = inside.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n_nodes"))
    of_edge = ends.join(inside.select(F.col("id").alias("a"), "root"), "a")
    counts = of_edge.groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"))
    pairs = of_edge.select("root", "a", "b").distinct()
    simple = pairs.groupBy("root").agg(F.count(F.lit(1)).alias("simple"))
    small = pairs.join(per.where(F.col("n_nodes") <= most).select("root"), "root", "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"root": pdf["root"].iloc[:1], "diameter": [diameter_of(pdf["a"].to_numpy(), pdf["b"].to_numpy())]})

    width = small.groupBy("root").applyInPandas(run, "root bigint, diameter bigint")
    out = per.join(counts, "root").join(simple, "root").join(width, "root", "left")
    return out.select("component", "n_nodes", "n_edges", (2.0 * F.col("simple") / F.col("n_nodes")).alias("avg_degree_simple"), F.coalesce("diameter", F.lit(-1).cast("long")).alias("diameter"))
