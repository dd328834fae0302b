"""Order-dependent refinement of edge tables (src, dst, action, ord): collapse of virtual chains and removal of redundant edges.

Edges count in the order of (ord, src, dst, action). What a rule looks at is
bounded by the rule itself, and only that meets in a task: the virtual nodes that
hang together, or the paths that cost no more than an edge.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.parse import action_count
from trailframe.operators.batch import numbered
from trailframe.operators.components import components
from trailframe.operators.connectivity import LOCAL, numbered_ends, parted
from trailframe.storage import cut

VIRTUAL = "__virt_"
#: Edges into a component of virtual nodes that one task takes.
STARTS = 50_000
ORDER = ["ord", "src", "dst", "action"]


def _virtual(c: str) -> Column:
    return F.col(c).startswith(VIRTUAL)


def _walk(starts: list[tuple], inner: list[tuple]) -> list[tuple]:
    """Offers (src, dst, action, ord, first, place): what each start edge reaches over virtual nodes, depth first, each node once per start edge."""
    out_of = defaultdict(list)
    for src, dst, action in inner:
        out_of[src].append((dst, action))
    out = []
    for src, dst, action, ord_, first in starts:
        seen, stack, place = {dst}, [(dst, action)], 0
        while stack:
            node, path = stack.pop()
            for nxt, step in reversed(out_of[node]):
                if not nxt.startswith(VIRTUAL):
                    out.append((src, nxt, f"{path} | {step}", ord_, first, place))
                    place += 1
                elif nxt not in seen:
                    seen.add(nxt)
                    stack.append((nxt, f"{path} | {step}"))
    return out


def collapse_virtual(edges: DataFrame, starts: int = STARTS) -> DataFrame:
    """Chains over virtual nodes become one edge of several actions; of equal ends the fewest actions win, of these the first.

    Real nodes end every chain, so a task gets a component of virtual nodes (without the real ones) with a block of the edges
    that lead into it.
    """
    spark = edges.sparkSession
    rows = numbered(edges.select("src", "dst", "action", "ord"), ORDER, "first")
    direct = rows.where(~_virtual("src") & ~_virtual("dst")).select("src", "dst", "action", "ord", "first", F.lit(0).alias("place"))
    names, ends = numbered_ends(rows.where(_virtual("src") & _virtual("dst")), rows.where(_virtual("src")).select(F.col("src").alias("node")).union(rows.where(_virtual("dst")).select("dst")))
    roots = components(ends.select("a", "b")).select(F.col("node").alias("id"), "root")
    known = cut(spark, names.join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root")), "virtual")
    into = rows.where(~_virtual("src") & _virtual("dst")).join(known.withColumnRenamed("node", "dst"), "dst")
    sizes = cut(spark, into.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "blocks")
    packs = -(-(sizes.agg(F.sum("n")).first()[0] or 1) // starts)  # small components share a task
    pack = F.when(F.col("n") > starts, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(packs)))
    blocks = sizes.select("root", pack.alias("pack"), F.ceil(F.col("n") / starts).alias("n"))
    into = cut(spark, into.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("first"), F.col("n"))), "into")
    inner = rows.where(_virtual("src")).join(known.withColumnRenamed("node", "src"), "src").join(blocks, "root")
    inner = cut(spark, inner.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))), "inner")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one.sort_values("first"), two.sort_values("first")
        found = _walk(list(one[["src", "dst", "action", "ord", "first"]].itertuples(index=False, name=None)), list(two[["src", "dst", "action"]].itertuples(index=False, name=None)))
        return pd.DataFrame(found, columns=["src", "dst", "action", "ord", "first", "place"])

    chains = into.groupBy("pack", "block").cogroup(inner.groupBy("pack", "block")).applyInPandas(run, "src string, dst string, action string, ord long, first long, place int")
    offers = direct.union(chains).where("src <> dst").withColumn("cost", action_count(F.col("action")))
    best = offers.groupBy("src", "dst").agg(F.min(F.struct("cost", "first", "place", "action", "ord")).alias("b"))
    return best.select("src", "dst", "b.action", "b.ord")


def _pruned(edges: list[tuple]) -> list[int]:
    """edges: (no, a, b, cost) in order. Numbers of those kept: an edge goes if the others reach its end at no more cost."""
    graph: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for no, src, dst, cost in edges:
        graph[src][no] = (dst, cost)
    kept = []
    for no, src, dst, cost in edges:
        del graph[src][no]
        far, heap, reached = {src: 0}, [(0, src)], False
        while heap and not reached:
            d, node = heapq.heappop(heap)
            reached = node == dst
            if reached or d > far[node]:
                continue
            for nxt, c in graph[node].values():
                if d + c <= cost and d + c < far.get(nxt, cost + 1):
                    far[nxt] = d + c
                    heapq.heappush(heap, (d + c, nxt))
        if not reached:
            graph[src][no] = (dst, cost)
            kept.append(no)
    return kept


def _pruned_rounds(rows: DataFrame) -> DataFrame:
    """rows: (no, a, b, cost). The numbers (no) kept, as `_pruned` would, by rounds over all edges at once.

    An edge sees the later edges and those of the earlier ones that are kept. In a round, paths of no more than its cost are
    extended from its start, with the least cost over edges that it surely sees, and over those that it may see as their fate
    is open. It goes if a sure path reaches its end, it stays if none may; the first open edge is always decided.
    """
    spark = rows.sparkSession
    state = cut(spark, rows.select("no", "a", "b", "cost", F.lit(0).alias("fate")), "pruning")  # 0 open, 1 kept, 2 gone
    none = F.lit(None).cast("int")
    while True:
        open_ = state.where("fate = 0").select("no", F.col("a").alias("at"), F.col("b").alias("goal"), F.col("cost").alias("most"))
        if open_.isEmpty():
            return state.where("fate = 1").select("no")
        seen = cut(spark, open_.select("*", F.lit(0).alias("sure"), F.lit(0).alias("may"), F.lit(True).alias("new")), "paths")
        steps = state.where("fate < 2").select(F.col("no").alias("by"), F.col("a").alias("at"), F.col("b").alias("to"), "cost", F.col("fate"))
        while True:
            front = seen.where("new AND at <> goal").join(steps, "at").where((F.col("no") != F.col("by")) & (F.col("may") + F.col("cost") <= F.col("most")))
            plain = (F.col("by") > F.col("no")) | (F.col("fate") == 1)
            ahead = front.select("no", F.col("to").alias("at"), "goal", "most", F.when(plain & (F.col("sure") + F.col("cost") <= F.col("most")), F.col("sure") + F.col("cost")).otherwise(none).alias("sure"), (F.col("may") + F.col("cost")).alias("may"), F.lit(1).alias("fresh"))
            both = seen.select("no", "at", "goal", "most", "sure", "may", F.lit(0).alias("fresh")).union(ahead)
            old = lambda c: F.min(F.when(F.col("fresh") == 0, F.col(c)))
            best = both.groupBy("no", "at", "goal", "most").agg(F.min("sure").alias("sure"), F.min("may").alias("may"), old("sure").alias("s"), old("may").alias("m"))
            better = lambda c, o: F.coalesce(F.col(c) < F.col(o), F.col(c).isNotNull())
            seen = cut(spark, best.select("no", "at", "goal", "most", "sure", "may", (better("sure", "s") & F.col("sure").isNotNull() | better("may", "m")).alias("new")), "paths")
            if seen.where("new AND at <> goal").isEmpty():
                break
        hits = seen.where("at = goal").select("no", F.when(F.col("sure").isNotNull(), 2).otherwise(0).alias("now"))
        decided = state.where("fate = 0").join(hits, "no", "left").select("no", "a", "b", "cost", F.coalesce("now", F.lit(1)).alias("fate"))
        state = cut(spark, state.where("fate > 0").union(decided), "pruning")


def drop_redundant(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Without edges that another path replaces at no more actions; one after the other, in order."""
    rows = numbered(edges.select("src", "dst", "action", "ord"), ORDER, "no").withColumn("cost", action_count(F.col("action")).cast("int"))
    rows = cut(edges.sparkSession, rows, "ordered")
    _, ends = numbered_ends(rows)
    small, large = parted(ends.select("no", "a", "b", "cost"), local)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        return pd.DataFrame({"no": _pruned(list(pdf[["no", "a", "b", "cost"]].itertuples(index=False, name=None)))}, dtype="int64")

    kept = small.groupBy("root").applyInPandas(run, "no long")
    if not large.isEmpty():
        kept = kept.union(_pruned_rounds(large.select("no", "a", "b", "cost")))
    return rows.join(kept, "no", "left_semi").select("src", "dst", "action", "ord")
