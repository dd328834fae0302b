"""Transition graphs as node and edge tables: building, refinement, analytics and search.

Whole-graph steps are DataFrame operations; components and diameters are in
`connectivity`, order-dependent refinements in `refinement`.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.parse import action_count, tokens
from trailframe.operators.batch import numbered
from trailframe.operators.components import components
from trailframe.operators.connectivity import component_stats, numbered_ends, strong_components, weak_components  # noqa: F401
from trailframe.operators.joins import induced
from trailframe.operators.refinement import collapse_virtual, drop_redundant  # noqa: F401
from trailframe.operators.sampling import order_key
from trailframe.operators.tolerance import dedup_tolerant  # noqa: F401
from trailframe.storage import cut


def state_key(state_json: Column) -> Column:
    return F.substring(F.sha2(state_json.cast("binary"), 256), 1, 16)


def pose_key(scene: Column, *numbers: Column) -> Column:
    """Scene and a hash of the pose to four decimals."""
    text = F.concat_ws("_", *(F.format_string("%.4f", n) for n in numbers))
    return F.concat(scene, F.lit("_"), F.substring(F.md5(F.concat_ws("|", scene, text).cast("binary")), 1, 12))


def dedup_nodes(df: DataFrame, key: str, order: str) -> DataFrame:
    """One node per key; the first in order gives the attributes."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def build_edges(transitions: DataFrame) -> DataFrame:
    """Distinct (src, dst, action) without self-loops, with their first place."""
    return transitions.where("src <> dst").groupBy("src", "dst", "action").agg(F.min("ord").alias("ord"))


def shorter_wins(edges: DataFrame) -> DataFrame:
    """For each pair of nodes the edge of fewest actions, of equals the first."""
    w = Window.partitionBy("src", "dst").orderBy("n_actions", "ord")
    return edges.withColumn("n_actions", action_count(F.col("action"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drop_nodes(nodes: DataFrame, edges: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = edges.join(bad.select(F.col("node").alias("src")), "src", "left_anti").join(bad.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(bad, "node", "left_anti"), edges


def split_multi(edges: DataFrame) -> DataFrame:
    """Single-action edges; an edge of k actions passes k - 1 nodes of its own."""
    acts = tokens(F.col("action"))
    name = F.concat(F.lit("__virt_"), F.substring(F.md5(F.concat_ws("|", "src", "dst", "action").cast("binary")), 1, 12), F.lit("_"))
    rows = edges.select("src", "dst", "ord", name.alias("_v"), F.size(acts).alias("_n"), F.posexplode(acts).alias("_i", "_a"))
    return rows.select(
        F.when(F.col("_i") == 0, F.col("src")).otherwise(F.concat("_v", F.col("_i").cast("string"))).alias("src"),
        F.when(F.col("_i") == F.col("_n") - 1, F.col("dst")).otherwise(F.concat("_v", (F.col("_i") + 1).cast("string"))).alias("dst"),
        F.col("_a").alias("action"),
        "ord",
    )


def congruent(edges: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Merge nodes to a fixpoint: same source and action join targets, same target and action join sources.

    Representatives are preferred nodes, else real before virtual ones, else the least name.
    """
    spark = edges.sparkSession
    edges = cut(spark, edges, "congruence")
    while True:  # each round has fewer nodes, or is the last
        side = lambda key, node: edges.groupBy(key, "action").agg(F.min(node).alias("m"), F.max(node).alias("x")).where("m <> x").join(edges, [key, "action"]).select("m", F.col(node).alias("n")).where("m <> n")
        pairs = cut(spark, side("src", "dst").union(side("dst", "src")).distinct(), "pairs")
        if not pairs.limit(1).count():
            return edges
        names, linked = numbered_ends(pairs.select(F.col("m").alias("src"), F.col("n").alias("dst")))
        groups = components(linked.select("a", "b")).withColumnRenamed("node", "id").join(names.withColumnRenamed("node", "n"), "id")
        if preferred is not None:
            groups = groups.join(preferred.select(F.col("node").alias("_p")).distinct(), F.col("n") == F.col("_p"), "left")
        else:
            groups = groups.withColumn("_p", F.lit(None).cast("string"))
        rank = F.struct(F.col("_p").isNull().alias("a"), F.col("n").startswith("__virt_").alias("b"), F.col("n").alias("n"))
        reps = groups.groupBy("root").agg(F.min(rank).alias("r")).select("root", F.col("r.n").alias("rep"))
        renamed = groups.join(reps, "root").select("n", "rep")
        out = edges
        for end in ("src", "dst"):
            out = out.join(renamed.select(F.col("n").alias(end), F.col("rep").alias("_rep")), end, "left").withColumn(end, F.coalesce("_rep", end)).drop("_rep")
        edges = cut(spark, out.where("src <> dst").groupBy("src", "dst", "action").agg(F.min("ord").alias("ord")), "congruence")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, degree) of all nodes, in one aggregate over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("node").join(per, "node", "left").fillna(0).withColumn("degree", F.col("n_in") + F.col("n_out"))


def degree_report(deg: DataFrame) -> DataFrame:
    """Counts of isolated, source, sink, leaf nodes and the mean degree."""
    i, o = F.col("n_in"), F.col("n_out")
    return deg.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if((i == 0) & (o > 0)).alias("sources"),
        F.count_if((o == 0) & (i > 0)).alias("sinks"), F.count_if(F.col("degree") == 1).alias("leaves"), F.avg("degree").alias("mean_degree"),
    )


def degree_histogram(deg: DataFrame, kind: str = "degree", most: int = 30) -> DataFrame:
    return deg.groupBy(F.col(kind).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(most)


def component_sizes(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    size = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    inner = edges.join(labelled.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    out = size.join(inner, "component", "left").fillna(0, ["n_edges"])
    return out.withColumn("avg_degree_multi", 2.0 * F.col("n_edges") / F.col("n_nodes"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops) by breadth-first rounds; each round's frontier is written to the shared folder."""
    spark = edges.sparkSession
    step = edges.select("src", "dst").distinct()
    seen = cut(spark, sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")), "reach")
    front = seen
    for depth in count(1):
        new = front.join(step, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct().join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(depth))
        front = cut(spark, new, "reach")
        if not front.limit(1).count():
            return seen
        seen = seen.union(front)
        if depth % 20 == 0:
            seen = cut(spark, seen, "reach")


def _parents(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, bool]:
    """Breadth-first from src until dst is found or nothing new: (node, hops, parent, action), the least edge that leads to a node; and whether dst was found."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(src, 0, None, None)], "node string, hops int, parent string, action string")
    seen = front = cut(spark, start, "tree")
    for hops in count(1):
        best = edges.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "action")).alias("e"))
        new = best.join(seen, "node", "left_anti").select("node", F.lit(hops).alias("hops"), F.col("e.src").alias("parent"), F.col("e.action").alias("action"))
        front = cut(spark, new, "tree")
        if front.isEmpty():
            return seen, False
        seen = seen.union(front) if hops % 20 else cut(spark, seen.union(front), "tree")
        if not front.where(F.col("node") == dst).isEmpty():
            return seen, True


def shortest_path(edges: DataFrame, src: str, dst: str) -> dict:
    """Nodes and actions of a shortest directed path; -1 with a reason without one; None for an unknown node.

    The search keeps the edge that led to each node; the path's nodes are then found by pointers that reach twice as far in
    each round, so a path of n steps takes n rounds of the search and log n more. Only the path reaches the driver.
    """
    known = edges.where(F.col("src").isin(src, dst) | F.col("dst").isin(src, dst)).select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").isin(src, dst)).distinct().count()
    if known < len({src, dst}):
        return {"length": None, "error": "unknown node"}
    if src == dst:
        return {"length": 0, "path": [src], "actions": []}
    tree, found = _parents(edges, src, dst)
    if not found:
        return {"length": -1, "error": "no path"}
    spark = edges.sparkSession
    on = cut(spark, tree.where(F.col("node") == dst).select("node"), "path")
    jump = cut(spark, tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("to")), "jumps")
    while True:  # what is on the path, and what lies a jump before it
        more = on.join(jump, "node").select(F.col("to").alias("node")).join(on, "node", "left_anti")
        grown = cut(spark, on.union(more), "path")
        if grown.count() == on.count():
            break
        on = grown
        jump = cut(spark, jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "jumps")
    steps = tree.join(on, "node").orderBy("hops").collect()  # the path itself
    return {"length": steps[-1]["hops"], "path": [r["node"] for r in steps], "actions": [r["action"] for r in steps[1:]]}


def top_nodes(nodes: DataFrame, edges: DataFrame, n: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The n nodes of highest degree (ties by name) and the edges among them."""
    top = degrees(nodes, edges).orderBy(F.desc("degree"), "node").limit(n)
    return top, induced(edges, top)


def cluster(nodes: DataFrame, edges: DataFrame, labels: DataFrame, value: str, min_degree: int = 0) -> tuple[DataFrame, DataFrame]:
    """Subgraph of one label's nodes, those under the degree dropped once."""
    own = nodes.join(labels.where(F.col("label") == value).select("node"), "node", "left_semi")
    inner = induced(edges, own)
    if min_degree:
        own = degrees(own, inner).where(F.col("degree") >= min_degree).select("node")
        inner = induced(inner, own)
    return own, inner


def node_detail(edges: DataFrame, node: str) -> DataFrame:
    """In and out edges of one node as sorted arrays."""
    rows = edges.where((F.col("src") == node) | (F.col("dst") == node))
    pick = lambda mine, other: F.sort_array(F.collect_list(F.when(F.col(mine) == node, F.struct(F.col(other).alias("node"), "action"))))
    return rows.agg(pick("src", "dst").alias("out_edges"), pick("dst", "src").alias("in_edges"))


def group_by_field(nodes: DataFrame, field: Column) -> DataFrame:
    return nodes.groupBy(F.coalesce(F.nullif(field.cast("string"), F.lit("")), F.lit("(empty)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def random_walks(edges: DataFrame, walks: int | None, least: int, most: int, seed: int = 42) -> DataFrame:
    """Distinct walks without revisits, their steps chosen by hash: (walk, nodes, actions); as many as nodes that have an edge, if not given.

    A dead end discards a walk; one with all neighbours visited stops and counts
    if long enough. All walks take their steps together, one join per step.
    """
    spark = edges.sparkSession
    starts = edges.select("src").distinct()
    ring = numbered(starts.withColumn("_h", order_key("start", "src", seed=seed)), ["_h", "src"], "_r").drop("_h")
    total = starts.agg(F.count(F.lit(1)).alias("_t"))
    walks = starts.count() if walks is None else walks
    new = spark.range(walks).withColumnRenamed("id", "walk").join(total, F.lit(True)).withColumn("_r", F.pmod(F.col("walk"), F.col("_t"))).join(ring, "_r")
    now = new.select("walk", F.col("src").alias("at"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("actions"), (least + F.pmod(F.conv(F.substring(order_key("goal", "walk", seed=seed), 1, 8), 16, 10).cast("long"), F.lit(most - least + 1))).alias("goal"), F.lit(False).alias("over"))
    for _ in range(most):
        live = now.where(~F.col("over") & (F.size("actions") < F.col("goal")))
        steps = live.join(edges.select("src", "dst", "action"), F.col("at") == F.col("src"))
        fresh = steps.where(~F.array_contains("nodes", F.col("dst"))).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("walk").cast("string"), F.size("actions").cast("string"), "dst", "action").cast("binary")))
        chosen = fresh.groupBy("walk").agg(F.min(F.struct("_h", "dst", "action")).alias("s"))
        dead = steps.select("walk").distinct()
        moved = live.join(chosen, "walk").select("walk", F.col("s.dst").alias("at"), F.concat("nodes", F.array("s.dst")).alias("nodes"), F.concat("actions", F.array("s.action")).alias("actions"), "goal", "over")
        stuck = live.join(chosen, "walk", "left_anti").join(dead, "walk", "left_semi").withColumn("over", F.lit(True))
        ended = now.where(F.col("over") | (F.size("actions") >= F.col("goal")))
        now = cut(spark, ended.union(stuck.select(ended.columns)).union(moved), "walks")
    whole = now.where(F.size("actions") >= least)
    return whole.groupBy("nodes", "actions").agg(F.min("walk").alias("walk")).select("walk", "nodes", "actions")


def grid_regions(cells: DataFrame) -> DataFrame:
    """Connected regions of (x, y) cells by their four neighbours: (x, y, region)."""
    key = lambda x, y: F.concat_ws(",", x.cast("string"), y.cast("string"))
    rows = cells.select("x", "y", key(F.col("x"), F.col("y")).alias("node")).distinct()
    near = rows.select("node", F.explode(F.array(key(F.col("x") + 1, F.col("y")), key(F.col("x"), F.col("y") + 1))).alias("dst"))
    edges = near.join(rows.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("node").alias("src"), "dst")
    return rows.join(weak_components(rows, edges), "node").select("x", "y", F.col("component").alias("region"))
