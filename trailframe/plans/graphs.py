"""Transition graphs over events, and search in them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import graph as G
from trailframe.operators import trajectories as T
from trailframe.plans.catalog import EVENTS, Catalog, events, table

catalog = Catalog()


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between `user:event_type` nodes, without self-loops."""
    rows = events(spark, sf_dir).withColumn("state", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return G.build_edges(T.transitions(rows, "user_id", ["ts", "event_id"], "state", "action"))


def transition_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("node")).distinct()


EDGES = f"""{EVENTS}, t AS (SELECT user_id || ':' || event_type AS src, action, lead(user_id || ':' || event_type) OVER w AS dst, row_number() OVER w AS ord FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT src, dst, action, min(ord) AS ord FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), nodes AS (SELECT DISTINCT user_id || ':' || event_type AS node FROM ev)"""


@catalog.add(f"WITH {EDGES} SELECT src, dst, action, CAST(ord AS INTEGER) AS ord FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_edges(spark, sf_dir)


@catalog.add("""
SELECT event_id, substr(sha256(props), 1, 16) AS state_key, CAST(user_id AS VARCHAR) || '_' || substr(md5(CAST(user_id AS VARCHAR) || '|' || printf('%.4f', value) || '_' || printf('%.4f', value * 2)), 1, 12) AS pose_key FROM events""")
def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", G.state_key(F.col("props")).alias("state_key"), G.pose_key(F.col("user_id").cast("string"), F.col("value"), F.col("value") * 2).alias("pose_key"))


@catalog.add("""
SELECT props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY props ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedup_nodes(table(spark, sf_dir, "events"), "props", "event_id").select("props", "event_id")


@catalog.add("""
WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS b, event_id AS o, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
g AS (SELECT b, r, o, v, [{'o': o, 'v': v}] AS kept, o AS rep FROM s WHERE r = 1
  UNION ALL SELECT b, r, o, v, CASE WHEN len(near) = 0 THEN list_append(kept, {'o': o, 'v': v}) ELSE kept END, CASE WHEN len(near) = 0 THEN o ELSE near[1].o END
  FROM (SELECT s.b, s.r, s.o, s.v, g.kept, list_filter(g.kept, lambda x: abs(x.v - s.v) <= 0.5) AS near FROM g JOIN s ON s.b = g.b AND s.r = g.r + 1))
SELECT b, o, v AS v0, rep FROM g""")
def node_dedup_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dedup_tolerant(table(spark, sf_dir, "events"), "user_id", "event_id", ["value"], 0.5)


@catalog.add(f"""
WITH {EDGES}, n AS (SELECT *, len(string_split(action, ' | ')) AS n_actions FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n_actions, ord) AS r FROM n)
SELECT src, dst, action, CAST(n_actions AS INTEGER) AS n_actions FROM r WHERE r = 1""")
def edge_shorter_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shorter_wins(transition_edges(spark, sf_dir)).select("src", "dst", "action", "n_actions")


@catalog.add(f"""
WITH {EDGES} SELECT src, dst, action FROM e WHERE NOT contains(action, '|')""")
def drop_multi_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transition_edges(spark, sf_dir).where(~F.col("action").contains("|")).select("src", "dst", "action")


@catalog.add(f"""
WITH {EDGES}, d AS (SELECT node, count(*) FILTER (WHERE o = 1) AS n_out, count(*) FILTER (WHERE o = 0) AS n_in FROM (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node)
SELECT node, CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out, CAST(coalesce(n_in + n_out, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN d USING (node)""")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(transition_nodes(spark, sf_dir), transition_edges(spark, sf_dir))


@catalog.add(f"""
WITH {EDGES}, d AS (SELECT node, count(o) FILTER (WHERE o = 1) AS n_out, count(o) FILTER (WHERE o = 0) AS n_in FROM nodes LEFT JOIN (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) USING (node) GROUP BY node)
SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (WHERE n_in + n_out = 0) AS BIGINT) AS isolated, CAST(count(*) FILTER (WHERE n_in = 0 AND n_out > 0) AS BIGINT) AS sources, CAST(count(*) FILTER (WHERE n_out = 0 AND n_in > 0) AS BIGINT) AS sinks,
  CAST(count(*) FILTER (WHERE n_in + n_out = 1) AS BIGINT) AS leaves, round(avg(n_in + n_out), 6) + 0.0 AS mean_degree FROM d""")
def degree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.degree_report(G.degrees(transition_nodes(spark, sf_dir), transition_edges(spark, sf_dir)))
    return out.withColumn("mean_degree", F.round("mean_degree", 6) + 0.0)


@catalog.add(f"""
WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), top AS (SELECT node FROM nodes LEFT JOIN d USING (node) ORDER BY coalesce(degree, 0) DESC, node LIMIT 100)
SELECT src, dst, action FROM e WHERE src IN (FROM top) AND dst IN (FROM top)""")
def induced_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_nodes(transition_nodes(spark, sf_dir), transition_edges(spark, sf_dir), 100)[1].select("src", "dst", "action")


@catalog.add(f"""
WITH {EDGES}, u AS (SELECT DISTINCT split_part(node, ':', 1) AS u, node FROM nodes), k AS (SELECT u, min(node) AS component FROM u GROUP BY u) SELECT node, component FROM u JOIN k USING (u)""")
def components_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's nodes are one component, as its trajectory links them."""
    return G.weak_components(transition_nodes(spark, sf_dir), transition_edges(spark, sf_dir))


@catalog.add(f"""
WITH {EDGES}, n AS (SELECT split_part(node, ':', 1) AS u, min(node) AS component, count(*) AS n_nodes FROM nodes GROUP BY 1), m AS (SELECT split_part(src, ':', 1) AS u, count(*) AS n_edges FROM e GROUP BY 1)
SELECT component, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(coalesce(n_edges, 0) AS BIGINT) AS n_edges, 2.0 * coalesce(n_edges, 0) / n_nodes AS avg_degree_multi FROM n LEFT JOIN m USING (u)""")
def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transition_edges(spark, sf_dir)
    return G.component_sizes(G.weak_components(transition_nodes(spark, sf_dir), edges), edges)


@catalog.add(f"""
WITH RECURSIVE {EDGES}, p AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT node AS source, node, 0 AS hops FROM nodes WHERE node LIKE '%:view' UNION SELECT r.source, p.dst, r.hops + 1 FROM r JOIN p ON p.src = r.node WHERE r.hops < 5)
SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY source, node""")
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = transition_nodes(spark, sf_dir).where(F.col("node").endswith(":view"))
    return G.distances(transition_edges(spark, sf_dir), sources)


@catalog.add(f"""
WITH RECURSIVE {EDGES}, p AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT src, dst FROM p UNION SELECT r.src, p.dst FROM r JOIN p ON p.src = r.dst),
n AS (SELECT src AS node FROM p UNION SELECT dst FROM p), c AS (SELECT x.src AS node, min(x.dst) AS least FROM r x JOIN r y ON y.src = x.dst AND y.dst = x.src GROUP BY x.src)
SELECT n.node, coalesce(least(n.node, c.least), n.node) AS scc FROM n LEFT JOIN c ON c.node = n.node""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(transition_edges(spark, sf_dir))


@catalog.add(f"""
WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS node FROM u),
h AS (SELECT node AS s, node AS d, 0 AS k FROM n UNION SELECT h.s, u.dst, h.k + 1 FROM h JOIN u ON u.src = h.d WHERE h.k < 12),
m AS (SELECT s, d, min(k) AS k FROM h GROUP BY s, d), w AS (SELECT s AS node, min(d) AS component, max(k) AS far FROM m GROUP BY s),
x AS (SELECT component, count(*) AS n_nodes, max(far) AS diameter FROM w GROUP BY component),
y AS (SELECT component, count(*) AS n_edges, count(DISTINCT (src, dst)) AS simple FROM e JOIN w ON w.node = e.src GROUP BY component)
SELECT component, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(n_edges AS BIGINT) AS n_edges, 2.0 * simple / n_nodes AS avg_degree_simple, CAST(diameter AS BIGINT) AS diameter FROM x JOIN y USING (component)""")
def component_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.component_stats(transition_edges(spark, sf_dir))


@catalog.add(f"""
WITH {EDGES}, s AS (SELECT src, dst, action, string_split(action, ' | ') AS a, '__virt_' || substr(md5(src || '|' || dst || '|' || action), 1, 12) || '_' AS v FROM e), x AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM s)
SELECT CASE WHEN i = 1 THEN src ELSE v || (i - 1) END AS src, CASE WHEN i = len(a) THEN dst ELSE v || i END AS dst, a[i] AS action FROM x""")
def split_multi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.split_multi(transition_edges(spark, sf_dir)).select("src", "dst", "action")


@catalog.add()
def refined_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, merge to a fixpoint, collapse and prune."""
    short = G.shorter_wins(transition_edges(spark, sf_dir)).select("src", "dst", "action", "ord")
    merged = G.congruent(G.split_multi(short))
    return G.drop_redundant(G.collapse_virtual(merged)).select("src", "dst", "action")


SPLIT = f"""{EDGES}, s AS (SELECT src, dst, action, ord, string_split(action, ' | ') AS a, '__virt_' || substr(md5(src || '|' || dst || '|' || action), 1, 12) || '_' AS v FROM e), x AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM s),
p AS (SELECT CASE WHEN i = 1 THEN src ELSE v || (i - 1) END AS src, CASE WHEN i = len(a) THEN dst ELSE v || i END AS dst, a[i] AS action, ord FROM x)"""


@catalog.add(f"""
WITH RECURSIVE {SPLIT}, c AS (SELECT src, dst, action, ord, src AS f_src, dst AS f_dst, action AS f_action FROM p WHERE NOT starts_with(src, '__virt_')
  UNION ALL SELECT c.src, p.dst, c.action || ' | ' || p.action, c.ord, f_src, f_dst, f_action FROM c JOIN p ON p.src = c.dst WHERE starts_with(c.dst, '__virt_')),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(string_split(action, ' | ')), ord, f_src, f_dst, f_action) AS r FROM c WHERE NOT starts_with(dst, '__virt_'))
SELECT src, dst, action FROM r WHERE r = 1""")
def collapsed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges in single steps, put together again; of equal ends the shortest stays."""
    return G.collapse_virtual(G.split_multi(transition_edges(spark, sf_dir))).select("src", "dst", "action")


@catalog.add(f"""
WITH RECURSIVE {EDGES}, n AS (SELECT split_part(src, ':', 1) AS u, row_number() OVER (PARTITION BY split_part(src, ':', 1) ORDER BY ord, src, dst, action) AS n, src AS s, dst AS d, len(string_split(action, ' | ')) AS c, action FROM e),
g AS (SELECT u, 1 AS i, list({{'n': n, 's': s, 'd': d, 'c': c}} ORDER BY n) AS l, count(*) AS total FROM n GROUP BY u
  UNION ALL SELECT u, i + 1, CASE WHEN len(list_filter(rest, lambda x: x.s = now.s AND x.c <= now.c AND (x.d = now.d OR len(list_filter(rest, lambda y: y.s = x.d AND y.d = now.d AND x.c + y.c <= now.c)) > 0))) > 0 THEN rest ELSE l END, total
  FROM (SELECT u, i, l, total, list_filter(l, lambda x: x.n = i)[1] AS now, list_filter(l, lambda x: x.n <> i) AS rest FROM g WHERE i <= total)),
k AS (SELECT u, unnest(l) AS e FROM g WHERE i = total + 1)
SELECT s AS src, d AS dst, action FROM n JOIN k ON k.u = n.u AND k.e.n = n.n""")
def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that no other path replaces at no more actions, each judged after the earlier ones (an edge has two actions at most)."""
    return G.drop_redundant(transition_edges(spark, sf_dir)).select("src", "dst", "action")


@catalog.add(f"""
WITH {EDGES} SELECT CASE WHEN node LIKE '%:error' THEN '(empty)' ELSE split_part(node, ':', 2) END AS value, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY 1""")
def field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split("node", ":")[1]
    return G.group_by_field(transition_nodes(spark, sf_dir), F.when(kind == "error", "").otherwise(kind))


def _walks(most: int = 4) -> str:
    """Walks of 2 to 4 steps in SQL, a table for each step."""
    steps = [f"""w0 AS (SELECT walk, src AS here, [src] AS nodes, CAST([] AS VARCHAR[]) AS actions, 2 + CAST('0x' || substr(md5('42|goal|' || walk), 1, 8) AS BIGINT) % 3 AS goal, false AS ended
  FROM (SELECT src, row_number() OVER (ORDER BY md5('42|start|' || src), src) - 1 AS walk FROM (SELECT DISTINCT src FROM e)))"""]
    for i in range(most):
        now = f"(SELECT * FROM w{i} WHERE NOT ended AND len(actions) < goal)"
        steps.append(f"""c{i} AS (SELECT walk, min((md5('42|' || walk || '|' || len(actions) || '|' || dst || '|' || e.action), dst, e.action)) AS s FROM {now} l JOIN e ON e.src = l.here WHERE NOT list_contains(nodes, dst) GROUP BY walk)""")
        steps.append(f"""w{i + 1} AS (SELECT * FROM w{i} WHERE ended OR len(actions) >= goal
  UNION ALL SELECT l.walk, s[2], list_append(nodes, s[2]), list_append(actions, s[3]), goal, ended FROM {now} l JOIN c{i} USING (walk)
  UNION ALL SELECT walk, here, nodes, actions, goal, true FROM {now} l WHERE here IN (SELECT src FROM e) AND walk NOT IN (SELECT walk FROM c{i}))""")
    return ", ".join([EDGES, *steps, f"walks AS (SELECT CAST(min(walk) AS BIGINT) AS walk, nodes, actions FROM w{most} WHERE len(actions) >= 2 GROUP BY nodes, actions)"])


WALKS = _walks()


@catalog.add(f"WITH {WALKS} SELECT walk, array_to_string(nodes, ',') AS nodes, array_to_string(actions, ',') AS actions FROM walks")
def random_walk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk of 2 to 4 steps from each node with an edge."""
    return G.random_walks(transition_edges(spark, sf_dir), None, 2, 4).select("walk", F.array_join("nodes", ",").alias("nodes"), F.array_join("actions", ",").alias("actions"))


@catalog.add("""
WITH RECURSIVE w AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part), c AS (SELECT p_partkey // w AS x, p_partkey % w AS y FROM part, w WHERE p_size > 18),
r AS (SELECT x, y, x AS rx, y AS ry FROM c UNION SELECT c.x, c.y, r.rx, r.ry FROM r JOIN c ON abs(c.x - r.x) + abs(c.y - r.y) = 1)
SELECT x, y, min(rx || ',' || ry) AS region FROM r GROUP BY x, y""")
def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in rows of a square as wide as the table needs; the small ones are walls."""
    parts = table(spark, sf_dir, "part")
    width = math.isqrt(max(parts.count(), 1) - 1) + 1
    return G.grid_regions(parts.where("p_size > 18").selectExpr(f"p_partkey div {width} AS x", f"p_partkey % {width} AS y"))
