"""Supervised records, checks and neighbourhoods on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import graph as G
from trailframe.operators import sft
from trailframe.plans.catalog import EVENTS, Catalog, events, r6, table
from trailframe.plans.graphs import WALKS, transition_edges
from trailframe.storage import shared_dir

catalog = Catalog()


@catalog.add("""
SELECT conv_id, turn, turn % 2 = 0 OR turn % 3 = 0 AS ok, CASE WHEN turn % 2 = 0 THEN '' WHEN turn % 3 = 0 THEN 'repaired' ELSE 'missing turn' END AS reason FROM conversations""")
def turn_checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("turn") % 2 == 0, '<turn index="1"><observation>o</observation> t <action>go</action></turn>').when(F.col("turn") % 3 == 0, "x <observation>o</observation> <action>stop</action>").otherwise("<action>go</action>")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", sft.checked_turns(body, F.array(F.lit("go"))).alias("c"))
    return rows.select("conv_id", "turn", F.col("c")[0]["ok"].alias("ok"), F.col("c")[0]["reason"].alias("reason"))


@catalog.add("""
SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 200""")
def overlong_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.short_enough(table(spark, sf_dir, "documents"), "text", 200).select("doc_id")


@catalog.add("""
SELECT event_id FROM events WHERE event_type IN ('view', 'click')""")
def clean_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.clean_episodes(table(spark, sf_dir, "events"), "event_type", ["view", "click"]).select("event_id")


@catalog.add("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, 128 + 400 * CAST(x AS DOUBLE))) AS DOUBLE)) AS p FROM embeddings)
SELECT vec_id, list_stddev_pop(p) >= 10 AND len(list_filter(p, lambda x: abs(x - 255) <= 5)) / len(p) <= 0.7 AS passes FROM p""")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 400 * x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", sft.image_passes(gray).alias("passes"))


@catalog.add("""
SELECT a.user_id, a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.value - b.value) <= 0.25""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.tolerance_neighbours(table(spark, sf_dir, "events"), "user_id", "event_id", ["value"], 0.25)


@catalog.add("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|ring|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n, CAST('0x' || substr(md5('42|slot|' || doc_id), 1, 8) AS BIGINT) % 4 AS slot FROM documents),
w AS (SELECT a.source, a.doc_id, a.slot, list(CAST(b.doc_id AS VARCHAR) ORDER BY s.i) AS w FROM r a, (SELECT unnest(range(1, 4)) AS i) s, r b WHERE a.n > 3 AND b.source = a.source AND b.r = (a.r - 1 + s.i) % a.n + 1 GROUP BY ALL)
SELECT source, doc_id, array_to_string(list_concat(list_concat(w[1:slot], [CAST(doc_id AS VARCHAR)]), w[slot + 1:]), ',') AS options, substr('ABCD', CAST(slot + 1 AS INTEGER), 1) AS letter FROM w""")
def view_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sft.view_questions(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return out.withColumn("options", F.array_join("options", ","))


@catalog.add("""
SELECT conv_id, turn, CASE WHEN CAST('0x' || substr(md5('42|kind|' || conv_id || '|' || turn), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 THEN 'mcq' ELSE 'free' END AS kind,
  ['a', 'b', 'c'][CAST('0x' || substr(md5('42|gen|' || conv_id), 1, 8) AS BIGINT) % 3 + 1] AS prompt FROM conversations""")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sft.question_kind("conv_id", "turn", 0.3).alias("kind"), sft.prompt_choice(["a", "b", "c"], "gen", "conv_id").alias("prompt"))


@catalog.add(f"""
WITH {EVENTS} SELECT user_id, CAST(2 + 2 * count(*) AS INTEGER) AS n_messages, arg_max(event_type, event_id) AS answer, sha256('sys' || string_agg('|' || event_type || '|<action>' || action || '</action>', '' ORDER BY event_id) || '|<action>answer(' || arg_max(event_type, event_id) || ')</action>') AS digest FROM ev GROUP BY user_id""")
def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sft.turn_records(events(spark, sf_dir), "user_id", "event_id", "event_type", "action", "sys", "event_type")
    text = F.array_join(F.transform("messages", lambda m: m["content"]), "|")
    answer = F.regexp_extract(F.element_at("messages", -1)["content"], r"answer\((.*)\)", 1)
    return out.select("user_id", F.size("messages").alias("n_messages"), answer.alias("answer"), F.sha2(text.cast("binary"), 256).alias("digest"))


@catalog.add("""
WITH i AS (SELECT conv_id, turn, role, turn % 2 = 0 OR conv_id % 3 = 0 AS better FROM conversations WHERE conv_id % 4 <> 1 UNION ALL SELECT conv_id, turn, role, false FROM conversations WHERE conv_id % 4 = 1)
SELECT conv_id, array_to_string(list(CASE WHEN better THEN 'new' ELSE role END ORDER BY turn), ',') AS texts, CASE WHEN bool_and(better) THEN 'full' WHEN bool_or(better) THEN 'partial' ELSE 'dropped' END AS cls FROM i GROUP BY conv_id""")
def merged_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    better = rows.where("conv_id % 4 <> 1 AND (turn % 2 = 0 OR conv_id % 3 = 0)").withColumn("role", F.lit("new"))
    return sft.merged_reasoning(rows, better, "conv_id", "turn", "role").withColumn("texts", F.array_join("texts", ","))


@catalog.add(f"WITH {WALKS} SELECT walk, 'From ' || nodes[1] || ' reach ' || nodes[-1] || '.' AS prompt, array_to_string(actions, ' | ') AS answer FROM walks")
def action_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.action_records(G.random_walks(transition_edges(spark, sf_dir), None, 2, 4))


@catalog.add("""
WITH RECURSIVE c AS (SELECT DISTINCT CAST(p_partkey // 400 AS VARCHAR) AS room, p_partkey % 400 // 20 AS x, p_partkey % 20 AS y FROM part WHERE p_size > 12),
r(room, x, y, heading, moves) USING KEY (room, x, y, heading) AS (SELECT room, x, y, 0, 0 FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY x, y) AS i FROM c) WHERE i = 1
  UNION SELECT n.* FROM (SELECT r.room, r.x + [1, 0, -1, 0][heading + 1] AS x, r.y + [0, 1, 0, -1][heading + 1] AS y, heading, moves + 1 AS moves FROM r
      UNION SELECT room, x, y, (heading + d) % 4, moves + 1 FROM r, (VALUES (1), (3)) v(d)) n
    JOIN c ON c.room = n.room AND c.x = n.x AND c.y = n.y LEFT JOIN recurring.r o ON o.room = n.room AND o.x = n.x AND o.y = n.y AND o.heading = n.heading WHERE o.room IS NULL)
SELECT room, x, y, CAST(heading AS INTEGER) AS heading, CAST(moves AS INTEGER) AS moves FROM r""")
def room_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 400 parts are a room of 20 by 20 cells; the small ones are walls."""
    cells = table(spark, sf_dir, "part").where("p_size > 12").selectExpr("p_partkey div 400 AS room", "p_partkey % 400 div 20 AS x", "p_partkey % 20 AS y")
    return sft.room_distances(cells, "room")


@catalog.add(f"""
WITH {EVENTS}, p AS (SELECT user_id, event_id AS item, value AS x, k AS y, k % 4 AS f, CASE WHEN k % 10 > 0 THEN value + (k % 3) END AS gx, CASE WHEN k % 10 > 0 THEN k + 1 END AS gy, k % 2 AS gf FROM ev),
q AS (SELECT user_id, item, x, y, gx, gy FROM p UNION ALL SELECT DISTINCT user_id, NULL, 0, 0, 0, 0 FROM p),
d AS (SELECT a.user_id, avg(coalesce(CAST(floor((((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360) + 22.5) / 45) AS BIGINT) % 8 = CAST(floor((((degrees(atan2(b.gx - a.gx, b.gy - a.gy)) + 360) % 360) + 22.5) / 45) AS BIGINT) % 8, false)::INT) AS direction
  FROM q a JOIN q b ON a.user_id = b.user_id AND (a.item < b.item OR (a.item IS NOT NULL AND b.item IS NULL)) GROUP BY 1),
g AS (SELECT user_id, avg(coalesce(f = gf, false)::INT) AS facing, coalesce(exp(-sqrt(avg(pow(x - gx, 2) + pow(y - gy, 2))) / nullif(sqrt(avg(x * x + y * y) FILTER (WHERE gy IS NOT NULL)), 0)) * count(gy) / count(*), 0) AS position FROM p GROUP BY 1)
SELECT user_id, round(direction, 6) + 0.0 AS direction, round(facing, 6) + 0.0 AS facing, round(position, 6) + 0.0 AS position, round((direction + facing + position) / 3, 6) + 0.0 AS overall FROM d JOIN g USING (user_id)""")
def map_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("item"), F.col("value").alias("x"), k.alias("y"), (k % 4).alias("facing"), F.when(k % 10 > 0, F.col("value") + k % 3).alias("gx"), F.when(k % 10 > 0, k + 1).alias("gy"), (k % 2).alias("gfacing"))
    return sft.map_similarity(rows, "user_id").select("user_id", *(r6(c).alias(c) for c in ("direction", "facing", "position", "overall")))


@catalog.add("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 THEN 'late' WHEN l_linenumber >= 3 THEN 'mid' ELSE 'early' END AS region FROM lineitem""")
def span_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sft.region_of(F.col("l_linenumber"), [(0, "early"), (3, "mid"), (5, "late")]).alias("region"))


@catalog.add("""
SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def align_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), "o_custkey")
    out = sft.aligned_by_uid(batch, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_linenumber"), "uid")
    return out.select(F.col("uid").alias("l_orderkey"), "l_linenumber", "o_custkey")


@catalog.add("""
SELECT user_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) % 4 AS traj_idx, event_id FROM events""")
def traj_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailframe.operators.batch import numbered

    return numbered(table(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"]).select("user_id", (F.col("row_no") % 4).alias("traj_idx"), "event_id")


@catalog.add("""
WITH k AS (SELECT user_id, event_id, greatest(-10, least(10, exp(-d) + d - 1)) AS k3 FROM (SELECT *, (value - 20) / 50 AS d FROM events)), r AS (SELECT e.user_id, e.event_id, e.value - 0.1 * k3 AS reward, k3 FROM events e JOIN k USING (event_id))
SELECT user_id, round(sum(reward), 6) + 0.0 AS reward, round(avg(k3), 6) + 0.0 AS kl FROM r GROUP BY user_id""")
def kl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailframe.operators.advantages import kl_estimates

    k3 = kl_estimates((F.col("value") - 20) / 50, F.lit(0.0))["k3"]
    rows = table(spark, sf_dir, "events").withColumn("k3", k3).withColumn("reward", F.col("value") - 0.1 * F.col("k3"))
    return rows.groupBy("user_id").agg(r6(F.sum("reward")).alias("reward"), r6(F.avg("k3")).alias("kl"))


@catalog.add("""
WITH t AS (SELECT 'documents' AS tag, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark) SELECT tag, id, length(text) AS n FROM t""".replace("length(text) AS n", "CAST(length(text) AS INTEGER) AS n"))
def tagged_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("tag"), F.col(key).cast("string").alias("id"), F.length("text").alias("n"))
    return one("documents", "doc_id").unionByName(one("benchmark", "item_id"))


@catalog.add("""
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), c AS (SELECT unnest(range(1, 5)) AS copy)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(copy AS INTEGER) AS copy FROM o, c WHERE copy <= 1 + event_id % 4""")
def literal_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (1 + F.col("event_id") % 4).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), n)).alias("copy"))


_HEX = "CAST('0x' || substr(md5('42|{}|' || {}), 1, 8) AS BIGINT)"
_WRONG = "list_filter(['k0', 'k1', 'k2', 'k3'], lambda x: x <> split_part(action, ' | ', 1))"


@catalog.add(f"""
WITH {EVENTS}, w AS (SELECT *, split_part(action, ' | ', 1) AS a, CASE WHEN k % 7 = 0 THEN [] ELSE {_WRONG} END AS wrong FROM ev),
q AS (SELECT *, len(wrong) > 0 AND {_HEX.format('kind', "user_id || '|' || event_id")} / 4294967296.0 < 0.4 AS mcq, {_HEX.format('slot', "user_id || '|' || event_id")} % (len(wrong) + 1) AS slot FROM w),
o AS (SELECT *, wrong[:slot] || [a] || wrong[slot + 1:] AS options FROM q),
m AS (SELECT *, event_type || CASE WHEN mcq THEN chr(10) || array_to_string(list_transform(range(1, len(options) + 1), lambda i: substr('ABCD', i, 1) || '. ' || options[i]), chr(10)) ELSE '' END AS asked,
  '<action>' || CASE WHEN mcq THEN substr('ABCD', CAST(slot + 1 AS INTEGER), 1) ELSE a END || '</action>' AS said FROM o)
SELECT user_id, CAST(sum(CAST(mcq AS INTEGER)) AS BIGINT) AS n_mcq, CAST(2 + 2 * count(*) AS INTEGER) AS n_messages, sha256('sys|' || string_agg(asked || '|' || said, '|' ORDER BY event_id) || '|<action>answer(' || arg_max(event_type, event_id) || ')</action>') AS digest FROM m GROUP BY user_id""")
def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as turns, of the first action and its alternatives; some turns have no alternatives."""
    first = F.split("action", r" \| ")[0]
    others = F.filter(F.array(*(F.lit(f"k{i}") for i in range(4))), lambda x: x != F.col("a"))
    steps = events(spark, sf_dir).withColumn("a", first).withColumn("wrong", F.when(F.col("k") % 7 != 0, others).otherwise(F.array().cast("array<string>")))
    out = sft.mixed_records(steps, "user_id", "event_id", "event_type", "a", "wrong", "sys", "event_type", 0.4)
    text = F.array_join(F.transform("messages", lambda m: m["content"]), "|")
    return out.select("user_id", F.size(F.array_remove("kinds", "free")).cast("long").alias("n_mcq"), F.size("messages").alias("n_messages"), F.sha2(text.cast("binary"), 256).alias("digest"))


@catalog.add("""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n, CAST(conv_id % 7 AS DOUBLE) / 6 AS reward FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND conv_id % 7 >= 3""")
def reward_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations by reward and length, in two rounds that overlap, appended to one output."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    scored = rows.withColumn("reward", F.pmod(F.col("conv_id"), F.lit(7)).cast("double") / 6)
    path = shared_dir(spark, "kept")
    for part in ("conv_id % 3 < 2", "conv_id % 3 > 0"):
        sft.append_new(sft.reward_filtered(scored.where(part), "messages", "reward"), path, ["conv_id"])
    return spark.read.schema(scored.schema).parquet(path).select("conv_id", F.size("messages").alias("n"), "reward")
