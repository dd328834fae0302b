"""Rollout operators on the driver's tables: advantages, batches, reports, seeds, records of text states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import rollouts as R
from trailframe.operators import sampling as S
from trailframe.plans.catalog import EVENTS, Catalog, events, table

catalog = Catalog()


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens: a user's sequence by event id, error events masked."""
    on = F.col("event_type") != "error"
    return events(spark, sf_dir).select("user_id", "event_id", (F.col("value") / 7).alias("r"), (F.col("k") / 100.0).alias("v"), on.cast("int").alias("m"), on.alias("on"), ((F.col("k") - 50) / 400.0).alias("lr"))


_TOKENS = f"{EVENTS}, t AS (SELECT user_id, event_id, value / 7 AS r, k / 100.0 AS v, (event_type <> 'error')::INT AS m, (k - 50) / 400.0 AS lr, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM ev)"
_WHITE = "w AS (SELECT sum(a) FILTER (WHERE m = 1) / (count(*) FILTER (WHERE m = 1) + 1e-8) AS mean, var_samp(a) FILTER (WHERE m = 1) AS var FROM g)"


@catalog.add(f"""
WITH RECURSIVE {_TOKENS}, g AS (SELECT user_id, event_id, i, m, CAST(r AS DOUBLE) AS a FROM t WHERE i = 1
  UNION ALL SELECT t.user_id, t.event_id, t.i, t.m, t.r + 0.9 * g.a * g.m FROM g JOIN t ON t.user_id = g.user_id AND t.i = g.i + 1), {_WHITE}
SELECT user_id, event_id, round(a, 4) + 0.0 AS returns, round((a - mean) / sqrt(var + 1e-8) * m, 4) + 0.0 AS adv FROM g, w""")
def reinforce_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.reinforce_plus_plus(_tokens(spark, sf_dir), "user_id", "event_id", "r", "m", 0.9)
    return out.select("user_id", "event_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("returns", "adv")))


@catalog.add(f"""
WITH RECURSIVE {_TOKENS}, g AS (SELECT user_id, event_id, i, m, v, CASE WHEN m = 1 THEN r - v ELSE 0 END AS a, CASE WHEN m = 1 THEN CAST(v AS DOUBLE) ELSE 0 END AS nv FROM t WHERE i = 1
  UNION ALL SELECT t.user_id, t.event_id, t.i, t.m, t.v, CASE WHEN t.m = 1 THEN t.r + 0.9 * g.nv - t.v + 0.72 * g.a ELSE g.a END, CASE WHEN t.m = 1 THEN t.v ELSE g.nv END FROM g JOIN t ON t.user_id = g.user_id AND t.i = g.i + 1), {_WHITE}
SELECT user_id, event_id, round((a - mean) / sqrt(var + 1e-8), 4) + 0.0 AS adv, round(a + v, 4) + 0.0 AS returns FROM g, w""")
def gae_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.gae_whitened(_tokens(spark, sf_dir), "user_id", "event_id", "r", "v", "m", 0.9, 0.8)
    return out.select("user_id", "event_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("adv", "returns")))


@catalog.add("""
WITH e AS (SELECT *, event_id // 100 AS b, (value > 50)::INT AS x FROM events), g AS (SELECT b, user_id FROM e GROUP BY 1, 2 HAVING stddev_pop(x) > 0 OR count(*) = 1),
c AS (SELECT b, sum(n) OVER (ORDER BY b) AS n FROM (SELECT b, count(*) AS n FROM g GROUP BY 1)), l AS (SELECT min(b) AS l FROM c WHERE n >= 60),
r AS (SELECT e.b, e.user_id, event_id, row_number() OVER (ORDER BY e.b, event_id) - 1 AS place FROM e JOIN g ON e.b = g.b AND e.user_id = g.user_id, l WHERE e.b <= l)
SELECT b, user_id, event_id, CAST(place AS BIGINT) AS place FROM r WHERE place < 120""")
def filled_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty groups of two rows are the operator's batch size."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("b"), "user_id", "event_id", (F.col("value") > 50).cast("int").alias("x"))
    return R.filled_batch(rows, "b", "user_id", "event_id", "x", 60, 2).select("b", "user_id", "event_id", "place")


@catalog.add(f"""
WITH {_TOKENS}, s AS (SELECT user_id, coalesce(sum(lr) FILTER (WHERE m = 1), 0) AS s, count(*) FILTER (WHERE m = 1) AS c FROM t GROUP BY 1),
l AS (SELECT unnest(['token', 'sequence', 'geometric']) AS level),
x AS (SELECT level, user_id, m, CASE level WHEN 'token' THEN lr WHEN 'sequence' THEN s ELSE s / (c + 1e-8) END AS x FROM t JOIN s USING (user_id), l),
w AS (SELECT *, exp(greatest(-20, least(20, x))) AS w FROM x), b AS (SELECT *, greatest(1 / 1.1, least(1.1, w)) AS b, (w < 1 / 1.1 OR w > 1.1)::INT AS o FROM w),
p AS (SELECT level, user_id, sum(m) AS n, sum(w * m) AS w, sum(b * m) AS b, sum(b * b * m) AS bb, sum(o * m) AS o, max(o) AS ao, sum((w > 1.1)::INT * m) AS hi, sum((w < 1 / 1.1)::INT * m) AS lo, max(w) FILTER (WHERE m = 1) AS top, min(w) FILTER (WHERE m = 1) AS bot, max(x) AS x, sum(w * m) / (sum(m) + 1e-8) AS mm FROM b GROUP BY 1, 2),
a AS (SELECT level, CASE WHEN level = 'token' THEN sum(hi) / (sum(n) + 1e-8) ELSE avg((x > ln(1.1))::INT) END AS fraction_high, CASE WHEN level = 'token' THEN sum(lo) / (sum(n) + 1e-8) ELSE avg((x < ln(1 / 1.1))::INT) END AS fraction_low,
  CASE WHEN level = 'token' THEN max(top) ELSE exp(least(20, max(x))) END AS max, CASE WHEN level = 'token' THEN min(bot) ELSE exp(min(x)) END AS min, CASE WHEN level = 'token' THEN avg((o > 0)::INT) ELSE avg(ao) END AS seq_masked_fraction,
  sum(o) / (sum(n) + 1e-8) AS masked_fraction, sum(w) / (sum(n) + 1e-8) AS mean, sum(b) / (sum(n) + 1e-8) AS mb, sum(bb) / (sum(n) + 1e-8) AS sq, avg(mm) AS seq_mean, stddev_samp(mm) AS seq_std, max(mm) AS seq_max, min(mm) AS seq_min, max(abs(mm - 1)) AS seq_max_deviation,
  avg((mm > 1.1)::INT) AS seq_fraction_high, avg((mm < 1 / 1.1)::INT) AS seq_fraction_low FROM p GROUP BY level)
SELECT level, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("fraction_high", "fraction_low", "max", "min", "seq_masked_fraction", "masked_fraction", "mean", "seq_mean", "seq_std", "seq_max", "seq_min", "seq_max_deviation", "seq_fraction_high", "seq_fraction_low"))},
  round(sqrt(greatest(0, sq - mb * mb)), 5) + 0.0 AS std, round(1 / (sq / pow(mb + 1e-8, 2)), 5) + 0.0 AS ess FROM a""")
def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir)
    token, sequence, geometric = (R.rejection_report(rows, "user_id", "lr", "on", 1.1, level=x) for x in ("token", "sequence", "geometric"))
    out = token.union(sequence).union(geometric)
    return out.select("level", *((F.round(c, 5) + 0.0).alias(c) for c in out.columns if c != "level"))


@catalog.add(f"""
WITH {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN k % 3 = 0 THEN k > 50 WHEN k % 3 = 1 THEN k > 30 END AS s FROM ev)
SELECT user_id, CAST(i AS INTEGER) AS turn, value AS reward, coalesce(s, false) AS success FROM o
UNION ALL SELECT user_id, 0, NULL, CASE WHEN user_id % 2 = 0 THEN false ELSE coalesce(s, false) END FROM o WHERE i = 1""")
def per_turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even users have an info of the reset before those of their steps."""
    k = F.col("k")
    info = F.struct(F.when(k % 3 == 0, k > 50).alias("success"), F.when(k % 3 == 1, k > 30).alias("is_success"))
    got = F.sort_array(F.collect_list(F.struct("event_id", "value", info.alias("info"))))
    rows = events(spark, sf_dir).groupBy("user_id").agg(got.alias("s")).select("user_id", F.transform("s", lambda x: x["value"]).alias("rewards"), F.transform("s", lambda x: x["info"]).alias("infos"))
    reset = F.array(F.struct(F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("boolean").alias("is_success")))
    rows = rows.withColumn("infos", F.when(F.col("user_id") % 2 == 0, F.concat(reset, "infos")).otherwise(F.col("infos")))
    return R.per_turn_rows(rows, "user_id", "rewards", "infos", ["success", "is_success"])


@catalog.add(f"""
WITH {EVENTS}, g AS (SELECT user_id, CASE WHEN min(k) > 3 THEN min(k) END AS own, arg_max(CASE WHEN k % 2 = 0 THEN k END, event_id) FILTER (WHERE true) AS x, list(CASE WHEN k % 2 = 0 THEN k END ORDER BY event_id) AS infos FROM ev GROUP BY 1)
SELECT user_id, CAST(coalesce(own, infos[-1], infos[1], c_nationkey) AS INTEGER) AS score FROM g LEFT JOIN customer ON user_id = c_custkey""")
def field_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    infos = F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.when(k % 2 == 0, k).alias("score")))), lambda x: F.struct(x["score"].alias("score")))
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.when(F.min("k") > 3, F.min("k")).alias("score"), infos.alias("infos"))
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("int").alias("score"))
    return R.with_fallbacks(rows, "score", "infos", meta, "user_id").select("user_id", F.col("score").cast("int").alias("score"))


_U = "CAST('0x' || substr(md5('42|{}|' || {}), 1, 8) AS BIGINT) / 4294967296.0"


@catalog.add(f"""
WITH p AS (SELECT 's' || s_suppkey AS name, s_suppkey % 5 + 1 AS n, s_suppkey % 4 AS kind, s_suppkey AS k FROM supplier), r AS (SELECT *, unnest(range(0, n)) AS place FROM p),
c AS (SELECT name, n, v AS value, row_number() OVER (PARTITION BY name ORDER BY md5('42|seed|' || name || '|' || v || '|' || copy), v, copy) - 1 AS place FROM p, (SELECT unnest(range(10, 13)) AS v) a, (SELECT unnest(range(1, 3)) AS copy) b WHERE kind = 2)
SELECT name, place, CASE kind WHEN 0 THEN CAST(floor({_U.format('seed', "name || '|' || place")} * 2147483648) AS BIGINT) WHEN 1 THEN CAST(5 + floor({_U.format('seed', "name || '|' || place")} * 16) AS BIGINT) ELSE [k, 2 * k, 3 * k, 7, 9][place + 1] END AS value FROM r WHERE kind <> 2
UNION ALL SELECT name, place, value FROM c WHERE place < n""")
def spec_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec for each supplier: any number, a range, a range with each number twice at most, or a list."""
    k = F.col("s_suppkey").cast("long")
    kind = k % 4
    rule = F.when(kind == 0, F.array().cast("array<bigint>")).when(kind == 1, F.array(F.lit(5), F.lit(20)).cast("array<bigint>")).otherwise(F.array(F.lit(10), F.lit(12), F.lit(2)).cast("array<bigint>"))
    listed = F.array(k, 2 * k, 3 * k, F.lit(7).cast("long"), F.lit(9).cast("long"))
    specs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), (k % 5 + 1).alias("n"), rule.alias("rule"), F.when(kind == 3, listed).alias("seeds"))
    return R.seed_rows(specs).select("name", "place", "value")


@catalog.add(f"""
WITH t AS (SELECT o_orderkey AS k, o_custkey % 9 AS n, ['turn_left', 'move_forward', 'answer(1)'][o_orderkey % 3 + 1] AS a, ['x', 'y', 'z', 'x'] AS o FROM orders),
d AS (SELECT *, 1 + floor({_U.format('delta', 'k')} * 4) AS delta, {_U.format('sign', 'k')} < 0.5 AS down, list_filter(o, lambda x: x <> ['x', 'y', 'w'][k % 3 + 1]) AS rest FROM t),
f AS (SELECT *, CASE WHEN down THEN greatest(0, n - delta) ELSE n + delta END AS f FROM d)
SELECT k AS o_orderkey, CASE a WHEN 'turn_left' THEN 'turn_right' WHEN 'move_forward' THEN 'move_backward' END AS opposite, rest[CAST(floor({_U.format('option', 'k')} * len(rest)) AS INTEGER) + 1] AS other, CAST(CASE WHEN f = n THEN n + 1 ELSE f END AS BIGINT) AS near FROM f""")
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % 3).cast("int"))
    number = R.near_number(F.col("o_custkey") % 9, "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.opposite_action(pick("turn_left", "move_forward", "answer(1)")).alias("opposite"), R.other_option(pick("x", "y", "w"), F.array(*map(F.lit, "xyzx")), "o_orderkey").alias("other"), number.alias("near"))


def _state_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's trajectory as text states and the actions between them."""
    state = F.concat_ws(":", "event_type", (F.col("k") % 20).cast("string"))
    got = F.sort_array(F.collect_list(F.struct("ts", "event_id", state.alias("s"), "action")))
    rows = events(spark, sf_dir).groupBy(F.col("user_id").alias("path")).agg(got.alias("g"))
    return rows.select("path", F.transform("g", lambda x: x["s"]).alias("nodes"), F.transform(F.slice("g", F.lit(1), F.greatest(F.lit(0), F.size("g") - 1)), lambda x: x["action"]).alias("actions"))


_PATHS = f"""{EVENTS}, s AS (SELECT user_id, ts, event_id, event_type || ':' || (k % 20) AS s, action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lead(event_type || ':' || (k % 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev),
p AS (SELECT user_id AS path, list(s ORDER BY i) AS nodes, list(action ORDER BY i) FILTER (WHERE nxt IS NOT NULL) AS actions FROM s GROUP BY 1)"""


def _digests(records: DataFrame, kind: str) -> DataFrame:
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n")
    return records.select(F.lit(kind).alias("kind"), "path", F.size("messages").alias("n_messages"), F.sha2(text.cast("binary"), 256).alias("digest"))


@catalog.add(f"""
WITH {_PATHS}, e AS (SELECT event_id AS path, s, nxt, action FROM s WHERE nxt IS NOT NULL),
r AS (SELECT path, nodes[1] AS a, nodes[-1] AS b, nodes, coalesce(actions, []) AS actions FROM p),
ring AS (SELECT node, row_number() OVER (ORDER BY md5('42|ring|' || node), node) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT s AS node FROM s)),
o AS (SELECT path, list(node ORDER BY j)[1:3] AS o FROM (SELECT path, a, b, j, (CAST(floor({_U.format('start', 'path')} * (SELECT max(n) FROM ring)) AS BIGINT) + j) % (SELECT max(n) FROM ring) AS pos FROM r, (SELECT unnest(range(0, 5)) AS j)) JOIN ring USING (pos) WHERE node <> a AND node <> b GROUP BY path HAVING count(*) >= 3),
c AS (SELECT r.*, o, CAST(floor({_U.format('slot', 'r.path')} * 4) AS INTEGER) AS slot FROM r JOIN o USING (path)), q AS (SELECT *, list_concat(list_concat(o[1:slot], [b]), o[slot + 1:3]) AS opts FROM c),
x AS (SELECT 'forward' AS kind, path, 3 AS n_messages, 'system|S' || chr(10) || 'user|Current state:' || chr(10) || a || chr(10) || chr(10) || 'Action sequence: ' || array_to_string(actions, ' | ') || chr(10) || 'assistant|<prediction>' || chr(10) || b || chr(10) || '</prediction>' AS t FROM r
UNION ALL SELECT 'inverse', path, 3, 'system|S' || chr(10) || 'user|Initial state:' || chr(10) || s || chr(10) || chr(10) || 'Resulting state:' || chr(10) || nxt || chr(10) || 'assistant|' || action FROM e
UNION ALL SELECT 'choice', path, 3, 'system|S' || chr(10) || 'user|Current state:' || chr(10) || a || chr(10) || chr(10) || 'Action sequence: ' || array_to_string(actions, ' | ') || chr(10) || chr(10) || 'Which of the following is the correct resulting state?' || chr(10) || chr(10) ||
  'A)' || chr(10) || opts[1] || chr(10) || chr(10) || 'B)' || chr(10) || opts[2] || chr(10) || chr(10) || 'C)' || chr(10) || opts[3] || chr(10) || chr(10) || 'D)' || chr(10) || opts[4] || chr(10) || 'assistant|' || substr('ABCD', slot + 1, 1) FROM q
UNION ALL SELECT 'reach', path, CASE WHEN len(actions) = 0 THEN 2 ELSE 1 + 2 * len(actions) END, 'system|S' || chr(10) || 'user|Initial state:' || chr(10) || a || chr(10) || chr(10) || 'Goal state:' || chr(10) || b || chr(10) || chr(10) || 'Current state:' || chr(10) || a || chr(10) || chr(10) || 'Decide your next action(s).' ||
  array_to_string(list_transform(range(1, len(actions) + 1), lambda i: chr(10) || 'assistant|' || actions[i] || CASE WHEN i < len(actions) THEN chr(10) || 'user|After action ''' || actions[i] || ''', current state:' || chr(10) || nodes[i + 1] || chr(10) || chr(10) || 'Decide your next action(s).' ELSE '' END), '') FROM r)
SELECT kind, path, CAST(n_messages AS INTEGER) AS n_messages, sha256(t) AS digest FROM x""")
def text_state_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of records over text states: forward, choice, inverse, reach."""
    paths, system = _state_paths(spark, sf_dir), F.lit("S")
    steps = events(spark, sf_dir).withColumn("path", F.col("event_id"))
    from pyspark.sql import Window

    state = F.concat_ws(":", "event_type", (F.col("k") % 20).cast("string"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = steps.select("path", state.alias("src"), F.lead(state).over(order).alias("dst"), "action").where("dst IS NOT NULL")
    nodes = steps.select(state.alias("node"))
    parts = [("forward", R.forward_records(paths, system)), ("choice", R.choice_records(paths, nodes, system)), ("inverse", R.inverse_records(edges, system)), ("reach", R.reach_records(paths, system))]
    out = [_digests(p, kind) for kind, p in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@catalog.add("""
SELECT 'searchR1_' || coalesce(CAST(item_id % 3 AS VARCHAR), '') AS data_source, 'Answer: ' || coalesce(text, '') AS user_content, sha256(coalesce(text, '')) AS question, CAST(item_id AS BIGINT) AS "index", 'train' AS split, CAST(item_id + 1 AS BIGINT) AS truth FROM benchmark""")
def search_task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text", (F.col("item_id") + 1).cast("long").alias("truth"), (F.col("item_id") % 3).alias("src"))
    out = R.search_rows(rows, "text", "truth", "src", "id", "train", "You search.", "Answer: \n", "searchR1_")
    kwargs = F.col("extra_info.tools_kwargs.search.create_kwargs")
    return out.select("data_source", F.col("prompt")[1]["content"].alias("user_content"), F.sha2(kwargs["question"].cast("binary"), 256).alias("question"), "extra_info.index", "extra_info.split", kwargs["ground_truth"].alias("truth"))


@catalog.add("""
WITH m AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'system' WHEN 1 THEN 'human' WHEN 2 THEN 'gpt' WHEN 3 THEN 'function_call' WHEN 4 THEN 'observation' ELSE 'narrator' END AS f, turn % 2 = 1 AND conv_id % 3 = 0 AS bad FROM conversations),
k AS (SELECT *, f = 'function_call' AS call FROM m WHERE f <> 'narrator' AND NOT (f = 'function_call' AND bad))
SELECT m.conv_id, coalesce(array_to_string(list(CASE k.f WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'function_call' THEN 'assistant' WHEN 'observation' THEN 'tool' ELSE 'system' END ORDER BY k.turn) FILTER (WHERE k.f IS NOT NULL), ','), '') AS roles,
  CAST(coalesce(sum(CASE WHEN k.call THEN CASE WHEN m.conv_id % 3 = 1 THEN 2 ELSE 1 END ELSE 1 END) FILTER (WHERE k.f IS NOT NULL), 0) AS BIGINT) AS parts, CAST(count(*) FILTER (WHERE k.f IN ('gpt', 'function_call')) AS DOUBLE) AS weight
FROM m LEFT JOIN k ON m.conv_id = k.conv_id AND m.turn = k.turn GROUP BY 1""")
def sharegpt_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of every third conversation aren't JSON, those of another third are lists of two."""
    who = F.get(F.array(*map(F.lit, ("system", "human", "gpt", "function_call", "observation", "narrator"))), (F.col("turn") % 6).cast("int"))
    c = F.col("conv_id") % 3
    call = F.when(c == 0, "{bad").when(c == 1, '[{"a": 1}, {"b": 2}]').otherwise('{"a": 1}')
    got = F.sort_array(F.collect_list(F.struct("turn", who.alias("from"), F.when(who == "function_call", call).otherwise(F.col("text")).alias("value"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(got.alias("c")).select("conv_id", R.sharegpt_strict(F.col("c")).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.size(x["content"])).alias("parts"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x["loss_weight"]).alias("weight"))


@catalog.add("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, role, sha256(text) AS text FROM conversations""")
def batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to lists and back."""
    lists = R.to_columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"])
    return R.to_rows(lists, "conv_id", ["role", "text"]).select("conv_id", "place", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text"))


@catalog.add(f"""
WITH {EVENTS}, n AS (SELECT event_id, 'e' || event_id AS node, event_type || ':' || (k % 50) AS content, event_id % 2 AS t FROM ev), k AS (SELECT content, arg_min(node, t || '|' || node) AS key FROM n GROUP BY 1),
e AS (SELECT a.content AS ca, b.content AS cb, 'a' || (a.event_id % 5) AS action FROM n a JOIN n b ON b.event_id = a.event_id + 2)
SELECT DISTINCT x.key AS src, y.key AS dst, action FROM e JOIN k x ON x.content = ca JOIN k y ON y.content = cb WHERE x.key <> y.key""")
def graph_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of even and odd events, merged by their nodes' content."""
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    rows = events(spark, sf_dir).select("event_id", name(F.col("event_id")).alias("node"), F.concat_ws(":", "event_type", (F.col("k") % 50).cast("string")).alias("content"))
    part = lambda t: rows.where(F.col("event_id") % 2 == t)
    edges = lambda t: part(t).select(F.col("node").alias("src"), name(F.col("event_id") + 2).alias("dst"), F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("action"))
    return R.merged_by_content(part(0).select("node", "content"), edges(0), part(1).select("node", "content"), edges(1))[1]


@catalog.add("""
SELECT doc_id FROM documents ORDER BY md5('42|take|' || doc_id), doc_id LIMIT 100""")
def hashed_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of a seeded shuffle: the operator's sample size."""
    return S.take(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)
