"""Dataset recipes, conversions and step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import recipes as X
from trailframe.plans.catalog import EVENTS, Catalog, events, table
from trailframe.plans.evaluation import rounded
from trailframe.sources.readers import rl_rows

catalog = Catalog()


@catalog.add("""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_by_content(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id")


@catalog.add("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS r FROM conversations) WHERE r = 1""")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("score", F.length("text"))
    return X.latest_turn(rows, "conv_id", "turn", "score").select("conv_id", "turn", "role")


@catalog.add("""
SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.distinct_in_order(table(spark, sf_dir, "documents"), "source", "doc_id")


@catalog.add("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source AS ground_truth, '{"n_chars":' || n_chars || '}' AS extra_info FROM documents""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("answer"), "source", "n_chars")
    return X.with_required(rows, ["doc_id", "lang"], ["answer", "source"])


@catalog.add("""
WITH m AS (SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'human' WHEN 2 THEN 'gpt' WHEN 3 THEN 'function_call' ELSE 'narrator' END AS f FROM conversations)
SELECT conv_id, coalesce(array_to_string(list(CASE f WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'function_call' THEN 'assistant' ELSE f END ORDER BY turn) FILTER (WHERE f <> 'narrator'), ','), '') AS roles,
  coalesce(array_to_string(list(CASE f WHEN 'function_call' THEN 'tool_call' ELSE 'text' END ORDER BY turn) FILTER (WHERE f <> 'narrator'), ','), '') AS types, CAST(count(*) FILTER (WHERE f = 'gpt') AS DOUBLE) AS weight FROM m GROUP BY conv_id""")
def sharegpt_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.element_at(F.array(*map(F.lit, ("system", "human", "gpt", "function_call", "narrator"))), (F.col("turn") % 5 + 1).cast("int"))
    turns = F.sort_array(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("c")).select("conv_id", X.sharegpt(F.col("c")).alias("m"))
    pick = lambda f: F.array_join(F.transform("m", lambda x: x[f]), ",")
    return rows.select("conv_id", pick("role").alias("roles"), pick("type").alias("types"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x["loss_weight"]).alias("weight"))


@catalog.add("""
SELECT doc_id, 'chosen' AS kind, text FROM documents UNION ALL SELECT doc_id, 'rejected', lower(text) FROM documents""")
def pair_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chosen"), F.lower("text").alias("rejected"))
    return X.unpivot_pair(rows, "doc_id", "chosen", "rejected")


@catalog.add("""
SELECT n_nationkey, CASE WHEN n_nationkey < 18 THEN 'train' ELSE 'test' END AS split FROM nation""")
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.head_tail(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@catalog.add("""
WITH s AS (SELECT o_orderkey, CAST('0x' || substr(md5('42|slot|' || o_orderkey), 1, 8) AS BIGINT) % 4 AS slot, CAST('0x' || substr(md5('42|number|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders)
SELECT o_orderkey, substr('ABCD', CAST(slot + 1 AS INTEGER), 1) AS letter, CAST(CASE WHEN floor(u * 20) >= 7 THEN floor(u * 20) + 1 ELSE floor(u * 20) END AS INTEGER) AS wrong FROM s""")
def mcq_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.mcq(F.lit("right"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", q["letter"].alias("letter"), X.distractor_number(F.lit(7), "o_orderkey").alias("wrong"))


@catalog.add(f"""
WITH {EVENTS}, t AS (SELECT user_id, unnest(string_split(action, ' | ')) AS a FROM ev), f AS (SELECT a, count(*) AS f, sum(count(*)) OVER () AS t FROM t GROUP BY a), n AS (SELECT user_id, a, count(*) AS n FROM t GROUP BY 1, 2)
SELECT user_id, round(sum(n * t / f), 6) + 0.0 AS rarity FROM n JOIN f USING (a) GROUP BY user_id""")
def balanced_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.rarity(events(spark, sf_dir).withColumn("a", F.split("action", r" \| ")), "user_id", "a"))


@catalog.add(f"""
WITH RECURSIVE {EVENTS}, t AS (SELECT user_id, unnest(string_split(action, ' | ')) AS a FROM ev), f AS (SELECT a, count(*) AS f, sum(count(*)) OVER () AS t FROM t GROUP BY a), n AS (SELECT user_id, a, count(*) AS n FROM t GROUP BY 1, 2),
s AS (SELECT user_id, round(sum(n * t / f), 6) AS score, list_transform(['k0', 'k1', 'k2', 'k3', 'k4'], lambda x: coalesce(list_sum(list_transform(list_filter(list({{'a': n.a, 'n': n.n}}), lambda y: y.a = x), lambda y: y.n)), 0)) AS own FROM n JOIN f USING (a) GROUP BY user_id),
o AS (SELECT user_id, own, row_number() OVER (ORDER BY score DESC, user_id) AS r FROM s),
g AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS user_id, list_transform([0, 0, 0, 0, 0], lambda x: CAST(x AS HUGEINT)) AS c, 0 AS taken, false AS fit
  UNION ALL SELECT r, user_id, CASE WHEN fit THEN n ELSE c END, taken + CAST(fit AS INTEGER), fit FROM (SELECT *, taken < 40 AND (taken = 0 OR len(list_filter(range(1, 6), lambda i: own[i] > 0 AND n[i] > CAST(0.24 AS DOUBLE) * list_sum(n))) = 0) AS fit
    FROM (SELECT o.r, o.user_id, o.own, g.c, g.taken, list_transform(range(1, 6), lambda i: CAST(g.c[i] + o.own[i] AS HUGEINT)) AS n FROM g JOIN o ON o.r = g.r + 1))),
p AS (SELECT user_id, r, fit, row_number() OVER (PARTITION BY fit ORDER BY r) AS i, count(*) FILTER (WHERE fit) OVER () AS taken FROM g WHERE r > 0)
SELECT user_id, CASE WHEN fit THEN 1 ELSE 2 END AS pass FROM p WHERE fit OR i <= 40 - taken""")
def balanced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 users by the rarity of their actions, no action with more than 24 % of those chosen; the rest filled up."""
    rows = events(spark, sf_dir).withColumn("a", F.split("action", r" \| "))
    scored = X.rarity(rows, "user_id", "a").withColumn("rarity", F.round("rarity", 6))
    paths = rows.groupBy("user_id").agg(F.flatten(F.collect_list("a")).alias("actions")).join(scored, "user_id")
    return X.balanced_rows(paths, "user_id", "actions", "rarity", 40, cap=0.24).select("user_id", "pass")


@catalog.add(f"""
WITH {EVENTS}, n AS (SELECT user_id, list(len(string_split(action, ' | '))) AS c FROM ev GROUP BY 1) SELECT user_id, CASE WHEN list_max(c) = 1 THEN 'single' WHEN list_min(c) = 1 THEN 'mix' ELSE 'multi' END AS cls FROM n""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.collect_list(F.size(F.split("action", r" \| ")))
    return events(spark, sf_dir).groupBy("user_id").agg(counts.alias("c")).select("user_id", X.path_class(F.col("c")).alias("cls"))


@catalog.add(f"""
WITH {EVENTS}, p AS (SELECT DISTINCT user_id, k FROM ev WHERE event_type = 'view'), g AS (SELECT DISTINCT user_id, k FROM ev WHERE event_type = 'click'),
n AS (SELECT coalesce(p.user_id, g.user_id) AS user_id, count(p.k) AS np, count(g.k) AS ng, count(*) FILTER (WHERE p.k IS NOT NULL AND g.k IS NOT NULL) AS h FROM p FULL JOIN g ON p.user_id = g.user_id AND p.k = g.k GROUP BY 1)
SELECT user_id, round(coalesce(h / nullif(np, 0), 0), 6) + 0.0 AS "precision", round(coalesce(h / nullif(ng, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * h / nullif(np + ng, 0), 0), 6) + 0.0 AS f1 FROM n""")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rounded(X.set_scores(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "user_id", "k"))


@catalog.add(f"""
WITH {EVENTS}, d AS (SELECT event_type, user_id, list(value ORDER BY event_id) AS a FROM ev GROUP BY 1, 2), m AS (SELECT event_type, max(len(a)) AS n FROM d GROUP BY 1), x AS (SELECT d.event_type, a, unnest(range(1, n + 1)) AS i FROM d JOIN m USING (event_type))
SELECT event_type, CAST(i - 1 AS INTEGER) AS place, round(avg(a[least(i, len(a))]), 6) + 0.0 AS mean, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2""")
def carry_forward_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(values.alias("a"))
    return rounded(X.carried_average(rows, "event_type", "a"))


@catalog.add("""
WITH s AS (SELECT l_partkey, count(DISTINCT l_orderkey % 50) >= 2 AS shared FROM lineitem GROUP BY 1)
SELECT shared, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_pop(l_quantity), 6) + 0.0 AS std_pop FROM lineitem JOIN s USING (l_partkey) GROUP BY shared""")
def overlap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("img", F.col("l_orderkey") % 50)
    return rounded(X.overlap_means(rows, "l_partkey", "img", "l_quantity"))


@catalog.add("""
SELECT a.event_id, min(coalesce(abs(a.value - b.value), 'infinity'::DOUBLE)) AS distance FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type <> 'view' GROUP BY a.event_id""")
def nearest_explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return X.nearest(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"), "user_id", "event_id", "value").select("event_id", "distance")


@catalog.add("""
SELECT l_orderkey, round(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber <= 2), 0) / CASE WHEN sum(l_quantity) = 0 THEN 1 ELSE sum(l_quantity) END, 6) + 0.0 AS share FROM lineitem GROUP BY 1""")
def weight_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.weight_shares(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linenumber") <= 2))


@catalog.add("""
WITH n AS (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'x_avg' WHEN 'click' THEN 'x_max' WHEN 'error' THEN 'x_min' WHEN 'signup' THEN 'timing_s/x' ELSE 'x_last' END AS name FROM events)
SELECT name, CASE name WHEN 'x_avg' THEN 'avg' WHEN 'x_max' THEN 'max' WHEN 'x_min' THEN 'min' WHEN 'timing_s/x' THEN 'sum' ELSE 'last' END AS rule,
  round(CASE name WHEN 'x_avg' THEN avg(value) WHEN 'x_max' THEN max(value) WHEN 'x_min' THEN min(value) WHEN 'timing_s/x' THEN sum(value) ELSE arg_max(value, event_id) END, 6) + 0.0 AS value FROM n GROUP BY name""")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "x_avg").when(F.col("event_type") == "click", "x_max").when(F.col("event_type") == "error", "x_min").when(F.col("event_type") == "signup", "timing_s/x").otherwise("x_last")
    return rounded(X.step_metrics(table(spark, sf_dir, "events").withColumn("name", name), "name", "value", "event_id"))


@catalog.add(f"""
WITH {EVENTS} SELECT round(avg(value), 6) + 0.0 AS avg, round(max(value), 6) + 0.0 AS "max", round(min(value), 6) + 0.0 AS "min", round(quantile_cont(value, 0.5), 6) + 0.0 AS tp50, round(quantile_cont(value, 0.95), 6) + 0.0 AS tp95, round(quantile_cont(value, 0.99), 6) + 0.0 AS tp99,
  CAST(count(DISTINCT k) AS BIGINT) AS versions, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS partial, round(avg((event_type = 'error')::INT), 6) + 0.0 AS partial_ratio, CAST(max(k) - min(k) AS BIGINT) AS span FROM ev""")
def assembly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.assembly_stats(events(spark, sf_dir), "value", "k", F.col("event_type") == "error"))


@catalog.add(f"""
WITH {EVENTS} SELECT user_id, round(coalesce(sum(log2(100.0 / greatest(1, k))) / (count(*) * log2(100.0)), 0), 6) + 0.0 AS quality FROM ev GROUP BY user_id""")
def choice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.choice_quality(events(spark, sf_dir), "user_id", "k", 100))


@catalog.add("""
SELECT doc_id AS "index", 'corpus' AS data_source, text AS content, lang AS ground_truth FROM documents""")
def rl_row_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rl_rows(table(spark, sf_dir, "documents"), "corpus", F.col("text"), F.col("lang"), "train", "doc_id")
    return rows.select(F.col("extra_info.index").alias("index"), "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"))


@catalog.add("""
SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS VARCHAR) >= '1996-06-01' AND CAST(o_orderdate AS VARCHAR) < '1997-06-01'""")
def iso_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").where((day >= "1996-06-01") & (day < "1997-06-01")).select("o_orderkey")


@catalog.add("""
WITH j AS (SELECT 'k' AS field, regexp_extract(props, '([0-9]+)', 1) AS value FROM events UNION ALL SELECT 't', event_type FROM events UNION ALL SELECT 'id', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 0), n AS (SELECT count(*) AS t FROM events)
SELECT field, CAST(count(value) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct, count(try_cast(value AS DOUBLE)) * 2 >= any_value(t) AND coalesce(max(try_cast(value AS DOUBLE)) - min(try_cast(value AS DOUBLE)) >= 1e-9, false) AS numeric,
  count(DISTINCT value) BETWEEN 2 AND 0.9 * any_value(t) AS groupable FROM j, n GROUP BY field""")
def detected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.col("event_type").alias("t"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("id")))
    return X.detected_fields(table(spark, sf_dir, "events").select(doc.alias("j")), "j")
