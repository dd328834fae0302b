"""Ordered computations, advantages and reward filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import advantages as V
from trailframe.operators import trajectories as T
from trailframe.plans.catalog import EVENTS, METRICS, Catalog, events, metric_rows, r6, table
from trailframe.plans.evaluation import rounded

catalog = Catalog()


def _adv(spark: SparkSession, sf_dir: str, adv) -> DataFrame:
    return events(spark, sf_dir).select("event_id", (F.round(adv, 10) + 0.0).alias("adv"))


@catalog.add(f"""
WITH {EVENTS}, t AS (SELECT user_id, event_type AS src, action, lead(event_type) OVER w AS dst, row_number() OVER w AS ord FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, src, action, dst, CAST(ord AS INTEGER) AS ord FROM t WHERE dst IS NOT NULL""")
def transitions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "action")


@catalog.add("""
WITH c AS (SELECT conv_id, turn, CAST(length(text) - length(replace(text, 'le', '')) AS BIGINT) // 2 AS n_images FROM conversations)
SELECT conv_id, turn, n_images, CAST(coalesce(sum(n_images) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_image FROM c""")
def image_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.image_offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "le").select("conv_id", "turn", "n_images", "first_image")


@catalog.add(f"""
WITH {EVENTS}, d AS (SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, k FROM ev), f AS (SELECT user_id, k, min(day) AS day FROM d GROUP BY 1, 2),
n AS (SELECT user_id, day, count(*) AS new, count(*) FILTER (WHERE k < 10) AS h FROM f GROUP BY 1, 2), a AS (SELECT DISTINCT user_id, day FROM d)
SELECT user_id, day, CAST(coalesce(new, 0) AS BIGINT) AS new, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS seen, CAST(sum(coalesce(h, 0)) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS hits FROM a LEFT JOIN n USING (user_id, day)""")
def coverage_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.col("ts").cast("date").cast("string"))
    target = spark.range(10).select(F.col("id").cast("int").alias("k"))
    return T.coverage(rows, "user_id", "day", "k", target)


@catalog.add("""
WITH g AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round((value - CASE WHEN n <= 1 THEN 0 ELSE m END) / (CASE WHEN n <= 1 THEN 1 ELSE s END + 1e-6), 10) + 0.0 AS adv FROM g""")
def adv_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adv(spark, sf_dir, V.grpo("value", "user_id"))


@catalog.add("""
WITH g AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(value - CASE WHEN n <= 1 THEN 0 ELSE m END, 10) + 0.0 AS adv FROM g""")
def adv_drgrpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adv(spark, sf_dir, V.grpo("value", "user_id", scale=False))


@catalog.add("""
WITH g AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(CASE WHEN n <= 1 THEN value ELSE (value - m) * n / nullif(n - 1, 0) END, 10) + 0.0 AS adv FROM g""")
def adv_rloo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adv(spark, sf_dir, V.rloo("value", "user_id"))


@catalog.add(f"""
WITH {EVENTS} SELECT event_id, round(value - sum((k + 1) * value) OVER w / sum(k + 1) OVER w, 10) + 0.0 AS adv FROM ev WINDOW w AS (PARTITION BY user_id)""")
def adv_opo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("len", F.col("k") + 1)
    return rows.select("event_id", (F.round(V.opo("value", "user_id", "len"), 10) + 0.0).alias("adv"))


@catalog.add("""
SELECT event_id, round(alpha * (value - avg(value) OVER (PARTITION BY user_id)) / 2.0, 10) + 0.0 AS adv FROM events, (SELECT count(*) / greatest(1, count(*) FILTER (WHERE value <> 0)) AS alpha FROM events)""")
def adv_gpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gpg(events(spark, sf_dir), "value", "user_id", 2.0).select("event_id", (F.round("adv", 10) + 0.0).alias("adv"))


@catalog.add("""
WITH g AS (SELECT event_id, value, row_number() OVER o AS r, lead(value) OVER o AS nxt, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events WINDOW o AS (PARTITION BY event_type ORDER BY value DESC, event_id))
SELECT event_id, round(CASE WHEN r = 1 THEN (value - nxt) / (s + 1e-6) ELSE 0 END, 10) + 0.0 AS adv FROM g""")
def adv_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.best_leads(events(spark, sf_dir), "value", "event_type", "event_id")
    return rows.select("event_id", (F.round("adv", 10) + 0.0).alias("adv"))


@catalog.add("""
WITH b AS (SELECT event_id, value - avg(value) OVER (PARTITION BY user_id) AS b, value > 10 AS m FROM events), s AS (SELECT sum(b) FILTER (WHERE m) / (count(*) FILTER (WHERE m) + 1e-8) AS mu, var_samp(b) FILTER (WHERE m) AS v FROM b)
SELECT event_id, round((b - mu) / sqrt(v + 1e-8), 5) + 0.0 AS adv FROM b, s""")
def adv_reinforce_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.baseline_whitened(events(spark, sf_dir).withColumn("m", F.col("value") > 10), "value", "user_id", "m")
    return rows.select("event_id", (F.round("adv", 5) + 0.0).alias("adv"))


@catalog.add("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) - 10, 6) + 0.0 AS ret FROM events""")
def returns_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r6(V.returns_to_go("value", "user_id", "event_id", F.lit(10.0))).alias("ret"))


@catalog.add("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events),
g AS (SELECT user_id, event_id, i, value, value - value * 0.5 AS a FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.value, e.value + 0.9 * g.value * 0.5 - e.value * 0.5 + 0.9 * 0.8 * g.a FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, event_id, round(a, 6) + 0.0 AS advantage, round(a + value * 0.5, 6) + 0.0 AS ret FROM g""")
def gae_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("g", F.lit(0)).withColumn("v", F.col("value") * 0.5)
    out = T.turn_gae(rows, "g", "user_id", "event_id", "value", "v", 0.9, 0.8)
    return out.select("user_id", "event_id", r6("advantage").alias("advantage"), r6("return").alias("ret"))


@catalog.add("""
WITH s AS (SELECT sum(value) FILTER (WHERE value > 10) AS t, count(*) FILTER (WHERE value > 10) AS n, var_samp(value) FILTER (WHERE value > 10) AS v FROM events)
SELECT event_id, round((value - t / (n + 1e-8)) / sqrt(v + 1e-8), 6) + 0.0 AS white FROM events, s""")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("m", F.col("value") > 10)
    return V.whiten(rows, "value", "m").select("event_id", r6("white").alias("white"))


@catalog.add("""
WITH p AS (SELECT user_id, sum(value) AS s, avg(value) AS m, count(*) AS c FROM events WHERE value > 10 GROUP BY user_id)
SELECT round(sum(s) / sum(c), 6) + 0.0 AS token_mean, round(avg(s), 6) + 0.0 AS seq_mean_token_sum, round(avg(m), 6) + 0.0 AS seq_mean_token_mean, round(avg(s / 100.0), 6) + 0.0 AS seq_mean_token_sum_norm FROM p""")
def loss_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.loss_modes(events(spark, sf_dir), "user_id", "value", F.col("value") > 10, 100.0))


@catalog.add("""
WITH d AS (SELECT l_orderkey, l_linenumber, (l_tax - l_discount) * 10 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(d, 6) + 0.0 AS k1, round(abs(d), 6) + 0.0 AS "abs", round(0.5 * d * d, 6) + 0.0 AS k2, round(greatest(-10, least(10, exp(-d) + d - 1)), 6) + 0.0 AS k3 FROM d""")
def kl_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = V.kl_estimates(F.col("l_tax") * 10, F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(r6(v).alias(n) for n, v in k.items()))


@catalog.add("""
WITH w AS (SELECT l_orderkey, l_linenumber, least(exp(greatest(-20, least(20, sum(l_tax - l_discount) OVER (PARTITION BY l_orderkey)))), 1.1) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(w / avg(w) OVER (), 6) + 0.0 AS weight FROM w""")
def is_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_tax") - F.col("l_discount"))
    return V.importance(rows, "l_orderkey", "r", 1.1, normalise=True).select("l_orderkey", "l_linenumber", r6("weight").alias("weight"))


@catalog.add("""
WITH r AS (SELECT l_orderkey, l_linenumber, exp(avg(l_tax - l_discount) OVER (PARTITION BY l_orderkey)) AS g, exp(l_tax - l_discount) AS t FROM lineitem)
SELECT CAST(count(*) FILTER (WHERE t BETWEEN 1 / 1.037 AND 1.037) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE g BETWEEN 1 / 1.037 AND 1.037) AS BIGINT) AS geometric FROM r""")
def rejection_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_tax") - F.col("l_discount"))
    both = V.rejection(V.rejection(rows, "l_orderkey", "r", 1.037).withColumnRenamed("keep", "a"), "l_orderkey", "r", 1.037, level="geometric")
    return both.agg(F.count_if("a").alias("tokens"), F.count_if("keep").alias("geometric"))


@catalog.add("""
WITH w AS (SELECT exp(l_tax - l_discount) AS w FROM lineitem)
SELECT round(min(w), 6) + 0.0 AS "min", round(max(w), 6) + 0.0 AS "max", round(avg(w), 6) + 0.0 AS mean, round(stddev_samp(w), 6) + 0.0 AS std_samp, round(avg((w > 1.05)::INT), 6) + 0.0 AS share_high, round(avg((w < 0.95)::INT), 6) + 0.0 AS share_low, round(sum(w) * sum(w) / (sum(w * w) * count(*)), 6) + 0.0 AS ess FROM w""")
def is_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.exp(F.col("l_tax") - F.col("l_discount")).alias("w"))
    return rounded(V.weight_diagnostics(rows, "w", 0.95, 1.05))


@catalog.add("""
WITH v AS (SELECT user_id, var_pop(value) AS v FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY v DESC, user_id) AS r, greatest(1, ceil(count(*) OVER () * 0.2)) AS k FROM v)
SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM r WHERE r <= k)""")
def reward_topk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_groups(table(spark, sf_dir, "events"), "user_id", "value", 0.2).select("event_id")


@catalog.add("""
WITH v AS (SELECT user_id, var_pop(value) AS v FROM events GROUP BY 1), c AS (SELECT user_id, coalesce(sum(v) OVER (ORDER BY v DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v) OVER () AS t, count(*) OVER () AS g FROM v),
s AS (SELECT * FROM c WHERE t <= 0 OR b < 0.8 * t)
SELECT event_id, round(sqrt((SELECT count(*) FROM s) / g), 6) + 0.0 AS scale FROM events JOIN s USING (user_id)""")
def reward_topp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_p_groups(table(spark, sf_dir, "events"), "user_id", "value", 0.8).select("event_id", r6("scale").alias("scale"))


@catalog.add("""
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, min(l_tax) OVER w AS a, max(l_tax) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber FROM g WHERE n = 1 OR a <> b""")
def drop_zero_variance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.round(F.col("l_tax") * 100).cast("int"))
    return V.drop_flat_groups(rows, "l_orderkey", "t").select("l_orderkey", "l_linenumber")


@catalog.add("""
WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS p, [turn, turn] AS r FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, array_to_string(flatten(list(list_concat(p, r) ORDER BY turn)), ',') AS ids,
  array_to_string(flatten(list(list_concat(list_transform(p, lambda x: 0), [1, 1]) ORDER BY turn)), ',') AS mask, CAST(max(turn) AS BIGINT) AS extra FROM t GROUP BY conv_id""")
def concat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda x: F.length(x).cast("long")).alias("p"), F.array("turn", "turn").alias("r"), F.col("turn").alias("extra"))
    out = T.concat_turns(rows, "conv_id", "turn", "p", "r", "extra")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("conv_id", "turns", join("ids"), join("mask"), "extra")


@catalog.add("""
SELECT DISTINCT a.conv_id, a.turn AS target, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn >= 1 AND b.turn <= a.turn AND (b.turn = 1 OR b.turn >= a.turn - 1) AND b.turn >= 1""")
def recent_k_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.recent_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2)


@catalog.add("""
WITH a AS (SELECT l_orderkey % 500 AS rec, l_linenumber AS turn, l_orderkey AS att, l_quantity > 20 AS ok, 'b' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS body FROM lineitem),
u AS (SELECT rec, att, turn, min(body) AS body, bool_and(ok) AS ok FROM a GROUP BY 1, 2, 3), f AS (SELECT rec, max(att) AS best FROM (SELECT rec, att FROM u GROUP BY 1, 2 HAVING bool_and(ok)) GROUP BY 1),
b AS (SELECT u.rec, u.turn, max(CASE WHEN att = best THEN body END) AS full_, arg_min(body, att) FILTER (WHERE ok) AS some_ FROM u LEFT JOIN f USING (rec) GROUP BY 1, 2),
o AS (SELECT r.rec, t.turn FROM (SELECT DISTINCT rec FROM u) r, (SELECT unnest(range(1, 9)) AS turn) t)
SELECT o.rec, CAST(o.turn AS INTEGER) AS turn, coalesce(full_, some_, 'original') AS body, coalesce(full_ IS NOT NULL OR some_ IS NOT NULL, false) AS improved FROM o LEFT JOIN b ON o.rec = b.rec AND o.turn = b.turn""")
def salvage_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("rec"), F.col("l_linenumber").alias("turn"), F.col("l_orderkey").alias("att"), (F.col("l_quantity") > 20).alias("ok"), F.concat_ws("_", F.concat(F.lit("b"), F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("body"))
    once = rows.groupBy("rec", "att", "turn").agg(F.min("body").alias("body"), F.bool_and("ok").alias("ok"))
    original = once.select("rec").distinct().select("rec", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("turn"), F.lit("original").alias("body"))
    return T.salvage(once, original, "rec", "turn", "att", "ok", "body")


@catalog.add(f"""
WITH {METRICS}, s AS (SELECT l_orderkey, l_linenumber, pos FROM m WHERE flag)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(pos), 6) + 0.0 AS total FROM s""")
def state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_rows(spark, sf_dir).where("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("total")))


@catalog.add("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS p, l_discount * 10 AS o, l_quantity - 25 AS a FROM lineitem), r AS (SELECT *, exp(p - o) AS r, exp(avg(p - o) OVER (PARTITION BY l_orderkey)) AS g FROM t),
w AS (SELECT *, greatest(-a * r, -a * greatest(0.8, least(1.2, r))) AS v, greatest(-a * g, -a * greatest(0.7, least(1.3, g))) AS s FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a < 0 THEN least(v, -a * 3.0) ELSE v END, 6) + 0.0 AS vanilla, round(s, 6) + 0.0 AS gspo, round(-p * a, 6) + 0.0 AS gpg,
  round(-avg(a) OVER (PARTITION BY l_orderkey) * exp(avg(CASE WHEN a > 0 THEN least(p - o, greatest(-0.4, least(0.4, p - o))) WHEN a < 0 THEN greatest(p - o, greatest(-0.4, least(0.4, p - o))) ELSE 0 END) OVER (PARTITION BY l_orderkey)), 6) + 0.0 AS geo,
  round(0.5 * greatest(pow(p - a, 2), pow(o + greatest(-0.2, least(0.2, p - o)) - a, 2)), 6) + 0.0 AS value_loss FROM w""")
def policy_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, a = F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") - 25
    get = V.losses.get
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(get("vanilla")(p, o, a)).alias("vanilla"), r6(get("gspo")(p, o, a, "l_orderkey", 0.3, 0.3)).alias("gspo"), r6(get("gpg")(p, a)).alias("gpg"),
        r6(get("geo_mean")(p, o, a, "l_orderkey")).alias("geo"), r6(V.value_loss(p, o, a, 0.2)).alias("value_loss"),
    )


TOKENS = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax * 10 AS p, l_discount * 10 AS o, l_quantity - 25 AS a, l_returnflag <> 'A' AS m FROM lineitem),
s AS (SELECT avg(a) AS ma, avg(p) AS mp, CAST(greatest(1, floor(CAST(0.01 AS DOUBLE) * count(*))) AS BIGINT) AS k FROM t WHERE m),
c AS (SELECT t.*, exp(p - o) AS r, CASE WHEN m THEN (a - ma) * (p - mp) END AS cov, k FROM t, s)"""


def _tokens(spark: SparkSession, sf_dir: str) -> tuple:
    """Line items as tokens: log-probabilities new and old, advantage and mask."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, "l_tax", "l_discount", "l_quantity", "l_returnflag"), keys, F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") - 25, F.col("l_returnflag") != "A"


@catalog.add(f"""
WITH {TOKENS}, f AS (SELECT *, -a * r AS plain, -a * greatest(0.8, least(1.2, r)) AS clipped FROM c),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM f WHERE m AND cov > 1 AND cov < 5 AND NOT clipped > plain
  QUALIFY row_number() OVER (ORDER BY substr(md5('42|clip_cov|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 12), l_orderkey, l_linenumber, l_partkey, l_suppkey) <= k)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, d.l_orderkey IS NOT NULL AS dropped, round(CASE WHEN m AND d.l_orderkey IS NULL THEN greatest(plain, clipped) ELSE 0 END, 6) + 0.0 AS loss
FROM f LEFT JOIN d ON d.l_orderkey = f.l_orderkey AND d.l_linenumber = f.l_linenumber AND d.l_partkey = f.l_partkey AND d.l_suppkey = f.l_suppkey""")
def clip_cov_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.losses.get("clip_cov")(*_tokens(spark, sf_dir), ratio=0.01).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dropped", r6("loss").alias("loss"))


@catalog.add(f"""
WITH {TOKENS}, d AS (SELECT *, m AND row_number() OVER (ORDER BY cov DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= k AS penalised FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, penalised, round(CASE WHEN m THEN -a * r + CASE WHEN penalised THEN abs(p - o) ELSE 0 END ELSE 0 END, 6) + 0.0 AS loss FROM d""")
def kl_cov_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.losses.get("kl_cov")(*_tokens(spark, sf_dir), ratio=0.01).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "penalised", r6("loss").alias("loss"))
