"""Evaluation rollups and grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import aggregates as A
from trailframe.operators import joins
from trailframe.plans.catalog import EVENTS, METRICS, Catalog, events, metric_rows, r6, table

catalog = Catalog()
SPEC = "0.5,20;3-5:0.3,30;1,40"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@catalog.add(f"""
WITH {METRICS}, t(key, p, a) AS (VALUES ('success_0p2m10degree', 0.2, 10), ('success_0p5m30degree', 0.5, 30), ('success_1m45degree', 1.0, 45))
SELECT key, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pos <= p + 1e-9 AND ang <= a + 1e-9 THEN 1 ELSE 0 END), 6) + 0.0 AS rate FROM m, t GROUP BY key""")
def success_multi_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.threshold_rates(metric_rows(spark, sf_dir), "pos", "ang", [(0.2, 10), (0.5, 30), (1.0, 45)]))


@catalog.add(f"""
WITH {METRICS}, s AS (SELECT *, CASE WHEN length BETWEEN 3 AND 5 THEN 0.3 WHEN length < 3 THEN 0.5 ELSE 1.0 END AS p, CASE WHEN length BETWEEN 3 AND 5 THEN 30 WHEN length < 3 THEN 20 ELSE 40 END AS a FROM m)
SELECT length, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pos <= p + 1e-9 AND ang <= a + 1e-9 THEN 1 ELSE 0 END), 6) + 0.0 AS rate FROM s GROUP BY length""")
def success_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    tol = joins.tolerance(F.col("length"), joins.tolerance_segments(SPEC))
    rows = metric_rows(spark, sf_dir).withColumn("ok", A.within(F.col("pos"), F.col("ang"), tol["pos"], tol["ang"]))
    return rounded(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), A.success_rate(F.col("ok")).alias("rate")))


@catalog.add(f"""
WITH {METRICS}, b AS (SELECT CASE WHEN length <= 2 THEN '[0,2]' WHEN length <= 5 THEN '[3,5]' ELSE '[6,+inf]' END AS bucket, coalesce(flag, false) AS f FROM m)
SELECT CASE WHEN grouping(bucket) = 1 THEN '_overall' ELSE bucket END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(f::INT), 6) + 0.0 AS rate FROM b GROUP BY ROLLUP (bucket)""")
def success_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailframe.functions.geometry import interval_label

    rows = metric_rows(spark, sf_dir).withColumn("bucket", interval_label(F.col("length"), [2, 5]))
    return rounded(A.by_bucket_and_overall(rows, "bucket", F.col("flag")))


@catalog.add("""
WITH d AS (SELECT d.lang, d.source, l.quality = 1 AS f FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'overall' WHEN grouping(lang) = 0 THEN 'bucket' ELSE 'group' END AS level, coalesce(lang, source) AS value,
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE f) AS BIGINT) AS n_true, CAST(count(*) FILTER (WHERE NOT f) AS BIGINT) AS n_false, CAST(count(*) FILTER (WHERE f IS NULL) AS BIGINT) AS n_missing,
  round(count(*) FILTER (WHERE f) / nullif(count(f), 0), 6) + 0.0 AS true_rate, round(count(*) FILTER (WHERE f IS NULL) / count(*), 6) + 0.0 AS missing_rate
FROM d GROUP BY GROUPING SETS ((), (lang), (source))""")
def tri_state_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("f", F.col("quality") == 1)
    return rounded(A.tri_state_stats(rows, "f", "lang", "source"))


@catalog.add("""
WITH d AS (SELECT d.lang, l.quality = 1 AS good, l.toxic = 1 AS toxic FROM documents d JOIN labels l USING (doc_id)),
x AS (SELECT lang, 'good' AS flag, good AS on FROM d UNION ALL SELECT lang, 'toxic', toxic FROM d)
SELECT flag, coalesce(lang, 'overall') AS value, CAST(count("on") AS BIGINT) AS n, round(avg("on"::INT), 6) + 0.0 AS rate FROM (SELECT lang, flag, "on" FROM x) GROUP BY GROUPING SETS ((flag), (flag, lang))""".replace("good AS on FROM", 'good AS "on" FROM'))
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return rounded(A.flag_rates(rows, ["good", "toxic"], "lang"))


@catalog.add(f"""
WITH {EVENTS}
SELECT CASE WHEN grouping(event_type) = 1 THEN '_all' ELSE event_type END AS tag, CAST(count(*) AS BIGINT) AS n, round(avg((value > 30)::INT), 6) + 0.0 AS success_rate, round(avg(value), 6) + 0.0 AS mean_reward,
  round(avg(k), 6) + 0.0 AS mean_turns, array_to_string(list_sort(list_distinct(list(CASE WHEN k > 95 THEN 'e' || k END) FILTER (WHERE k > 95))), ',') AS errors FROM ev GROUP BY ROLLUP (event_type)""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("ok", F.col("value") > 30).withColumn("error", F.when(F.col("k") > 95, F.concat(F.lit("e"), F.col("k").cast("string"))))
    out = A.episode_summary(rows, "event_type", "ok", "value", "k", "error")
    return rounded(out.withColumn("errors", F.array_join("errors", ",")))


@catalog.add(f"""
WITH {METRICS}, g AS (SELECT l_returnflag, l_linestatus, CASE WHEN sqrt(pow(pos / 0.5, 2) + pow(ang / 30.0, 2)) < 3 THEN 'easy' ELSE 'hard' END AS level, coalesce(flag, false)::INT AS f FROM m)
SELECT l_returnflag, level, round(100 * avg(f) FILTER (WHERE l_linestatus = 'F'), 6) + 0.0 AS F, round(100 * avg(f) FILTER (WHERE l_linestatus = 'O'), 6) + 0.0 AS O FROM g GROUP BY l_returnflag, level""")
def easy_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_rows(spark, sf_dir).withColumn("level", A.difficulty(F.col("pos"), F.col("ang")))
    return rounded(rows.groupBy("l_returnflag", "level").pivot("l_linestatus", ["F", "O"]).agg(100 * A.success_rate(F.col("flag"))))


@catalog.add(f"""
WITH {METRICS}, r AS (SELECT l_returnflag AS model, avg((pos <= 0.2 + 1e-9)::INT) AS a, avg((pos <= 0.5 + 1e-9)::INT) AS b, avg((ang <= 30 + 1e-9)::INT) AS c FROM m GROUP BY 1), s AS (SELECT *, ((a + b) / 2 + c) / 2 AS score FROM r)
SELECT model, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(score, 6) + 0.0 AS score, CAST(rank() OVER (ORDER BY score DESC NULLS LAST) AS INTEGER) AS rank FROM s""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c, t: F.avg((F.col(c) <= t + 1e-9).cast("int"))
    rates = metric_rows(spark, sf_dir).groupBy(F.col("l_returnflag").alias("model")).agg(rate("pos", 0.2).alias("a"), rate("pos", 0.5).alias("b"), rate("ang", 30).alias("c"))
    return rounded(A.model_score(rates, "model", [["a", "b"], ["c"]]))


@catalog.add(f"""
WITH {EVENTS}, t AS (SELECT unnest(string_split(action, ' | ')) AS item FROM ev) SELECT item, CAST(count(*) AS BIGINT) AS n, round_even(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM t GROUP BY item""")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailframe.functions.parse import tokens

    return A.histogram(events(spark, sf_dir), tokens(F.col("action")))


@catalog.add("""
WITH c AS (SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS low, count(*) AS n FROM documents GROUP BY 1)
SELECT low, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY low) AS BIGINT) AS cum, round(100.0 * sum(n) OVER (ORDER BY low) / sum(n) OVER (), 6) + 0.0 AS pct FROM c""")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.length_cdf(table(spark, sf_dir, "documents"), F.col("n_chars"), 500))


@catalog.add("""
SELECT event_type, round_even(avg(value), 4) AS mean, round_even(stddev_pop(value), 4) AS std_pop, round_even(min(value), 4) AS "min", round_even(max(value), 4) AS "max", CAST(count(value) AS BIGINT) AS n FROM events GROUP BY event_type""")
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*A.five_numbers("value"))


@catalog.add("""
WITH c AS (SELECT turn, length(text) AS n, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations)
SELECT turn, CAST(count(n) AS BIGINT) AS n, round(avg(n), 6) + 0.0 AS mean, round(stddev_pop(n), 6) + 0.0 AS std_pop, round(avg(d), 6) + 0.0 AS mean_step FROM c GROUP BY turn""")
def per_turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("len", F.length("text"))
    return rounded(A.per_turn(rows, "conv_id", "turn", "len"))


@catalog.add("""
SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99 FROM events GROUP BY event_type""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.latencies(table(spark, sf_dir, "events"), ["event_type"], "value"))


@catalog.add("""
SELECT round(avg(l_quantity), 6) + 0.0 AS loss, max(l_extendedprice) AS max_reward, min(l_tax) AS min_error FROM lineitem""")
def reduce_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("loss"), F.col("l_extendedprice").alias("max_reward"), F.col("l_tax").alias("min_error"))
    return rounded(A.reduce_by_name(rows, ["loss", "max_reward", "min_error"]))


@catalog.add("""
SELECT round(avg(l_quantity), 6) + 0.0 AS score_mean, max(l_quantity) AS score_max, min(l_quantity) AS score_min, round(avg(l_linenumber), 6) + 0.0 AS length_mean, CAST(max(l_linenumber) AS DOUBLE) AS length_max, CAST(min(l_linenumber) AS DOUBLE) AS length_min,
  round(avg((l_linenumber >= 7)::INT), 6) + 0.0 AS clip_ratio, round(avg((l_linenumber = 0)::INT), 6) + 0.0 AS aborted_ratio, round(1 - var_samp(l_quantity - l_linenumber) / (var_samp(l_quantity) + 1e-5), 6) + 0.0 AS explained_variance FROM lineitem""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("length"), F.col("l_quantity").alias("ret"), F.col("l_linenumber").alias("val"))
    return rounded(A.batch_metrics(rows, "score", "length", 7, "ret", "val"))


@catalog.add("""
SELECT l_linestatus, round(sum(l_tax), 6) + 0.0 AS seconds, CAST(sum(l_linenumber) AS BIGINT) AS tokens, round(1000 * sum(l_tax) / sum(l_linenumber), 6) + 0.0 AS ms_per_token, round(sum(l_linenumber) / (sum(l_tax) * 4), 4) + 0.0 AS throughput FROM lineitem GROUP BY l_linestatus""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    parts = rows.groupBy("l_linestatus").agg(F.sum("l_tax").alias("s"), F.sum("l_linenumber").alias("t"))
    return parts.select("l_linestatus", r6("s").alias("seconds"), F.col("t").alias("tokens"), r6(1000 * F.col("s") / F.col("t")).alias("ms_per_token"), (F.round(F.col("t") / (F.col("s") * 4), 4) + 0.0).alias("throughput"))


@catalog.add("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(value * (pow(i / n, 4) - pow((i - 1) / n, 4))), 6) + 0.0 AS best, round(sum(value * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))), 6) + 0.0 AS worst FROM r GROUP BY event_type""")
def best_of_n_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.best_of_n(table(spark, sf_dir, "events"), "event_type", "value", 4))


@catalog.add("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
d AS (SELECT user_id, i, CAST('0x' || substr(md5('42|bootstrap|' || user_id || '|' || i || '|' || j), 1, 12) AS BIGINT) % n AS place FROM (SELECT DISTINCT user_id, n FROM r), (SELECT unnest(range(1, 101)) AS i), (SELECT unnest(range(1, 5)) AS j)),
m AS (SELECT d.user_id, i, sum(value) / 4 AS mean, max(value) AS top FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place GROUP BY ALL)
SELECT user_id, round(avg(mean), 6) + 0.0 AS mean_mean, round(stddev_pop(mean), 6) + 0.0 AS mean_std, round(avg(top), 6) + 0.0 AS max_mean, round(stddev_pop(top), 6) + 0.0 AS max_std FROM m GROUP BY user_id""")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.bootstrap(table(spark, sf_dir, "events"), "user_id", "value", 100, 4))


@catalog.add("""
WITH p AS (SELECT event_type, user_id, avg(value) AS m, stddev_samp(value) AS s, count(*) AS c FROM events GROUP BY 1, 2)
SELECT event_type, CAST(count(*) AS BIGINT) AS prompts, round(avg(m), 6) + 0.0 AS mean, round(avg(coalesce(s, 0)), 6) + 0.0 AS std_samp, CAST(max(c) AS BIGINT) AS samples FROM p GROUP BY event_type""")
def validation_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.validation(table(spark, sf_dir, "events"), "event_type", "user_id", "value"))


@catalog.add("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f, arg_min(n_chars, doc_id) AS v FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM c)
SELECT source, lang, CAST(n AS BIGINT) AS n, v AS value FROM r WHERE k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(table(spark, sf_dir, "documents"), "source", "lang", "n_chars", "doc_id")


@catalog.add("""
SELECT round(avg(v), 6) + 0.0 AS mean_variance, CAST(count(*) AS BIGINT) AS groups FROM (SELECT user_id, var_pop(value) AS v FROM events GROUP BY user_id)""")
def group_reward_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.mean_group_variance(table(spark, sf_dir, "events"), "user_id", "value"))


@catalog.add("""
WITH s AS (SELECT user_id, round(avg(value), 6) AS score FROM events GROUP BY user_id) SELECT user_id, score FROM s ORDER BY score DESC, user_id LIMIT 1""")
def best_validation_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"))
    return A.best_step(per, "user_id", "score")


@catalog.add("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) + 0.0 AS rho FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@catalog.add("""
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem""")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").drop("p"))


@catalog.add("""
SELECT coalesce(lang, 'Average') AS category, CAST(count(*) AS BIGINT) AS n, round(avg((n_chars > 1000)::INT), 6) + 0.0 AS accuracy FROM documents GROUP BY ROLLUP (lang)""")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.accuracy_by(table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 1000))


@catalog.add("""
SELECT round(avg(p), 6) + 0.0 AS perplexity, CAST(count(*) AS BIGINT) AS sequences FROM (SELECT l_orderkey, exp(avg(l_tax * 10)) AS p FROM lineitem WHERE l_quantity > 5 GROUP BY 1)""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("nll", F.col("l_tax") * 10)
    return rounded(A.perplexity(rows, "l_orderkey", "nll", F.col("l_quantity") > 5))


@catalog.add(f"""
WITH {EVENTS}, t AS (SELECT k % 3 AS p, lead(k % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM ev)
SELECT round(avg((p = l)::INT), 6) + 0.0 AS accuracy, CAST(count(*) AS BIGINT) AS n FROM t WHERE l IS NOT NULL AND l <> 0""")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("c", F.pmod(F.col("k"), F.lit(3)))
    return rounded(A.token_accuracy(rows, "user_id", "event_id", "c", "c", ignore=0))


@catalog.add("""
WITH b AS (SELECT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS BIGINT) % 16 AS b, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(min(n) AS BIGINT) AS "min", CAST(max(n) AS BIGINT) AS "max", round(avg(n), 6) + 0.0 AS mean, round(stddev_pop(n), 6) + 0.0 AS std_pop, round(sum(pow(n - m, 2) / m), 6) + 0.0 AS chi2 FROM b, (SELECT avg(n) AS m FROM b)""")
def bucket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 4), 16, 10).cast("long") % 16
    return rounded(A.bucket_balance(table(spark, sf_dir, "orders"), b, 16).select(F.col("min").cast("long").alias("min"), "max", "mean", "std_pop", "chi2"))


@catalog.add(f"""
WITH {METRICS}, r AS (SELECT l_orderkey, min(pos) AS min_pos, min(ang) AS min_ang, bool_or(pos <= 0.3 + 1e-9 AND ang <= 20 + 1e-9) AS reached, bool_or(flag) AS success FROM m GROUP BY l_orderkey)
SELECT l_orderkey, min_pos, min_ang, reached, coalesce(success, false) AS success, CASE WHEN success AND reached THEN 'reached' WHEN success THEN 'inferred' WHEN reached THEN 'passed' ELSE 'missed' END AS kind FROM r""")
def reach_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reach(metric_rows(spark, sf_dir), "l_orderkey", "pos", "ang", 0.3, 20, "flag").fillna({"success": False})


@catalog.add("""
SELECT lang, source, min(doc_id) AS first_sample, array_to_string(list_sort(list_distinct(list(CAST(n_chars % 7 AS VARCHAR)))), ',') AS sources, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang, source""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("s", (F.col("n_chars") % 7).cast("string"))
    return A.manifest(rows, ["lang", "source"], "doc_id", "s")


@catalog.add("""
SELECT path, round(avg(v), 6) + 0.0 AS mean, CAST(count(v) AS BIGINT) AS n FROM (SELECT 'a.q' AS path, l_quantity AS v FROM lineitem UNION ALL SELECT 'a.t', l_tax FROM lineitem) GROUP BY path""")
def nested_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.create_map(F.lit("a.q"), "l_quantity", F.lit("a.t"), "l_tax").alias("m"))
    return rounded(A.nested_average(rows, "m"))


@catalog.add("""
SELECT event_type, round(avg((value > 20)::INT), 6) + 0.0 AS format_rate FROM events GROUP BY event_type""")
def format_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(A.success_rate(F.col("value") > 20).alias("format_rate")))


@catalog.add("""
SELECT l_orderkey, round(CASE WHEN count(l_extendedprice) <= 1 THEN 0 ELSE avg(l_extendedprice) END, 6) + 0.0 AS mean, round(CASE WHEN count(l_extendedprice) <= 1 THEN 1 ELSE stddev_samp(l_extendedprice) END, 6) + 0.0 AS std_samp, CAST(count(l_extendedprice) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey""")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.group_moments(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice")
    return out.select("l_orderkey", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("std_samp", 6) + 0.0).alias("std_samp"), "n")


@catalog.add("""
SELECT coalesce(source, 'unknown') AS source, round(avg(n_chars), 6) + 0.0 AS mean, CAST(count(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1""")
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.source_scores(table(spark, sf_dir, "documents"), "source", "n_chars")
    return out.select("source", (F.round("mean", 6) + 0.0).alias("mean"), "n")
