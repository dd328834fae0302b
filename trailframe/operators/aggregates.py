"""Evaluation rollups and grouped statistics. Standard deviations say which kind they are."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators.batch import running_total
from trailframe.operators.quantiles import LIMIT, quantiles
from trailframe.operators.sampling import group_rows, order_key

EPS = 1e-9


def success_rate(flag: Column) -> Column:
    """Missing counts as failed; 0 for no rows."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), F.lit(0.0))


def within(pos: Column, ang: Column, max_pos: Column | float, max_ang: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (pos <= lit(max_pos) + EPS) & (ang <= lit(max_ang) + EPS)


def threshold_key(pos: float, ang: float) -> str:
    text = lambda x: (f"{x:g}").replace("-", "neg").replace(".", "p")
    return f"success_{text(pos)}m{text(ang)}degree"


def threshold_rates(df: DataFrame, pos: str, ang: str, thresholds: list[tuple[float, float]]) -> DataFrame:
    """One row per threshold: (key, n, rate), in one pass over the rows."""
    both = F.col(pos).isNotNull() & F.col(ang).isNotNull()
    aggs = []
    for i, (p, a) in enumerate(thresholds):
        aggs += [F.count_if(both).alias(f"n{i}"), F.coalesce(F.avg(F.when(both, within(F.col(pos), F.col(ang), p, a).cast("int"))), F.lit(0.0)).alias(f"r{i}")]
    rows = F.array(*(F.struct(F.lit(threshold_key(p, a)).alias("key"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rate")) for i, (p, a) in enumerate(thresholds)))
    return df.agg(*aggs).select(F.inline(rows))


def by_bucket_and_overall(df: DataFrame, bucket: str, flag: Column) -> DataFrame:
    """Rates per bucket and for `_overall`, as one grouping-sets aggregate."""
    out = df.withColumn("_f", flag).rollup(bucket).agg(F.grouping(bucket).alias("_g"), F.count(F.lit(1)).alias("n"), success_rate(F.col("_f")).alias("rate"))
    return out.select(F.when(F.col("_g") == 1, "_overall").otherwise(F.col(bucket)).alias(bucket), "n", "rate")


def model_score(rates: DataFrame, model: str, parts: list[list[str]]) -> DataFrame:
    """Mean of the available parts, each the mean of its rates, and the rank by falling score."""
    mean = lambda cs: F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0)), sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)))
    names = [f"_p{i}" for i in range(len(parts))]
    out = rates.withColumns({n: mean(cs) for n, cs in zip(names, parts)}).withColumn("score", mean(names)).drop(*names)
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("score"))))


def difficulty(pos: Column, ang: Column) -> Column:
    return F.when(F.sqrt((pos / 0.5) * (pos / 0.5) + (ang / 30.0) * (ang / 30.0)) < 3, "easy").otherwise("hard")


def tri_state_stats(df: DataFrame, flag: str, bucket: str, group: str) -> DataFrame:
    """True rate over true and false, missing rate over all: overall, by bucket and by group, in one aggregate."""
    c = F.col(flag)
    known = F.count_if(c.isNotNull())
    out = df.cube(bucket, group).agg(
        F.grouping(bucket).alias("gb"), F.grouping(group).alias("gg"), F.count(F.lit(1)).alias("n"), F.count_if(c).alias("n_true"), F.count_if(~c).alias("n_false"),
        F.count_if(c.isNull()).alias("n_missing"), F.try_divide(F.count_if(c).cast("double"), known).alias("true_rate"), (F.count_if(c.isNull()) / F.count(F.lit(1))).alias("missing_rate"),
    )
    kept = out.where("gb + gg >= 1")
    level = F.when(F.col("gb") + F.col("gg") == 2, "overall").when(F.col("gb") == 0, "bucket").otherwise("group")
    return kept.select(level.alias("level"), F.coalesce(F.col(bucket).cast("string"), F.col(group).cast("string")).alias("value"), "n", "n_true", "n_false", "n_missing", "true_rate", "missing_rate")


def flag_rates(df: DataFrame, flags: list[str], group: str) -> DataFrame:
    """Rates of many flags overall and per group: (flag, value, n, rate)."""
    long = df.unpivot([group], flags, "flag", "on")
    out = long.cube("flag", group).agg(F.grouping("flag").alias("gf"), F.grouping(group).alias("gg"), F.count("on").alias("n"), F.avg(F.col("on").cast("int")).alias("rate")).where("gf = 0")
    return out.select("flag", F.when(F.col("gg") == 1, "overall").otherwise(F.col(group).cast("string")).alias("value"), "n", "rate")


def episode_summary(df: DataFrame, tag: str, flag: str, reward: str, turns: str, error: str) -> DataFrame:
    """Counts, rates, means and sorted distinct errors, for all and per tag."""
    out = df.rollup(tag).agg(
        F.grouping(tag).alias("_g"), F.count(F.lit(1)).alias("n"), success_rate(F.col(flag)).alias("success_rate"), F.avg(reward).alias("mean_reward"), F.avg(turns).alias("mean_turns"),
        F.sort_array(F.collect_set(error)).alias("errors"),
    )
    return out.select(F.when(F.col("_g") == 1, "_all").otherwise(F.col(tag)).alias("tag"), "n", "success_rate", "mean_reward", "mean_turns", "errors")


def histogram(df: DataFrame, items: Column) -> DataFrame:
    """Counts and shares of an array's items, most frequent first."""
    counts = df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("_t")), F.lit(True)).select("item", "n", F.bround(F.col("n") / F.col("_t"), 4).alias("ratio"))


def length_cdf(df: DataFrame, length: Column, interval: int) -> DataFrame:
    """Counts by interval with running count and percentage; the window sees one row per interval."""
    counts = df.groupBy((F.floor(length / interval) * interval).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("cum", F.sum("n").over(w))
    return out.join(counts.agg(F.sum("n").alias("_t")), F.lit(True)).select("low", "n", "cum", (100.0 * F.col("cum") / F.col("_t")).alias("pct"))


def five_numbers(c: str, digits: int = 4) -> list[Column]:
    """Mean, population deviation, least, greatest and count, rounded; zeros for no rows."""
    z = lambda x, n: F.coalesce(F.bround(x, digits), F.lit(0.0)).alias(n)
    return [z(F.avg(c), "mean"), z(F.stddev_pop(c), "std_pop"), z(F.min(c).cast("double"), "min"), z(F.max(c).cast("double"), "max"), F.count(c).alias("n")]


def per_turn(df: DataFrame, traj: str, turn: str, value: str) -> DataFrame:
    """Statistics of a value and of its first difference at each turn, over the trajectories that have it."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(traj).orderBy(turn))
    rows = df.withColumn("_d", step)
    return rows.groupBy(turn).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.avg("_d").alias("mean_step"))


def latencies(df: DataFrame, by: list[str], c: str, limit: int = LIMIT) -> DataFrame:
    """Mean, median and high quantiles by linear interpolation for each group; large groups by counting rounds."""
    means = df.groupBy(*by).agg(F.avg(c).alias("mean"))
    high = quantiles(df, by, c, {"median": 0.5, "p95": 0.95, "p99": 0.99}, limit)
    renamed = high.select(*(F.col(b).alias(f"_{b}") for b in by), "median", "p95", "p99")
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by))
    return means.join(renamed, same).select(*by, "mean", "median", "p95", "p99")


def reduce_by_name(df: DataFrame, columns: list[str]) -> DataFrame:
    """Maximum of names with max, minimum of names with min, else mean."""
    rule = lambda c: F.max if "max" in c else F.min if "min" in c else F.avg
    return df.agg(*(rule(c)(c).cast("double").alias(c) for c in columns))


def batch_metrics(df: DataFrame, score: str, length: str, most: int, returns: str | None = None, values: str | None = None) -> DataFrame:
    """Score and length extremes, clip ratio, aborted ratio and explained variance."""
    aggs = [f(c).cast("double").alias(f"{c}_{n}") for c in (score, length) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    aggs += [F.avg((F.col(length) >= most).cast("int")).alias("clip_ratio"), F.avg((F.col(length) == 0).cast("int")).alias("aborted_ratio")]
    if returns and values:
        aggs.append((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))
    return df.agg(*aggs)


def throughput(df: DataFrame, seconds: str, tokens: str, devices: int) -> DataFrame:
    return df.agg(F.sum(seconds).alias("seconds"), F.sum(tokens).alias("tokens"), (1000 * F.sum(seconds) / F.sum(tokens)).alias("ms_per_token"), (F.sum(tokens) / (F.sum(seconds) * devices)).alias("throughput"))


def bootstrap(df: DataFrame, key: str, value: str, draws: int, size: int, seed: int = 42) -> DataFrame:
    """Resamples with replacement of `size` values per key: mean and deviation of their means and of their maxima.

    Draw j of resample i takes the key's value of a hashed rank; values are numbered by rank and met by a join, so a key's
    values are never in one place.
    """
    rows = group_rows(df.select(key, value).where(F.col(value).isNotNull()), key, [value]).select(F.struct(key).alias("_g"), F.col("_r").alias("_place"), value)
    sizes = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    upto = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    cells = sizes.withColumn("i", upto(draws)).withColumn("j", upto(size))
    place = F.pmod(F.conv(F.substring(order_key("bootstrap", key, "i", "j", seed=seed), 1, 12), 16, 10).cast("long"), "_n")
    drawn = cells.select(F.struct(key).alias("_g"), "i", place.alias("_place")).join(rows, ["_g", "_place"])
    means = drawn.groupBy("_g", "i").agg((F.sum(value) / size).alias("mean"), F.max(value).alias("top"))
    return means.groupBy("_g").agg(F.avg("mean").alias("mean_mean"), F.stddev_pop("mean").alias("mean_std"), F.avg("top").alias("max_mean"), F.stddev_pop("top").alias("max_std")).select(F.col("_g")[key].alias(key), "mean_mean", "mean_std", "max_mean", "max_std")


def best_of_n(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Expected maximum and minimum of n draws with replacement, in closed form over order statistics."""
    w = Window.partitionBy(key)
    rows = df.select(key, value, F.row_number().over(w.orderBy(value)).alias("i"), F.count(F.lit(1)).over(w).alias("N"))
    i, size = F.col("i"), F.col("N")
    up = F.pow(i / size, F.lit(n)) - F.pow((i - 1) / size, F.lit(n))
    down = F.pow((size - i + 1) / size, F.lit(n)) - F.pow((size - i) / size, F.lit(n))
    return rows.groupBy(key).agg(F.sum(F.col(value) * up).alias("best"), F.sum(F.col(value) * down).alias("worst"))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample deviation and count of each group; a single row counts against mean 0 and deviation 1."""
    n = F.count(value)
    return df.groupBy(group).agg(F.when(n <= 1, 0.0).otherwise(F.avg(value)).alias("mean"), F.when(n <= 1, 1.0).otherwise(F.stddev_samp(value)).alias("std_samp"), n.alias("n"))


def source_scores(df: DataFrame, source: str, score: str) -> DataFrame:
    """Mean score of each data source; rows without a source are one of their own, `unknown`."""
    return df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source")).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """Mean and deviation per prompt, then their means per source."""
    prompts = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(F.lit(1)).alias("c"))
    return prompts.groupBy(source).agg(F.count(F.lit(1)).alias("prompts"), F.avg("m").alias("mean"), F.avg(F.coalesce("s", F.lit(0.0))).alias("std_samp"), F.max("c").alias("samples"))


def majority(df: DataFrame, group: str, label: str, value: str, pos: str) -> DataFrame:
    """The most frequent label of each group (of equals the first seen) and its first value."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"), F.min_by(value, pos).alias("value"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "first")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "first")


def mean_group_variance(df: DataFrame, group: str, value: str, sample: bool = False) -> DataFrame:
    var = F.coalesce(F.var_samp(value), F.lit(0.0)) if sample else F.var_pop(value)
    return df.groupBy(group).agg(var.alias("v")).agg(F.avg("v").alias("mean_variance"), F.count(F.lit(1)).alias("groups"))


def best_step(df: DataFrame, step: str, score: str) -> DataFrame:
    """The earliest step with the highest score."""
    return df.agg(F.min_by(F.struct(step, score), F.struct((-F.col(score)).alias("a"), F.col(step).alias("b"))).alias("b")).select("b.*")


def spearman(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation; 0 for fewer rows than `least` or a constant side.

    Average ranks come from running counts over the distinct values.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = rows
    for c in (x, y):
        n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        ranked = running_total(n, [c], F.col("_n"), "_b")
        out = out.join(ranked.select(c, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(f"_r{c}")), c)
    a, b = f"_r{x}", f"_r{y}"
    got = out.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("c"))
    return got.select("n", F.when((F.col("n") < least) | (F.col("sa") == 0) | (F.col("sb") == 0), 0.0).otherwise(F.try_divide("c", F.col("sa") * F.col("sb"))).alias("rho"))


def _p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by the incomplete beta function's integral."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    angle = np.linspace(math.atan(math.sqrt(t2 / df)), math.pi / 2, 20001)
    density = np.cos(angle) ** (df - 1)
    area = np.trapezoid(density, angle)
    return float(min(1.0, 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)))


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_p_value(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of rows where both are present, null for fewer than two or a constant side, with its p-value."""
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(x).alias("sa"), F.stddev_pop(y).alias("sb"), F.covar_pop(x, y).alias("c"))
    out = got.select("n", F.when(F.col("n") >= 2, F.try_divide("c", F.col("sa") * F.col("sb"))).alias("r"))
    return out.withColumn("p", p_value("r", "n"))


def accuracy_by(df: DataFrame, category: str, correct: Column) -> DataFrame:
    out = df.withColumn("_c", correct.cast("int")).rollup(category).agg(F.grouping(category).alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("_c").alias("accuracy"))
    return out.select(F.when(F.col("_g") == 1, "Average").otherwise(F.col(category)).alias("category"), "n", "accuracy")


def perplexity(df: DataFrame, seq: str, nll: str, mask: Column) -> DataFrame:
    per = df.where(mask).groupBy(seq).agg(F.exp(F.avg(nll)).alias("ppl"))
    return per.agg(F.avg("ppl").alias("perplexity"), F.count(F.lit(1)).alias("sequences"))


def token_accuracy(df: DataFrame, seq: str, pos: str, pred: str, label: str, ignore: int = -100) -> DataFrame:
    """Share of tokens whose prediction equals the next label, ignored labels aside."""
    after = F.lead(label).over(Window.partitionBy(seq).orderBy(pos))
    rows = df.select(F.col(pred).alias("p"), after.alias("l")).where(F.col("l").isNotNull() & (F.col("l") != ignore))
    return rows.agg(F.avg((F.col("p") == F.col("l")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def bucket_balance(df: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """Spread of rows over numbered buckets, empty ones included, with the chi-square statistic."""
    per = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    got = per.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.count(F.lit(1)).alias("full"))
    mean = F.col("t") / F.lit(buckets)
    return got.select(F.when(F.col("full") < buckets, 0).otherwise(F.col("lo")).alias("min"), F.col("hi").alias("max"), mean.alias("mean"), F.sqrt(F.col("q") / F.lit(buckets) - mean * mean).alias("std_pop"), (F.col("q") / mean - F.col("t")).alias("chi2"))


def reach(df: DataFrame, key: str, pos: str, ang: str, max_pos: float, max_ang: float, flag: str) -> DataFrame:
    """Least errors over a trajectory's poses and whether one pose meets both bounds; successes reached or inferred."""
    per = df.groupBy(key).agg(F.min(pos).alias("min_pos"), F.min(ang).alias("min_ang"), F.bool_or(within(F.col(pos), F.col(ang), max_pos, max_ang)).alias("reached"), F.bool_or(flag).alias("success"))
    kind = F.when(F.col("success") & F.col("reached"), "reached").when(F.col("success"), "inferred").when(F.col("reached"), "passed").otherwise("missed")
    return per.withColumn("kind", kind)


def manifest(df: DataFrame, keys: list[str], sample: str, source: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(sample).alias("first_sample"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


def nested_average(df: DataFrame, maps: str) -> DataFrame:
    """Elementwise mean over rows of a map of paths to numbers."""
    return df.select(F.explode(maps).alias("path", "value")).groupBy("path").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


