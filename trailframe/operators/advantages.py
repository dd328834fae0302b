"""Group-relative advantages, masked statistics, importance weights and divergence estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators.batch import numbered, running_total
from trailframe.operators.quantiles import LIMIT, choose
from trailframe.operators.sampling import SEED, order_key
from trailframe.registry import Registry

EPS = 1e-6
advantages = Registry("advantage")


def _group(group: str):
    return Window.partitionBy(group)


@advantages.register("grpo")
def grpo(r: str, group: str, scale: bool = True) -> Column:
    """(r - mean) / (sample deviation + eps); a single row counts against mean 0 and deviation 1."""
    w = _group(group)
    one = F.count(F.lit(1)).over(w) <= 1
    mean = F.when(one, 0.0).otherwise(F.avg(r).over(w))
    std = F.when(one, 1.0).otherwise(F.stddev_samp(r).over(w))
    return (F.col(r) - mean) / (std + EPS) if scale else F.col(r) - mean


@advantages.register("rloo")
def rloo(r: str, group: str, single: bool = True) -> Column:
    """Against the mean of the others; a single row keeps its reward, or gets 0."""
    w = _group(group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n <= 1, F.col(r) if single else F.lit(0.0)).otherwise((F.col(r) - F.avg(r).over(w)) * n / F.nullif(n - 1, F.lit(0)))


@advantages.register("opo")
def opo(r: str, group: str, length: str) -> Column:
    w = _group(group)
    return F.col(r) - F.sum(F.col(length) * F.col(r)).over(w) / F.sum(length).over(w)


@advantages.register("passk")
def best_only(r: str, group: str, pos: str, scale: bool = True) -> Column:
    """The group's best row gets its lead over the second (by the deviation); others 0; a single row is an error."""
    w = _group(group)
    order = w.orderBy(F.desc(r), pos)
    second = F.lead(r).over(order)
    lead = F.col(r) - second
    if scale:
        lead = lead / (F.stddev_samp(r).over(w) + EPS)
    few = F.raise_error(F.lit("a group needs two rows")).cast("double")
    return F.when(F.count(F.lit(1)).over(w) < 2, few).when(F.row_number().over(order) == 1, lead).otherwise(0.0)


def best_leads(df: DataFrame, r: str, group: str, pos: str, scale: bool = True, out: str = "adv") -> DataFrame:
    """As `best_only`, for groups of any size: two rows of a group leave a task, and the lead is joined back to the best one's group."""
    few = F.raise_error(F.lit("a group needs two rows")).cast("double")
    src = df.withColumn("_g", F.struct(group))
    two = src.select("_g", F.col(pos).alias("_best"), F.col(r).alias("_v"), F.row_number().over(_group("_g").orderBy(F.desc(r), pos)).alias("_k")).where("_k <= 2")
    ends = two.groupBy("_g").agg(F.max(F.when(F.col("_k") == 1, F.col("_best"))).alias("_best"), (F.max(F.when(F.col("_k") == 1, F.col("_v"))) - F.max(F.when(F.col("_k") == 2, F.col("_v")))).alias("_lead"))
    whole = src.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(r).alias("_s"))
    lead = F.col("_lead") / (F.col("_s") + EPS) if scale else F.col("_lead")
    rows = src.join(ends.join(whole, "_g"), "_g")
    adv = F.when(F.col("_n") < 2, few).when(F.col(pos) == F.col("_best"), lead).otherwise(0.0)
    return rows.withColumn(out, adv).drop("_g", "_best", "_lead", "_n", "_s")


def gpg(df: DataFrame, r: str, group: str, norm: float = 1.0) -> DataFrame:
    """alpha * (r - mean) / norm with alpha the batch size by the count of non-zero rewards."""
    total = df.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col(r) != 0))).alias("_alpha"))
    return df.join(total, F.lit(True)).withColumn("adv", F.col("_alpha") * (F.col(r) - F.avg(r).over(_group(group))) / norm).drop("_alpha")


def masked_statistics(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Masked sum, mean (+1e-8) and variance with Bessel's correction, in one aggregate."""
    on = F.when(F.col(mask), F.col(value))
    n = F.count(on)
    return df.agg(n.alias("n"), F.coalesce(F.sum(on), F.lit(0.0)).alias("sum"), (F.coalesce(F.sum(on), F.lit(0.0)) / (n + 1e-8)).alias("mean"), F.var_samp(on).alias("var"))


def whiten(df: DataFrame, value: str, mask: str, out: str = "white") -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with masked statistics."""
    s = masked_statistics(df, value, mask).select(F.col("mean").alias("_m"), F.col("var").alias("_v"))
    return df.join(s, F.lit(True)).withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_m", "_v")


def baseline_whitened(df: DataFrame, r: str, group: str, mask: str) -> DataFrame:
    """Group-mean baseline, then whitening over the batch."""
    return whiten(df.withColumn("_b", F.col(r) - F.avg(r).over(_group(group))), "_b", mask, "adv").drop("_b")


def returns_to_go(r: str, seq: str, pos: str, baseline: Column | None = None) -> Column:
    w = Window.partitionBy(seq).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(r).over(w)
    return total if baseline is None else total - baseline


def loss_modes(df: DataFrame, seq: str, loss: str, mask: Column, norm: float) -> DataFrame:
    """Token mean, and means over sequences of token sums, token means and normalised sums."""
    rows = df.where(mask)
    per = rows.groupBy(seq).agg(F.sum(loss).alias("s"), F.avg(loss).alias("m"), F.count(F.lit(1)).alias("c"))
    return per.agg((F.sum("s") / F.sum("c")).alias("token_mean"), F.avg("s").alias("seq_mean_token_sum"), F.avg("m").alias("seq_mean_token_mean"), F.avg(F.col("s") / norm).alias("seq_mean_token_sum_norm"))


def kl_estimates(logp: Column, ref: Column) -> dict[str, Column]:
    """Estimators k1, abs, k2 and the low-variance k3 with its clamps."""
    d = logp - ref
    back = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
    k3 = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(back) - back - 1))
    return {"k1": d, "abs": F.abs(d), "k2": 0.5 * d * d, "k3": k3}


def importance(df: DataFrame, seq: str, log_ratio: str, cap: float, level: str = "sequence", normalise: bool = False) -> DataFrame:
    """exp of clamped log ratios per token, or of their sum per sequence, truncated; optionally scaled to mean 1."""
    x = F.col(log_ratio) if level == "token" else F.sum(log_ratio).over(Window.partitionBy(seq))
    out = df.withColumn("weight", F.least(F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))), F.lit(cap)))
    if normalise:
        out = out.join(out.agg(F.avg("weight").alias("_m")), F.lit(True)).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m")
    return out


def rejection(df: DataFrame, seq: str, log_ratio: str, high: float, low: float | None = None, level: str = "token") -> DataFrame:
    """`keep` where the weight lies within [low, high], low 1 / high unless given; geometric takes the mean log ratio."""
    w = Window.partitionBy(seq)
    x = {"token": F.col(log_ratio), "sequence": F.sum(log_ratio).over(w), "geometric": F.avg(log_ratio).over(w)}[level]
    return df.withColumn("keep", F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))).between(1 / high if low is None else low, high))


def weight_diagnostics(df: DataFrame, weight: str, low: float, high: float) -> DataFrame:
    c = F.col(weight)
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std_samp"), F.avg((c > high).cast("int")).alias("share_high"), F.avg((c < low).cast("int")).alias("share_low"), (F.sum(c) * F.sum(c) / (F.sum(c * c) * F.count(c))).alias("ess"))


def top_groups(df: DataFrame, group: str, r: str, share: float) -> DataFrame:
    """Rows of the ceil(share * groups) groups with the highest reward variance, one at least."""
    var = df.groupBy(group).agg(F.var_pop(r).alias("_v"))
    n = var.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(share))).alias("_k"))
    ranked = numbered(var, [F.desc("_v"), group], "_r")
    return df.join(ranked.join(n, F.col("_r") < F.col("_k")).select(group), group, "left_semi")


def top_p_groups(df: DataFrame, group: str, r: str, p: float) -> DataFrame:
    """Groups by falling variance until p of the total variance is reached; all if there is none. Adds `scale`."""
    var = df.groupBy(group).agg(F.var_pop(r).alias("_v"))
    total = var.agg(F.sum("_v").alias("_t"))
    taken = running_total(var, [F.desc("_v"), group], F.col("_v"), "_b").join(total, (F.col("_t") <= 0) | (F.col("_b") < F.col("_t") * p))
    kept, groups = taken.agg(F.count(F.lit(1)).alias("_k")), var.agg(F.count(F.lit(1)).alias("_g"))
    factor = kept.join(groups, F.lit(True)).select(F.sqrt(F.col("_k") / F.col("_g")).alias("scale"))
    return df.join(taken.select(group), group, "left_semi").join(factor, F.lit(True))


def drop_flat_groups(df: DataFrame, group: str, r: str) -> DataFrame:
    """Without groups of several rows that all have one reward."""
    w = _group(group)
    return df.withColumn("_k", (F.stddev_pop(r).over(w) > 0) | (F.count(F.lit(1)).over(w) == 1)).where("_k").drop("_k")


losses = Registry("policy loss", replace=True)


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


@losses.register("vanilla")
def clipped_loss(logp: Column, old: Column, adv: Column, eps: float = 0.2, dual: float = 3.0) -> Column:
    """Token loss with the ratio clipped, and a floor for negative advantages."""
    ratio = F.exp(_clip(logp - old, -20.0, 20.0))
    worst = F.greatest(-adv * ratio, -adv * _clip(ratio, 1 - eps, 1 + eps))
    return F.when(adv < 0, F.least(worst, -adv * dual)).otherwise(worst)


@losses.register("gspo")
def sequence_ratio_loss(logp: Column, old: Column, adv: Column, seq: str, low: float = 3e-4, high: float = 4e-4) -> Column:
    """Token loss with the sequence's mean log ratio in place of the token's."""
    ratio = F.exp(_clip(F.avg(logp - old).over(_group(seq)), -20.0, 10.0))
    return F.greatest(-adv * ratio, -adv * _clip(ratio, 1 - low, 1 + high))


@losses.register("gpg")
def plain_loss(logp: Column, adv: Column) -> Column:
    return -logp * adv


@losses.register("geo_mean")
def geometric_loss(logp: Column, old: Column, adv: Column, seq: str, low: float = 0.4, high: float = 0.4) -> Column:
    """Sequence loss: the geometric mean of token ratios, each clipped on the side its advantage allows."""
    d = logp - old
    sign = F.signum(adv)
    kept = sign * F.least(sign * d, sign * _clip(d, -low, high))
    return -F.avg(adv).over(_group(seq)) * F.exp(F.avg(kept).over(_group(seq)))


def _covariance(df: DataFrame, logp: Column, adv: Column, mask: Column) -> tuple[DataFrame, int]:
    """Adds each token's covariance term `_cov` (null outside the mask); and the number of tokens in the mask."""
    means = df.where(mask).agg(F.avg(adv).alias("a"), F.avg(logp).alias("l"), F.count(F.lit(1)).alias("n")).first()
    return df.withColumn("_cov", F.when(mask, (adv - F.lit(means["a"])) * (logp - F.lit(means["l"])))), means["n"]


@losses.register("clip_cov")
def clip_cov_losses(df: DataFrame, keys: list[str], logp: Column, old: Column, adv: Column, mask: Column, ratio: float = 2e-4, low: float = 1.0, high: float = 5.0, eps: float = 0.2, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """Adds `loss` and `dropped`: a share of the tokens whose covariance lies between the bounds, and that clipping leaves alone, is left out.

    Of these tokens max(1, share of all in the mask) are drawn, by the order of a hash of their keys; tokens outside the mask have loss 0.
    """
    r = F.exp(logp - old)
    plain, clipped = -adv * r, -adv * _clip(r, 1 - eps, 1 + eps)
    rows, n = _covariance(df, logp, adv, mask)
    fit = mask & (F.col("_cov") > low) & (F.col("_cov") < high) & ~(clipped > plain)
    draw = F.conv(F.substring(order_key("clip_cov", *keys, seed=seed), 1, 12), 16, 10).cast("double")  # 48 bits, exact in a double
    out = choose(rows, F.when(fit, draw), max(1, int(ratio * n)), keys, largest=False, limit=limit)
    loss = F.when(mask & ~F.col("chosen"), F.greatest(plain, clipped)).otherwise(0.0)
    return out.withColumn("loss", loss).withColumnRenamed("chosen", "dropped").drop("_cov")


@losses.register("kl_cov")
def kl_cov_losses(df: DataFrame, keys: list[str], logp: Column, old: Column, adv: Column, mask: Column, ratio: float = 2e-4, coef: float = 1.0, limit: int = LIMIT) -> DataFrame:
    """Adds `loss` and `penalised`: the max(1, share of all) tokens of the mask with the largest covariance bear a penalty on |log ratio|; ties by keys."""
    rows, n = _covariance(df, logp, adv, mask)
    out = choose(rows, F.col("_cov"), max(1, int(ratio * n)) if n else 0, keys, limit=limit)
    penalty = F.when(F.col("chosen"), coef * F.abs(logp - old)).otherwise(0.0)
    return out.withColumn("loss", F.when(mask, -adv * F.exp(logp - old) + penalty).otherwise(0.0)).withColumnRenamed("chosen", "penalised").drop("_cov")


def value_loss(value: Column, old: Column, ret: Column, eps: float) -> Column:
    """Half the larger squared error of the value and of its clipped form."""
    held = old + _clip(value - old, -eps, eps)
    return 0.5 * F.greatest((value - ret) * (value - ret), (held - ret) * (held - ret))


class AdaptiveKl:
    """A coefficient that follows a target by a proportional rule over so many samples."""

    def __init__(self, start: float, target: float, horizon: int) -> None:
        self.value, self.target, self.horizon = start, target, horizon

    def update(self, kl: float, samples: int) -> float:
        error = max(-0.2, min(0.2, kl / self.target - 1))
        self.value *= 1 + error * samples / self.horizon
        return self.value
