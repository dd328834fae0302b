"""Deterministic sampling, splitting and mixing: every choice is an order of md5(seed|purpose|key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators.batch import numbered, running_total
from trailframe.storage import cut

SEED = 42


def order_key(purpose: str, *keys: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def uniform(purpose: str, *keys: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(order_key(purpose, *keys, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def take(df: DataFrame, key: str, n: int, purpose: str = "take", seed: int = SEED) -> DataFrame:
    """n rows in hashed order: a top-k, without a sort of all rows."""
    return df.withColumn("_h", order_key(purpose, key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def take_per_group(df: DataFrame, group: str, key: str, n: int, purpose: str = "take", seed: int = SEED) -> DataFrame:
    """n rows of each group in hashed order; Spark limits each group before and after the exchange, so n rows of a group leave a task."""
    w = Window.partitionBy(group).orderBy("_h", key)
    return df.withColumn("_h", order_key(purpose, key, seed=seed)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def quotas(shares: list[float], total: Column) -> list[Column]:
    """Largest remainder: whole parts, then one more to the largest remainders, ties by index."""
    exact = [total * s / sum(shares) for s in shares]
    floor = [F.floor(x + 1e-9) for x in exact]
    left = total - sum(floor, F.lit(0))
    rank = []
    for i in range(len(shares)):
        ri = exact[i] - floor[i]
        ahead = sum((F.when((exact[j] - floor[j] > ri + 1e-9) | (F.lit(j < i) & (F.abs(exact[j] - floor[j] - ri) <= 1e-9)), 1).otherwise(0) for j in range(len(shares)) if j != i), F.lit(0))
        rank.append(ahead)
    return [(f + F.when(r < left, 1).otherwise(0)).cast("long") for f, r in zip(floor, rank)]


def group_split(df: DataFrame, group: str, names: list[str], shares: list[float], seed: int = SEED) -> DataFrame:
    """Rows with their split; whole groups, counted by largest remainder, in hashed order."""
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("_t"))
    ranked = numbered(groups.withColumn("_h", order_key("split", group, seed=seed)), ["_h", group], "_r").join(total, F.lit(True))
    bounds, acc = F.when(F.lit(False), ""), F.lit(0)
    for name, q in zip(names, quotas(shares, F.col("_t"))):
        acc = acc + q
        bounds = bounds.when(F.col("_r") < acc, name)
    return df.join(ranked.select(group, bounds.alias("split")), group)


def row_split(df: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """train / validation by the hashed order's share of rows."""
    return df.withColumn("split", F.when(uniform("rows", key, seed=seed) < share, "train").otherwise("validation"))


def resampled(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n draws with replacement: draw i takes the row at its hashed place (rows are numbered per key order)."""
    rows = numbered(df, [key], "_n")
    count = df.agg(F.count(F.lit(1)).alias("_t"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").join(count, F.lit(True))
    place = F.floor(uniform("resample", "draw", seed=seed) * F.col("_t")).cast("long")
    return draws.withColumn("_n", place).join(rows, "_n").drop("_n", "_t")


def draw_weights(df: DataFrame, score: str, how: str = "pow", power: float = 2.0, out: str = "weight") -> DataFrame:
    """Adds a row's weight in a resampling by its score, at least 1e-8: pow |score|^power; max_min 1 at both extremes, else 0; max_random 0.4 at the maximum, else 0.1."""
    s = F.col(score).cast("double")
    if how == "pow":
        return df.withColumn(out, F.pow(F.abs(s), F.lit(power)) + 1e-8)
    ends = df.agg(F.min(s).alias("_min"), F.max(s).alias("_max"))
    if how == "max_min":
        weight = F.when((s == F.col("_max")) | (s == F.col("_min")), 1.0).otherwise(0.0)
    elif how == "max_random":
        weight = F.when(s == F.col("_max"), 0.4).otherwise(0.1)
    else:
        raise ValueError(how)
    return df.join(ends, F.lit(True)).withColumn(out, weight + 1e-8).drop("_min", "_max")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int | None = None, seed: int = SEED) -> DataFrame:
    """n draws (as many as rows, if not given) in proportion to a weight.

    Weights are counted in 2^-50 of their sum, one unit at least, so that spans meet without gaps and each
    draw falls into one. Spans and draws are dealt by place into written ranges; a draw takes the last span
    that starts at or before it, and one span per range reaches the driver for the draws at the next one's start.
    """
    spark = df.sparkSession
    n = df.count() if n is None else n
    w = F.col(weight).cast("double")
    total = df.where(w > 0).agg(F.sum(w).alias("_t"))
    units = F.greatest(F.lit(1).cast("long"), F.floor(w / F.col("_t") * float(1 << 50)).cast("long"))
    spans = running_total(df.where(w > 0).join(total, F.lit(True)).withColumn("_w", units).drop("_t"), [key], F.col("_w"), "_at")
    size = spans.agg(F.sum("_w").alias("s")).first()["s"]
    if not size:
        return df.select(F.lit(0).cast("long").alias("draw"), "*").where("false")
    u = F.conv(F.substring(order_key("draw", "draw", seed=seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("_at", F.least(F.lit(size - 1), F.floor(u * size).cast("long")))
    starts = spans.select("_at", F.lit(None).cast("long").alias("draw"), F.struct(*df.columns).alias("_row"))
    marks = starts.unionByName(draws, allowMissingColumns=True).withColumn("_k", F.col("draw").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(spark, marks.repartitionByRange(parts, "_at", "_k").withColumn("_p", F.spark_partition_id()), "draws")
    ends, carried, last = {r["_p"]: r["r"] for r in dealt.groupBy("_p").agg(F.max_by("_row", F.when(~F.col("_k"), F.col("_at"))).alias("r")).collect()}, [], None
    for p in sorted(ends):
        carried.append((p, last))
        last = ends[p] or last
    before = spark.createDataFrame(carried, T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_before", dealt.schema["_row"].dataType)]))
    near = F.last("_row", ignorenulls=True).over(Window.partitionBy("_p").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_near", near).where("_k").join(before, "_p").select("draw", F.coalesce("_near", "_before").alias("_row")).select("draw", "_row.*")


def weighted_mix(df: DataFrame, source: str, key: str, weights: dict[str, float], seed: int = SEED) -> DataFrame:
    """Each source `weight` times over: whole copies and a hashed share of the rest."""
    w = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col(source))
    whole = F.floor(w)
    n = (whole + F.when(uniform("mix", key, seed=seed) < w - whole, 1).otherwise(0)).cast("int")
    return df.withColumn("_n", F.coalesce(n, F.lit(1))).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


#: Rows of a group up to which a window numbers it; beyond, all rows are numbered in written ranges.
GROUP_ROWS = 1_000_000


def group_rows(df: DataFrame, group: str, order: list, row: str = "_r", size: str = "_n", places: bool = False, local: int | None = None) -> DataFrame:
    """Numbers a group's rows from 0 in an order and adds the group's size; with `places` also the row's and its group's first place in the whole order (`_at`, `_first`).

    If some group has more than `local` rows, or places are wanted, all rows are numbered in range partitions by group and
    order, so that a large group is many tasks' work; a group's first place is one aggregate. A null group is a group.
    """
    keyed = df.withColumn("_g", F.struct(group))
    if not places and keyed.groupBy("_g").count().where(F.col("count") > (GROUP_ROWS if local is None else local)).isEmpty():
        w = Window.partitionBy("_g")
        return keyed.withColumn(row, (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn(size, F.count(F.lit(1)).over(w)).drop("_g")
    rows = numbered(keyed, ["_g", *order], "_at")
    groups = rows.groupBy("_g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias(size))
    out = rows.join(groups, "_g").withColumn(row, F.col("_at") - F.col("_first")).drop("_g")
    return out if places else out.drop("_at", "_first")


def interleaved(df: DataFrame, source: str, key: str, seed: int = SEED, mode: str = "under") -> DataFrame:
    """Sources in turn; under: until the shortest ends, once: until all have ended, over: shorter ones again."""
    rows = group_rows(df.withColumn("_h", order_key("interleave", key, seed=seed)), source, ["_h", key]).withColumn("round", F.col("_r") + 1)
    ends = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    rows = rows.join(ends, F.lit(True))
    if mode == "under":
        rows = rows.where("round <= _lo")
    elif mode == "over":
        rows = rows.withColumn("round", F.explode(F.sequence(F.col("round"), F.col("_hi"), F.col("_n"))))
    elif mode != "once":
        raise ValueError(mode)
    return rows.drop("_h", "_lo", "_hi", "_r", "_n")


def ratio_quotas(ratio: list[int], total: int, available: list[int]) -> list[int]:
    """Quotas by ratio, the rounding to the first allowed class; what a class lacks goes to later, then earlier ones.

    A zero in the ratio excludes its class.
    """
    if not sum(ratio):
        return [0] * len(ratio)
    want = [total * r // sum(ratio) for r in ratio]
    want[next(i for i, r in enumerate(ratio) if r)] += total - sum(want)
    got = [min(w, a) for w, a in zip(want, available)]
    left = 0
    for i in range(len(ratio)):
        left += want[i] - got[i]
        if ratio[i]:
            more = min(left, available[i] - got[i])
            got[i], left = got[i] + more, left - more
    for i in reversed(range(len(ratio))):
        if ratio[i]:
            more = min(left, available[i] - got[i])
            got[i], left = got[i] + more, left - more
    return got


def _spilled(want: list[Column], have: list[Column], allowed: list[int]) -> list[Column]:
    """Quotas within what a class has; a lack goes to the next allowed classes, what is left then to the earlier ones."""
    zero = F.lit(0).cast("long")
    got, left = [zero] * len(want), zero
    for i in allowed:
        due = want[i] + left
        got[i], left = F.least(have[i], due), F.greatest(due - have[i], zero)
    for i in reversed(allowed):
        more = F.least(have[i] - got[i], left)
        got[i], left = got[i] + more, left - more
    return got


def ratio_rows(df: DataFrame, group: str, cls: str, key: str, ratio: dict[str, int], total: int, seed: int = SEED) -> DataFrame:
    """Of each group `total` rows, its classes by ratio, in hashed order: what `ratio_quotas` allots, taken from the rows.

    A class with ratio 0, or none, is left out even if others lack rows. Quotas are one row of sums per group; rows are
    numbered in range partitions, so a large group is many tasks' work.
    """
    names = list(ratio)
    allowed = [i for i, c in enumerate(names) if ratio[c]]
    if not allowed:
        return df.where("false")
    want = [total * ratio[c] // sum(ratio.values()) for c in names]
    want[allowed[0]] += total - sum(want)
    fit = df.where(F.col(cls).isin([names[i] for i in allowed])).withColumn("_gc", F.struct(group, cls)).withColumn("_h", order_key("ratio", key, seed=seed))
    have = [F.count_if(F.col(cls) == c) for c in names]
    quota = _spilled([F.lit(w).cast("long") for w in want], have, allowed)
    per = fit.groupBy(F.struct(group).alias("_gg")).agg(*(q.alias(f"_q{i}") for i, q in enumerate(quota)))
    own = F.coalesce(*(F.when(F.col(cls) == c, F.col(f"_q{i}")) for i, c in enumerate(names)))
    rows = group_rows(fit, "_gc", ["_h", key]).withColumn("_gg", F.struct(group))
    return rows.join(per, "_gg").where(F.col("_r") < own).select(df.columns)


def interleaved_by(df: DataFrame, source: str, key: str, shares: dict[str, float], mode: str = "under", seed: int = SEED) -> DataFrame:
    """Sources drawn by probability: rows with `draw`, their place. under: until a drawn source has no more rows; over: until all were used up, shorter ones again.

    All draws are made at once, by hash of their place, and numbered within their source; the place where the mix ends is an
    aggregate of these numbers. In a mode that needs more draws than made, twice as many are made.
    """
    if mode not in ("under", "over"):
        raise ValueError(mode)
    spark = df.sparkSession
    names = list(shares)
    rows = group_rows(df.where(F.col(source).isin(names)).withColumn("_h", order_key("interleave", key, seed=seed)), source, ["_h", key]).drop("_h")
    sizes = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per given source
    if any(shares[n] <= 0 for n in names):
        raise ValueError("shares must be positive")
    if len(sizes) < len(names):  # a source without rows ends either mix before it begins
        return rows.drop("_r", "_n").withColumn("draw", F.lit(0).cast("long")).where("false")
    whole = sum(shares.values())
    made = int((min if mode == "under" else max)(sizes[n] * whole / shares[n] for n in names)) * 5 // 4 + 100
    bound, pick = 0.0, None
    for n in names:
        bound += shares[n] / whole
        pick = F.when(F.col("u") < bound, n) if pick is None else pick.when(F.col("u") < bound, n)
    count = F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, sizes[n]))), F.col("_s"))
    while True:
        draws = spark.range(made).withColumnRenamed("id", "draw").withColumn("u", uniform("source", "draw", seed=seed)).select("draw", pick.otherwise(names[-1]).alias("_s"))
        placed = cut(spark, group_rows(draws, "_s", ["draw"], "_i").select("draw", "_s", "_i"), "draws")
        last = F.min("draw") if mode == "under" else F.max("draw")
        edge = placed.where(F.col("_i") == (count if mode == "under" else count - 1)).agg(last.alias("at"), F.count(F.lit(1)).alias("n")).first()
        if edge["n"] and (mode == "under" or edge["n"] == len(names)):
            break
        made *= 2
    kept = placed.where(F.col("draw") < edge["at"] if mode == "under" else F.col("draw") <= edge["at"]).withColumn("_r", F.pmod(F.col("_i"), count))
    return kept.join(rows.withColumnRenamed(source, "_s"), ["_s", "_r"]).withColumnRenamed("_s", source).select(*df.columns, "draw")


def negatives(df: DataFrame, group: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n other keys of the same group for each row: its next ones on the group's hashed ring.

    Pairs aren't enumerated: rows meet by their places in one order of all groups. Groups of n rows or fewer are left out.
    """
    src = df.select(group, key).withColumn("_h", order_key("ring", key, seed=seed))
    rows = group_rows(src, group, ["_h", key], places=True).where(F.col("_n") > n)
    wanted = rows.select(group, key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"), "_r", "_n", "_first")
    wanted = wanted.withColumn("_at", F.col("_first") + F.pmod(F.col("_r") + F.col("slot"), F.col("_n")))
    return wanted.join(rows.select("_at", F.col(key).alias("negative")), "_at").select(group, key, "slot", "negative")
