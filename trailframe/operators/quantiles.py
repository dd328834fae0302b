"""Exact order statistics by rounds of counting: no task sorts or holds a group's values.

A sought rank has an open interval of values. A round takes cut points of the
rows inside from a mergeable sketch of bounded size, counts exactly what lies
below, on and between the two points next to the rank, and goes on with the part
that holds it, until at most `limit` rows are left. A sketch may err; the counts
don't, so a wrong cut point costs a round and not the result. Points on which
many equal values lie are answers themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators.batch import numbered
from trailframe.storage import cut, discard

#: Rows of a group, or left of it, that one task sorts.
LIMIT = 100_000
CUTS, ACCURACY = 128, 10_000


def order_statistics(rows: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows: (g, v double, neither null nor NaN), wanted: (g, k). Rows (g, k, v): the value of rank k (from 0) in the group; ranks beyond a group's rows have none."""
    spark = rows.sparkSession
    none = F.lit(None).cast("double")
    size = rows.groupBy("g").agg(F.count("v").alias("m"))
    state = wanted.distinct().join(size, "g").where("k >= 0 AND k < m").select("g", "k", none.alias("a"), none.alias("b"), F.col("k").cast("long").alias("r"), "m")
    state = cut(spark, state, "ranks")  # r: the rank among the m rows inside (a, b)
    done = None
    while not state.isEmpty():
        inside = rows.join(state, "g").where((F.col("a").isNull() | (F.col("v") > F.col("a"))) & (F.col("b").isNull() | (F.col("v") < F.col("b"))))
        last = inside.where(F.col("m") <= limit).withColumn("n", F.row_number().over(Window.partitionBy("g", "k").orderBy("v"))).where(F.col("n") == F.col("r") + 1).select("g", "k", "v")
        more = inside.where(F.col("m") > limit)
        points = more.groupBy("g", "k").agg(F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("p"))
        at = F.floor(F.col("r") * CUTS / F.col("m")).cast("int")  # the cut before the rank, counted from 0
        near = state.join(points, ["g", "k"]).withColumn("lo", F.col("p")[F.greatest(at - 1, F.lit(0))]).withColumn("hi", F.col("p")[F.least(at + 2, F.lit(CUTS))]).drop("p")
        near = cut(spark, near, "ranks")
        part = rows.join(near, "g").where((F.col("a").isNull() | (F.col("v") > F.col("a"))) & (F.col("b").isNull() | (F.col("v") < F.col("b"))))
        count = lambda c: F.count_if(c)
        counts = part.groupBy("g", "k", "a", "b", "r", "m", "lo", "hi").agg(count(F.col("v") < F.col("lo")).alias("n0"), count(F.col("v") == F.col("lo")).alias("n1"), count((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).alias("n2"), count((F.col("v") == F.col("hi")) & (F.col("hi") > F.col("lo"))).alias("n3"))
        upto = [F.col("n0"), F.col("n0") + F.col("n1"), F.col("n0") + F.col("n1") + F.col("n2"), F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")]
        where = F.when(F.col("r") < upto[0], 0).when(F.col("r") < upto[1], 1).when(F.col("r") < upto[2], 2).when(F.col("r") < upto[3], 3).otherwise(4)
        counted = cut(spark, counts.withColumn("w", where), "ranks")
        value = counted.where("w IN (1, 3)").select("g", "k", F.when(F.col("w") == 1, F.col("lo")).otherwise(F.col("hi")).alias("v"))
        found = last.union(value)
        done = cut(spark, found if done is None else done.union(found), "found")
        pick = lambda *c: F.when(F.col("w") == 0, c[0]).when(F.col("w") == 2, c[1]).otherwise(c[2])
        rest = counted.where("w IN (0, 2, 4)").select(
            "g", "k", pick(F.col("a"), F.col("lo"), F.col("hi")).alias("a"), pick(F.col("lo"), F.col("hi"), F.col("b")).alias("b"),
            (F.col("r") - pick(F.lit(0), upto[1], upto[3])).alias("r"), pick(F.col("n0"), F.col("n2"), F.col("m") - upto[3]).alias("m"),
        )
        after = cut(spark, rest, "ranks")
        for old in (state, near, counted):
            discard(old)
        state = after
    return done if done is not None else state.select("g", "k", F.col("a").alias("v"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """Columns `by` and one for each share: the quantile by linear interpolation; null without values. NaN values don't count.

    Groups of at most `limit` rows are one aggregate each, larger ones go through rounds.
    """
    spark = df.sparkSession
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*(F.col(c) for c in by)).alias("g"), F.when(~F.isnan(v), v).alias("v"))
    large = cut(spark, rows.groupBy("g").agg(F.count("v").alias("n")).where(F.col("n") > limit), "large")
    names = lambda df: df.select(*(F.col("g")[c].alias(c) for c in by), *shares)
    if large.isEmpty():
        return names(rows.groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items())))
    keys = large.select("g")
    small = rows.join(keys, rows["g"].eqNullSafe(keys["g"]), "left_anti").groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()))
    coded = large.withColumn("code", F.monotonically_increasing_id())
    coded = cut(spark, coded, "large")
    own = rows.where("v IS NOT NULL").join(coded.select(F.col("g").alias("h"), "code"), F.col("g").eqNullSafe(F.col("h"))).select(F.col("code").alias("g"), "v")
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = F.explode(F.array_distinct(F.array(*(f(place(q)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)))))
    found = order_statistics(own, coded.select(F.col("code").alias("g"), ends.alias("k")), limit)
    packed = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))
    out = coded.join(packed.withColumnRenamed("g", "code"), "code").select("g", *(_between(F.col("at"), place(q)).alias(n) for n, q in shares.items()))
    return names(small.union(out))


def _between(at: Column, place: Column) -> Column:
    share = place - F.floor(place)
    low, high = at[F.floor(place).cast("long")], at[F.ceil(place).cast("long")]
    return F.when((low == high) | (share == 0), low).otherwise(low * (1 - share) + high * share)


def choose(df: DataFrame, value: Column, k: int, keys: list[str], largest: bool = True, limit: int = LIMIT) -> DataFrame:
    """Adds `chosen`: exactly k rows (all, if fewer) with the largest (or smallest) values that aren't null; ties by the keys, which name a row.

    One rank is looked up, and only rows equal to its value are ordered, in range partitions.
    """
    spark = df.sparkSession
    marked = df.withColumn("_v", (-value if largest else value).cast("double"))
    rows = marked.where(F.col("_v").isNotNull() & ~F.isnan("_v")).select(F.lit(0).alias("g"), F.col("_v").alias("v"))
    bound = order_statistics(rows, spark.createDataFrame([(0, k - 1)], "g int, k bigint"), limit).first() if k > 0 else None
    if bound is None:  # none wanted, or no more rows than wanted
        return marked.withColumn("chosen", F.lit(k > 0) & F.col("_v").isNotNull() & ~F.isnan("_v")).drop("_v")
    edge = float(bound["v"])
    below = rows.where(F.col("v") < edge).count()
    ties = numbered(marked.where(F.col("_v") == edge).select(*keys), keys, "_n").where(F.col("_n") < k - below).select(*keys, F.lit(True).alias("_tie")).distinct()
    return marked.join(ties, keys, "left").withColumn("chosen", F.coalesce(F.col("_v") < edge, F.lit(False)) | F.coalesce("_tie", F.lit(False))).drop("_v", "_tie")
