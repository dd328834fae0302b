"""Joins and lookups. Build sides aren't hinted: Spark broadcasts them while their size allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in the given order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(rows: DataFrame, index: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with an index; of repeated index keys the last counts."""
    return rows.join(last_per_key(index, key, order), key)


def lookup_or(rows: DataFrame, index: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """Left lookup of a value under the first key that finds one; keys are (column of rows, column of index)."""
    out, found = rows, []
    for n, (mine, theirs) in enumerate(keys):
        side = index.groupBy(F.col(theirs).alias(f"_k{n}")).agg(F.min(value).alias(f"_v{n}"))
        out = out.join(side, F.col(mine) == F.col(f"_k{n}"), "left")
        found.append(F.col(f"_v{n}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_k{n}" for n in range(len(keys))), *(f"_v{n}" for n in range(len(keys))))


def with_factors(rows: DataFrame, factors: DataFrame, key: str) -> DataFrame:
    """Left join of numeric factors, one row per key at most; what a row lacks is NaN, and so is a factor that is null."""
    names = [c for c in factors.columns if c != key]
    return rows.join(factors, key, "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names})


def common_keys(a: DataFrame, b: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Keys of both sides, or none if there are fewer than `least`."""
    both = a.select(key).distinct().join(b.select(key), key, "left_semi")
    return both.join(both.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), F.lit(True)).drop("_n")


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.join(done, keys, "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Edges whose ends are both among the nodes."""
    for end in (src, dst):
        edges = edges.join(nodes.select(F.col(node).alias(end)), end, "left_semi")
    return edges


def zip_columns(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """Columns side by side by row number; shared columns must be equal (null and NaN equal themselves)."""
    shared = [c for c in b.columns if c != row and c in a.columns]
    right = b.select(row, *(F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in b.columns if c != row))
    out = a.join(right, row, "full")
    for c in shared:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType))).drop(f"_r_{c}")
    return out


def aligned(a: DataFrame, b: DataFrame, key: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """The k-th row of each key on one side with the k-th on the other, and `ok` where both are there."""
    num = lambda df, o: df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*o)))
    left, right = num(a, order_a).withColumn("_a", F.lit(True)), num(b, order_b).withColumn("_b", F.lit(True))
    return left.join(right, [key, "k"], "full").withColumn("ok", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")


def success_split(results: DataFrame, metrics: DataFrame, key: str, flag: str) -> DataFrame:
    """Results with `outcome` success, fail or missing."""
    side = metrics.groupBy(key).agg(F.bool_or(flag).alias("_flag"))
    return results.join(side, key, "left").withColumn("outcome", F.when(F.col("_flag"), "success").when(~F.col("_flag"), "fail").otherwise("missing")).drop("_flag")


def reassembled(original: DataFrame, improved: DataFrame, record: str, turn: str, text: str) -> DataFrame:
    """Records with the improved text of each turn where there is one: (record, texts, n_improved)."""
    side = improved.select(record, turn, F.col(text).alias("_new"))
    rows = original.join(side, [record, turn], "left")
    got = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce("_new", text).alias("x"))))
    return rows.groupBy(record).agg(F.transform(got, lambda s: s["x"]).alias("texts"), F.count("_new").alias("n_improved"))


def rendezvous(key: Column, servers: list[str]) -> Column:
    """Servers by falling md5 score of `key|server`."""
    scored = F.transform(F.array(*map(F.lit, servers)), lambda s: F.struct(F.substring(F.md5(F.concat_ws("|", key.cast("string"), s).cast("binary")), 1, 16).alias("score"), s.alias("server")))
    return F.transform(F.sort_array(scored, asc=False), lambda x: x["server"])


def tolerance_segments(spec: str) -> list[tuple[int, int | None, float, float]]:
    """`0.5,30;3-5:1,30;1,60`: default tolerances, then ranges with theirs; a bare pair is the default from there on."""
    parts = [p.strip() for p in spec.split(";") if p.strip()]
    if not parts or ":" in parts[0]:
        raise ValueError("the first segment must be a default")
    out: list[tuple[int, int | None, float, float]] = []
    at = 0
    pos, ang = map(float, parts[0].split(","))
    for p in parts[1:]:
        if ":" in p:
            where, pair = p.split(":")
            low, _, high = where.partition("-")
            low, high = int(low), int(high or low)
            if low < at:
                raise ValueError("segments overlap")
            if low > at:
                out.append((at, low - 1, pos, ang))
            own = tuple(map(float, pair.split(",")))
            out.append((low, high, *own))
            at = high + 1
        else:
            pos, ang = map(float, p.split(","))
    out.append((at, None, pos, ang))
    return out


def tolerance(length: Column, segments: list[tuple[int, int | None, float, float]]) -> Column:
    """(pos, ang) of the segment that holds the length: a range join with a few constant ranges."""
    pair = lambda p, a: F.struct(F.lit(p).alias("pos"), F.lit(a).alias("ang"))
    out = F.when(F.lit(False), pair(0.0, 0.0))
    for low, high, p, a in segments:
        out = out.when((length >= low) if high is None else length.between(low, high), pair(p, a))
    return out
