"""Row operations of a numbered batch and balancing of work over ranks."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.storage import cut


def running_total(df: DataFrame, order: list, value: Column | None = None, out: str = "before") -> DataFrame:
    """Adds the sum of a value (or the count) over all rows before each, in an order without ties.

    Sums run inside range partitions, offset by the partitions before. The dealt
    rows are written once, as a second run may draw other range bounds; only one
    sum per partition reaches the driver, so no task orders all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighed = df.withColumn("__w", F.lit(1).cast("long") if value is None else value)
    dealt = cut(spark, weighed.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ordered")
    total, base = 0, []
    for r in sorted(dealt.groupBy("__p").agg(F.sum("__w").alias("s")).collect()):
        base.append((r["__p"], total))
        total += r["s"] or 0
    kind = dealt.schema["__w"].dataType.simpleString()
    offsets = spark.createDataFrame([(p, type(total)(b)) for p, b in base], f"__p int, __b {kind}")
    local = F.sum("__w").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("__l", local).join(offsets, "__p").withColumn(out, F.col("__b") + F.coalesce("__l", F.lit(0))).drop("__w", "__p", "__l", "__b")


def numbered(df: DataFrame, order: list, row: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in the given order."""
    return running_total(df, order, None, row)


def concat(parts: Iterable[DataFrame], metas: Iterable[dict] = ()) -> tuple[DataFrame, dict]:
    """Rows of all parts; metrics are gathered, other meta values must agree."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    meta: dict = {}
    for m in metas:
        for k, v in m.items():
            if k == "metrics":
                meta.setdefault(k, []).append(v)
            elif meta.setdefault(k, v) != v:
                raise ValueError(f"meta value {k} differs")
    return out, meta


def columns(df: DataFrame, keep: list[str] | None = None, pop: Iterable[str] = (), rename: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch without the popped columns, of the others those kept, renamed; and the popped columns. Unknown names and names that clash are errors."""
    pop, rename = list(pop), dict(rename or {})
    unknown = [c for c in (*pop, *(keep or ()), *rename) if c not in df.columns]
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    left = [c for c in (df.columns if keep is None else keep) if c not in pop]
    names = [rename.get(c, c) for c in left]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash in {names}")
    return df.select(*(F.col(c).alias(n) for c, n in zip(left, names))), df.select(*pop)


def sliced(df: DataFrame, row: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    keep = (F.col(row) >= start) & (F.pmod(F.col(row) - start, F.lit(step)) == 0)
    return df.where(keep if stop is None else keep & (F.col(row) < stop))


def chunked(df: DataFrame, row: str, chunks: int, chunk: str = "chunk") -> DataFrame:
    """Chunk numbers of ceil(n / chunks) rows each."""
    size = df.agg(F.ceil(F.count(F.lit(1)) / chunks).alias("_s"))
    return df.join(size, F.lit(True)).withColumn(chunk, F.floor(F.col(row) / F.col("_s")).cast("long")).drop("_s")


def split(df: DataFrame, row: str, size: int, chunk: str = "chunk") -> DataFrame:
    return df.withColumn(chunk, F.floor(F.col(row) / size).cast("long"))


def repeated(df: DataFrame, row: str, times: int, interleave: bool = True) -> DataFrame:
    """k copies of each row: next to each other, or the whole batch after itself."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(n, F.lit(True)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    place = F.col(row) * times + F.col("copy") if interleave else F.col("copy") * F.col("_n") + F.col(row)
    return out.withColumn("place", place).drop("_n")


def repeated_by(df: DataFrame, times: str) -> DataFrame:
    """As many copies of each row as its count says."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def reordered(df: DataFrame, row: str, order: DataFrame, to: str) -> DataFrame:
    """Rows by a permutation table (to, row)."""
    return df.join(order, row).withColumn(row, F.col(to)).drop(to)


def padded(df: DataFrame, row: str, divisor: int) -> DataFrame:
    """Rows cycled until their number is divisible; `is_pad` marks the added ones, which unpadding drops."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(n, F.lit(True)).withColumn("_add", F.pmod(-F.col("_n"), F.lit(divisor)))
    copies = F.floor((F.col("_add") - F.col(row) - 1) / F.col("_n")) + 1  # of this row among the added ones
    out = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), copies))))
    return out.withColumn("is_pad", F.col("_c") > 0).withColumn(row, F.col(row) + F.col("_c") * F.col("_n")).drop("_n", "_add", "_c")


def folded(df: DataFrame, row: str, size: int, columns: list[str]) -> DataFrame:
    """`size` rows to one with arrays in row order."""
    got = F.sort_array(F.collect_list(F.struct(row, *columns)))
    out = df.groupBy(F.floor(F.col(row) / size).cast("long").alias("fold")).agg(got.alias("_s"))
    pick = lambda c: F.transform("_s", lambda x: x[c]).alias(c)
    return out.select("fold", *map(pick, columns))


def unfolded(df: DataFrame, fold: str, size: int, columns: list[str], row: str) -> DataFrame:
    flat = df.select(fold, F.posexplode(F.arrays_zip(*columns)).alias("_i", "_z"))
    return flat.select((F.col(fold) * size + F.col("_i")).alias(row), *(F.col(f"_z.{c}").alias(c) for c in columns))


def mini_batches(df: DataFrame, key: list[str], size: int, epochs: int, seed: int) -> DataFrame:
    """Rows of each epoch in hashed order with their batch numbers; the order is the same at any parallelism."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), *(F.col(k).cast("string") for k in key)).cast("binary"))
    return numbered(out.withColumn("_h", h), ["epoch", "_h", *key], "_n").join(df.agg(F.count(F.lit(1)).alias("_t")), F.lit(True)).withColumn("batch", F.floor((F.col("_n") - F.col("epoch") * F.col("_t")) / size).cast("long")).drop("_h", "_n", "_t")


def differenced(tuples: list[list[int]]) -> list[list[tuple[int, int]]]:
    """tuples: k sums each. For each of the k parts the (tuple, place) put into it: the two of largest spread are joined again and again, high sums with low ones.

    A joined tuple's spread is at most the larger of the two, so the parts differ by the largest spread of a tuple at most.
    """
    heap: list[tuple[int, int, list[tuple[int, list[tuple[int, int]]]]]] = []
    for n, sums in enumerate(tuples):
        sets = sorted(((s, [(n, i)]) for i, s in enumerate(sums)), key=lambda x: -x[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        sets = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda x: -x[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
        n += 1
    return [own for _, own in heap[0][2]] if heap else []


def karmarkar_karp(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Indices in k parts of nearly equal sums, by largest differencing; equal: parts of one count."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal and len(sizes) % k:
        raise ValueError("the count isn't divisible")
    start = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    parts = differenced([[sizes[i] for i in own] + [0] * (k - len(own)) for own in start])
    return [sorted(start[n][i] for n, i in own if i < len(start[n])) for own in parts] or [[] for _ in range(k)]


def least_loaded(sizes: list[int], k: int) -> list[list[int]]:
    """Items in order to the least loaded part, of equals the first."""
    heap = [(0, p) for p in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (load + s, p))
    return out


def micro_batch_count(sizes: list[int], most: int) -> int:
    return min(len(sizes), max(1, -(-sum(sizes) // most)))


def micro_batches(sizes: list[int], most: int) -> list[list[int]]:
    """Parts under a token budget by workload 24576 s + s^2, the lightest at the outside."""
    parts = karmarkar_karp([24576 * s + s * s for s in sizes], micro_batch_count(sizes, most))
    load = sorted(parts, key=lambda p: sum(24576 * sizes[i] + sizes[i] ** 2 for i in p))
    return load[0::2] + load[1::2][::-1]


#: Rows that one task partitions, and partitions that one task puts together.
PART_ROWS, PART_FAN = 50_000, 1000


def balanced(df: DataFrame, batch: str, row: str, size: str, k: int, method: str = "kk", rows: int = PART_ROWS, fan: int = PART_FAN) -> DataFrame:
    """Part numbers within each batch: (batch, row, size, part).

    kk: a batch of more than `rows` rows is dealt to blocks; each is partitioned in a task, and blocks are put together by
    differencing their k sums, `fan` of them at a time, so only sums leave a block. The parts' sums differ by the largest
    item at most (a block's by its largest, and joining doesn't add to it). greedy: in row order, a batch in one task.
    """
    src = df.select(F.col(batch).cast("long").alias("batch"), F.col(row).cast("long").alias("row"), F.col(size).cast("long").alias("size"))
    n = src.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_n"))
    blocks = src.join(n, "batch").select("batch", "row", "size", (F.pmod(F.xxhash64("row"), "_n") if method == "kk" else F.lit(0)).cast("long").alias("block"))
    solve = {"kk": karmarkar_karp, "greedy": least_loaded}[method]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        part = pd.Series(0, index=pdf.index)
        for p, own in enumerate(solve(pdf["size"].tolist(), k)):
            part.iloc[own] = p
        return pdf.assign(part=part)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.pivot_table(index="block", columns="part", values="size", aggfunc="sum", fill_value=0).reindex(columns=range(k), fill_value=0)
        moved = [(int(pdf["batch"].iloc[0]), int(sums.index[n]), p, to) for to, own in enumerate(differenced(sums.to_numpy().tolist())) for n, p in own]
        return pd.DataFrame(moved, columns=["batch", "block", "part", "to"])

    spark = df.sparkSession
    out = cut(spark, blocks.groupBy("batch", "block").applyInPandas(first, "batch long, row long, size long, block long, part int"), "parts")
    while out.where("block > 0").limit(1).count():
        sums = out.groupBy("batch", "block", "part").agg(F.sum("size").alias("size")).withColumn("up", F.floor(F.col("block") / fan))
        moves = sums.groupBy("batch", "up").applyInPandas(join, "batch long, block long, part int, to int")
        out = cut(spark, out.join(moves, ["batch", "block", "part"]).select("batch", "row", "size", F.floor(F.col("block") / fan).alias("block"), F.col("to").alias("part")), "parts")
    return out.select("batch", "row", "size", "part")


def imbalance(df: DataFrame, part: str, size: str) -> DataFrame:
    per = df.groupBy(part).agg(F.sum(size).alias("s"))
    return per.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("gap"))
