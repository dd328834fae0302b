"""Hard negatives of labelled vectors by a Voronoi-partitioned nearest-neighbour join.

Inner products become distances by augmenting: with M the largest norm, a row x
gets the component sqrt(M^2 - |x|^2) and an anchor q a zero, so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the highest score is the nearest row.

1. PIVOTS rows, those of least hash, cut the space into Voronoi cells. Every row
   and anchor gets its cell and, per pivot, its distance.
2. Cells with few anchors join the cell of the next pivot until a region has
   `anchors` of them. A region's bounds are the least and greatest distance of its
   anchors to each pivot: PIVOTS numbers twice for each of PIVOTS regions at most,
   the only thing that is broadcast.
3. A row can't be nearer to an anchor than its distances to any pivot differ, nor
   further than they add up to. A first exact join of anchors with the rows next
   to the pivots of their region gives a safe bound for their last place, and a
   row is sent only to regions it might serve.
4. The local join is exact: blocks of a region's anchors meet blocks of the rows
   sent to it, each of bounded size, whatever one cell or label holds; only the
   best of each block leave it.

Positives (same label) are joined first, negatives second: a negative lies in a
band below each positive's score, so both ends of the band bound its distance.

Scores are exact: integer products in float64 while below 2**53, otherwise in
Python integers, with an error if a score of the result doesn't fit a long.

Defined cases: rows with a null id or label, or a vector that is null or holds
null or non-finite components, take no part; rows that repeat an id count once,
by their least label and vector; of vectors of other lengths the missing
components count as zeros; anchors without positives and positives without
negatives have no rows; ties go to smaller ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.llm._text import read
from trailframe.llm.exact_topk import _together, finite_vectors, integers
from trailframe.storage import cut, discard

PIVOTS = 64
#: Anchors of a region or block, rows of a block, values of a vector batch.
ANCHORS, ROWS, VALUES = 512, 32_768, 1 << 22
_HIT = "anchor bigint, id bigint, score bigint"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Integer vectors, zeros beyond their ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if not (size == width).all():
        out = np.zeros((len(size), width))
        out[np.arange(width) < size[:, None]] = flat
        flat = out
    return integers(flat.reshape(len(size), width), scale)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    one, two = _together(a, b) if a.size and b.size else (a, b)
    return one @ two.T


class Space:
    """Pivots in augmented space; distances carry a slack for rounding."""

    def __init__(self, pivots: np.ndarray, norm: float) -> None:
        self.pivots, self.norm = pivots, norm
        self.last = np.sqrt(np.maximum(norm**2 - (pivots**2).sum(1), 0))
        self.slack = 1e-6 * (1 + norm)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.norm**2 - 2 * (x @ self.pivots.T + last[:, None] * self.last), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.norm**2 - 2 * q @ self.pivots.T, 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from each anchor at which rows have this score."""
        return np.sqrt(np.maximum((q**2).sum(1) + self.norm**2 - 2 * score, 0))


def regions_of(counts: dict[int, int], pivots: np.ndarray, least: int) -> dict[int, int]:
    """Region of each cell that has anchors: cells in a chain of nearest pivots, closed at `least` anchors."""
    left, out, region, held = sorted(counts), {}, 0, 0
    at = left[0] if left else 0
    while left:
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        out[at] = region
        held += counts[at]
        if held >= least:
            region, held = region + 1, 0
    return out


def served(near: np.ndarray, low: np.ndarray, high: np.ndarray, within: np.ndarray, beyond: np.ndarray, slack: float) -> np.ndarray:
    """Whether each row (its distances to the pivots) might lie from `beyond` to `within` of an anchor of each region (bounds by pivot)."""
    out = np.zeros((len(near), len(low)), bool)
    for g in range(len(low)):
        gap = np.maximum(np.maximum(near - high[g], low[g] - near), 0).max(1)
        most = (near + high[g]).min(1)
        out[:, g] = ~((gap > within[g] + slack) | (most < beyond[g] - slack))
    return out


def best_rows(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores that fit, ties to smaller ids."""
    at = np.flatnonzero(fit)
    if len(at) > 4 * k and scores.dtype != object:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    order = sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], np.int64)


class _Join:
    """Blocks of anchors against blocks of rows, in one width and scale."""

    def __init__(self, width: int, scale: int, k: int, n: int, low: int, high: int) -> None:
        self.width, self.scale, self.k, self.n, self.low, self.high = width, scale, k, n, low, high

    def both(self, anchors: pa.Table, rows: pa.Table) -> tuple:
        a, r = (_matrix(t.column("v"), self.width, self.scale) for t in (anchors, rows))
        values = lambda t, c: np.asarray(t.column(c).combine_chunks())
        return _products(a, r), values(anchors, "i"), values(rows, "i"), values(anchors, "label"), values(rows, "label")

    def positives(self, _key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            score, ids, others, label, their = self.both(anchors, rows)
            for x, i in enumerate(ids):
                for y in best_rows(score[x], (their == label[x]) & (others != i), others, self.k):
                    found.append((int(i), int(others[y]), int(score[x, y])))
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["anchor", "id", "score"])

    def negatives(self, _key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            score, ids, others, label, their = self.both(anchors, rows)
            for x, i in enumerate(ids):
                other = (their != label[x]) & (others != i)
                for p in anchors.column("positives")[x].as_py():
                    lo, hi = self.band(p["score"])
                    lo = lo if p["least"] is None else max(lo, p["least"])
                    for y in best_rows(score[x], other & (score[x] >= lo) & (score[x] <= hi), others, self.n):
                        found.append((int(i), p["id"], p["score"], int(others[y]), int(score[x, y])))
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(5)], names=["anchor", "id", "score", "other", "value"])

    def band(self, score: int) -> tuple[int, int]:
        """Least and greatest integer s with low * score <= 100 * s <= high * score."""
        return -(-self.low * score // 100), self.high * score // 100


def _blocks(anchors: DataFrame, rows: DataFrame, on: list[str], per: int, each: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks (part, a, r) of at most about `per` anchors and `each` rows of a part (`on`)."""
    n = anchors.groupBy(*on).agg(F.count(F.lit(1)).alias("na")).join(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("nr")), on)
    n = n.select(*on, F.ceil(F.col("na") / per).alias("na"), F.ceil(F.col("nr") / each).alias("nr"))
    deal = lambda df, own, of, other: df.join(n, on).withColumn(own, F.pmod(F.xxhash64("i"), F.col(of)))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    return deal(anchors, "a", "na", "nr").withColumn("r", upto("nr")).drop("na", "nr"), deal(rows, "r", "nr", "na").withColumn("a", upto("na")).drop("na", "nr")


def _joined(anchors: DataFrame, rows: DataFrame, on: list[str], f, schema: str, per: int, each: int) -> DataFrame:
    left, right = _blocks(anchors, rows, on, per, each)
    keys = [*on, "a", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, one, two: f(key, one, two), schema)


def _top(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, every: int, k: int = 5, n: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding",
    scale: int = 256, pivots: int = PIVOTS, anchors: int = ANCHORS, rows: int = ROWS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the ids divisible by `every`; their positives the k best rows of their label, and each positive's negatives
    the n best rows of other labels that score from `low` to `high` percent of it.
    """
    spark: SparkSession = df.sparkSession
    label = df[label_col] if isinstance(label_col, str) else label_col
    made = []

    def keep(x: DataFrame, name: str) -> DataFrame:
        made.append(cut(spark, x, name))
        return made[-1]

    named = df.select(df[id_col].alias("id"), df[vector_col].alias("vector"), label.cast("long").alias("label"))
    fine = finite_vectors(named.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector"))), "id", "vector", "label")
    once = fine.groupBy("i").agg(F.min(F.struct("label", "v")).alias("m")).select("i", "m.label", "m.v")
    table = keep(once, "vectors")
    whole = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2)))  # of the floor: no more
    shape = table.agg(F.max(F.size("v")).alias("width"), F.max(F.sqrt(whole)).alias("norm")).first()
    width = shape["width"] or 0
    join = _Join(width, scale, k, n, low, high)
    sample = table.orderBy(F.xxhash64("i"), "i").limit(pivots).select("v").collect()  # `pivots` rows
    norm = float(shape["norm"] or 0)
    bounded = width > 0 and norm < 1e150  # otherwise every row is sent to every region
    centres = [np.pad(np.floor(np.array(r["v"], float) * scale), (0, width - len(r["v"]))) for r in sample if bounded]
    centres = np.array(centres).reshape(len(centres), width)
    space = Space(centres, norm)

    def distances(part: pa.RecordBatch, of_anchors: bool) -> np.ndarray:
        x = _matrix(part.column("v"), width, scale).astype(float)
        return (space.of_anchors if of_anchors else space.of_rows)(x)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, VALUES // max(width, 1))):
                part = batch.slice(at, max(1, VALUES // max(width, 1)))
                cell, near = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                if bounded:
                    away = distances(part, False)
                    cell, near = away.argmin(1).astype(np.int32), away.min(1)
                home = distances(part, True).argmin(1).astype(np.int32) if bounded else cell
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(near), pa.array(home)], names=["i", "label", "v", "cell", "near", "home"])

    placed = keep(table.mapInArrow(celled, "i bigint, label bigint, v array<double>, cell int, near double, home int"), "cells")
    asked = placed.where(F.col("i") % every == 0)
    counts = {r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}  # a row for each pivot at most
    region_of = regions_of(counts, centres if bounded else np.zeros((1, 0)), anchors)
    n_regions = max(region_of.values(), default=-1) + 1
    regions = spark.createDataFrame(sorted(region_of.items()), "home int, g int")
    asked = keep(asked.join(F.broadcast(regions), "home").select("i", "label", "v", "g"), "anchors")
    first = placed.withColumn("o", F.row_number().over(Window.partitionBy("cell", "label").orderBy("near", "i"))).where(F.col("o") <= k + 1)
    first = keep(first.join(F.broadcast(regions.withColumnRenamed("home", "cell")), "cell").select("i", "label", "v", "g"), "nearest")

    def bounds(limits: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
        """limits: (g, v, least, most): scores of the rows that an anchor needs. Least and greatest distances by region."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                q = _matrix(part.column("v"), width, scale).astype(float)
                near = space.of_anchors(q)
                least, most = (np.asarray(part.column(c).cast(pa.float64()).fill_null(x)) for c, x in (("least", -np.inf), ("most", np.inf)))
                within, beyond = space.reach(q, least), space.reach(q, most)
                g = part.column("g")
                yield pa.RecordBatch.from_arrays([g.take(pa.array(np.repeat(np.arange(len(q)), near.shape[1]))), pa.array(np.tile(np.arange(near.shape[1]), len(q))), pa.array(near.reshape(-1)), *(pa.array(np.repeat(x, near.shape[1])) for x in (within, beyond))], names=["g", "p", "near", "within", "beyond"])

        rows_ = limits.mapInArrow(run, "g int, p bigint, near double, within double, beyond double").groupBy("g", "p").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.max("within").alias("within"), F.min("beyond").alias("beyond")).collect()  # a row for each pivot of each region at most
        out = {}
        for g in {r["g"] for r in rows_}:
            own = sorted((r for r in rows_ if r["g"] == g), key=lambda r: r["p"])
            out[g] = (np.array([r["lo"] for r in own]), np.array([r["hi"] for r in own]), own[0]["within"], own[0]["beyond"])
        return out

    def sent(limits: DataFrame) -> DataFrame:
        """Rows with each region they might serve."""
        if not bounded:
            return placed.select("i", "label", "v", F.explode(F.array(*(F.lit(g) for g in range(max(n_regions, 1))))).alias("g"))
        known = bounds(limits)
        g = sorted(known)
        if not g:
            return placed.where("false").select("i", "label", "v", F.lit(0).alias("g"))
        low_, high_, within, beyond = (np.array([known[x][c] for x in g]) for c in range(4))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, VALUES // max(width, 1))):
                    part = batch.slice(at, max(1, VALUES // max(width, 1)))
                    row, region = np.nonzero(served(distances(part, False), low_, high_, within, beyond, space.slack))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("i", "label", "v")), pa.array(np.array(g, np.int32)[region])], names=["i", "label", "v", "g"])

        return placed.select("i", "label", "v").mapInArrow(run, "i bigint, label bigint, v array<double>, g int")

    wide = "anchor bigint, id bigint, score bigint, other bigint, value bigint"
    some = _top(_joined(asked, first, ["g", "label"], join.positives, _HIT, anchors, rows), ["anchor"], "score", "id", k)
    safe = some.where(F.col("rank") == k).select(F.col("anchor").alias("i"), F.col("score").alias("least"))
    limits = asked.join(safe, "i", "left").select("g", "v", "least", F.lit(None).cast("long").alias("most"))
    near = keep(sent(limits), "positives")
    found = _joined(asked, near, ["g", "label"], join.positives, _HIT, anchors, rows)
    positives = keep(_top(found, ["anchor"], "score", "id", k).select("anchor", "id", "score"), "chosen")

    def with_pairs(pairs: DataFrame) -> DataFrame:
        own = pairs.groupBy("anchor").agg(F.collect_list(F.struct("id", "score", "least")).alias("positives"))
        return asked.join(own.withColumnRenamed("anchor", "i"), "i")

    pairs = positives.withColumn("least", F.lit(None).cast("long"))
    some = _top(_joined(with_pairs(pairs), first, ["g"], join.negatives, wide, anchors, rows), ["anchor", "id"], "value", "other", n)
    safe = some.where(F.col("rank") == n).select("anchor", "id", F.col("value").alias("least"))
    pairs = keep(positives.join(safe, ["anchor", "id"], "left"), "pairs")
    percent = lambda p: F.col("score").cast("decimal(20,0)") * p / 100
    ends = pairs.select(F.col("anchor").alias("i"), F.coalesce(F.col("least").cast("double"), percent(low).cast("double")).alias("least"), percent(high).cast("double").alias("most")).where("score >= 0")
    limits = asked.join(ends, "i").select("g", "v", "least", "most")
    near = keep(sent(limits), "negatives")
    found = _joined(with_pairs(pairs), near, ["g"], join.negatives, wide, anchors, rows)
    out = cut(spark, _top(found, ["anchor", "id"], "value", "other", n), "mined")
    for x in made:
        discard(x)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("positive_score"), F.col("value").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, every=100, label_col=label)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b, p.s, s.b AS c, s.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.s BETWEEN 30 * p.s AND 90 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, c AS negative_id, s AS positive_score, t AS negative_score FROM n WHERE r <= 10
"""
