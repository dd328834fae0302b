"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's dimensions are split into m lists, so a score is a sum of m partial
scores. For a block of queries:

1. every task gathers, per query and list, the k highest partial scores of one in
   PROBE of its chunks of rows; the full scores of these entries give a lower
   bound t of the k-th best score, as those of any k rows do;
2. the safe cutoff t / m goes out with the queries: a row that scores t or more
   must reach t / m in some list. Lists are taken one after the other; one whose
   product of norms stays below the cutoff is not computed, an entry below the
   cutoff counts as the cutoff in the row's upper bound, lists to come count with
   the product of norms, and a row that can't reach t for any query of a tile is
   not looked at again;
3. rows with an entry whose upper bound reaches t are resolved: the partial
   scores still missing are computed for just these pairs. Where the first list
   spares less than it costs (DENSE), a tile's rest is computed as a whole.

Queries are taken in id order in blocks of QUERY_BLOCK, the only thing that is
broadcast or held on the driver; every block scans the written vectors once per
phase, and its k best rows per query go to the shared folder. No pairs are
materialised.

Scores are exact: integer products in float64 while below 2**53, otherwise in
Python integers, with an error if a score of the result doesn't fit a long.

Defined cases: vectors that are null, hold null or non-finite components, or
have another length than the query's, take no part; queries without candidates
have no rows; rows that repeat a vec_id are candidates each and are never
candidates of a query of that id, which is answered once, by its smallest
vector; null ids take no part; ties go to smaller ids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.llm._text import read
from trailframe.storage import cut, discard, shared_dir

LISTS = 4
QUERY_BLOCK = 2048
#: Queries in a tile, for which a row is dropped or kept together.
TILE = 64
ROWS = 1024
#: Share of a tile's pairs that may still reach the bound after the first list, beyond which all of it is computed.
DENSE = 0.3
#: Phase 1 looks at every PROBE-th chunk of ROWS rows, from a task's first on.
PROBE = 8
_EXACT = float(1 << 53)
_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def _chunks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors in id order, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            part = part.filter(pa.array(np.asarray(part.column(1).value_lengths()) == width))
            ids = np.asarray(part.column(0))
            order = np.argsort(ids, kind="stable")
            if len(ids):
                yield ids[order], integers(np.asarray(part.column(1).flatten()).reshape(len(ids), width)[order], scale)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as float64 where that is exact, otherwise as Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.abs(v).max(initial=0) < _EXACT:
        return v
    whole = [int(y) if np.isfinite(y) else int(z) * scale for y, z in zip(v.reshape(-1).tolist(), x.reshape(-1).tolist())]
    return np.array(whole, object).reshape(x.shape)


def _cuts(width: int, lists: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, lists + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:]))


def _together(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the kind of number that keeps their scores exact."""
    if queries.dtype != object and rows.dtype != object:
        top = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(rows).max(initial=0)) * queries.shape[1]
        if top < _EXACT:
            return queries, rows
    exact = [x if x.dtype == object else np.array([int(y) for y in x.reshape(-1).tolist()], object).reshape(x.shape) for x in (queries, rows)]
    return exact[0], exact[1]


def _top_places(part: np.ndarray, k: int) -> np.ndarray:
    """Whether each entry is among the k highest of its row; some k of equal ones."""
    out = np.zeros(part.shape, bool)
    if part.shape[1] <= k:
        out[:] = True
    elif part.dtype == object:
        for row, mark in zip(part, out):
            mark[sorted(range(len(row)), key=row.__getitem__)[-k:]] = True
    else:
        np.put_along_axis(out, np.argpartition(part, part.shape[1] - k, axis=1)[:, -k:], True, axis=1)
    return out


class _Keep:
    """The k best (query, id, score) of each query so far; ties to smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = (np.concatenate([a, b]) for a, b in zip(self.rows, (query, ids, score)))
        if s.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda x: (q[x], -s[x], i[x])), np.int64)
        else:
            order = np.lexsort((i, -s, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.rows = [q[order], i[order], s[order]]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        q, i, s = self.rows
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(i), pa.array([int(x) for x in s], pa.int64())], names=["query_id", "vec_id", "score"])


def lists_of(queries: np.ndarray, rows: np.ndarray, other: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query, row, score) of the k highest entries of each query and list; `other` marks the pairs that count."""
    queries, rows = _together(queries, rows)
    parts = [queries[:, a:b] @ rows[:, a:b].T for a, b in _cuts(queries.shape[1], lists)]
    seen = np.zeros(other.shape, bool)
    for part in parts:
        seen |= _top_places(np.where(other, part, -np.inf), k)
    q, r = np.nonzero(seen & other)
    return q, r, sum(part[q, r] for part in parts)


def resolve_tile(queries: np.ndarray, rows: np.ndarray, other: np.ndarray, t: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: (query, row, score) of all pairs that score t or more, some below, and the number of partial scores computed."""
    queries, rows = _together(queries, rows)
    cuts = _cuts(queries.shape[1], lists)
    if queries.dtype == object or not np.isfinite(t).all():
        q, r = np.nonzero(other)
        score = sum(queries[:, a:b] @ rows[:, a:b].T for a, b in cuts)[q, r]
        keep = np.array([s >= x for s, x in zip(score, t[q])], bool)
        return q[keep], r[keep], score[keep], lists * other.size
    t = t[:, None]
    slack = 1e-6 * (1 + np.abs(t))  # rounding of the bounds must not lose a row
    share = t / lists - slack
    most = [np.sqrt((queries[:, a:b] ** 2).sum(1))[:, None] * np.sqrt((rows[:, a:b] ** 2).sum(1)) * (1 + 1e-9) for a, b in cuts]
    bound = sum(most)
    alive = other & (bound >= t - slack)
    entry = np.zeros(other.shape, bool)
    total = np.zeros(other.shape)
    missing, work = [], 0
    for (a, b), cap in zip(cuts, most):
        live = np.flatnonzero((alive & (cap >= share)).any(0))
        work += len(queries) * len(live)
        part = queries[:, a:b] @ rows[live, a:b].T
        over = part >= share
        entry[:, live] |= over
        total[:, live] += part
        bound[:, live] += np.where(over, part, np.minimum(share + slack, cap[:, live])) - cap[:, live]
        alive &= bound >= t - slack
        if a == 0 and len(live) == rows.shape[0] and alive.mean() > DENSE:  # the bounds spare too little here
            total += queries[:, b:] @ rows[:, b:].T
            q, r = np.nonzero((total >= t) & other)
            return q, r, total[q, r], lists * other.size
        left = np.ones(rows.shape[0], bool)
        left[live] = False
        missing.append(left)
    q, r = np.nonzero(alive & entry)
    score = total[q, r]
    for (a, b), left in zip(cuts, missing):
        at = np.flatnonzero(left[r])
        work += len(at)
        score[at] += np.einsum("ij,ij->i", queries[q[at], a:b], rows[r[at], a:b])
    return q, r, score, work


def _block(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, lists: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    width = vectors.shape[1]
    shared = spark.sparkContext.broadcast((ids, integers(vectors, scale)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        keep = _Keep(k)
        for n, (vec_ids, own) in enumerate(_chunks(batches, width, scale)):
            if n % PROBE == 0:  # any k rows give a safe bound
                q, r, score = lists_of(queries, own, query_ids[:, None] != vec_ids, k, lists)
                keep.add(q, vec_ids[r], score)
        yield keep.batch(query_ids)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    low = rows.mapInArrow(gather, _SCHEMA).withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "score").collect()  # a row for each query of the block at most
    bound = {r["query_id"]: r["score"] for r in low}
    cutoff = spark.sparkContext.broadcast([bound.get(int(i)) for i in ids])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        big = any(abs(x or 0) >= _EXACT for x in cutoff.value)
        t = np.array([-np.inf if x is None else x for x in cutoff.value], object if big else float)
        open_, closed = ([i for i, x in enumerate(cutoff.value) if (x is None or big) == none] for none in (True, False))
        tiles = [np.array(part[i : i + TILE]) for part in (open_, closed) for i in range(0, len(part), TILE)]
        keep = _Keep(k)
        for vec_ids, own in _chunks(batches, width, scale):
            for tile in tiles:
                q, r, score, _ = resolve_tile(queries[tile], own, query_ids[tile][:, None] != vec_ids, t[tile].astype(float) if not big else t[tile], lists)
                if len(q):
                    keep.add(tile[q], vec_ids[r], score)
        yield keep.batch(query_ids)

    return rows.mapInArrow(resolve, _SCHEMA)


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """Rows (i, v array<double>) and more columns; unusable vectors are left out."""
    v: Column = df[vector_col].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(df[id_col].cast("long").alias("i"), v.alias("v"), *more).where(F.col("i").isNotNull() & F.coalesce(fine, F.lit(False)))


def topk(df: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest of all other rows for each id divisible by `every`."""
    spark: SparkSession = df.sparkSession
    rows = cut(spark, finite_vectors(df, id_col, vector_col), "vectors")
    path = shared_dir(spark, "topk")
    spark.createDataFrame([], _SCHEMA).write.parquet(path)
    queries = rows.where(F.col("i") % every == 0).orderBy(F.size("v"), "i", "v").toLocalIterator()
    ids: list[int] = []
    vectors: list[list[float]] = []
    seen = None

    def flush() -> None:
        if ids:
            _block(rows, np.array(ids, np.int64), np.array(vectors, float).reshape(len(ids), -1), k, lists, scale).write.mode("append").parquet(path)
            ids.clear()
            vectors.clear()

    for row in queries:
        if vectors and (len(ids) == query_block or len(row["v"]) != len(vectors[0])):
            flush()
        if (len(row["v"]), row["i"]) != seen:
            seen = (len(row["v"]), row["i"])
            ids.append(row["i"])
            vectors.append(row["v"])
    flush()
    discard(rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(_SCHEMA).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read(spark, sf_dir, "embeddings"), every=50, k=5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
