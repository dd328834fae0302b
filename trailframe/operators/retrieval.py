"""Dense and BM25 retrieval: blocks of queries that every task holds, k rows per query from each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trailframe.storage import cut, discard

MAX_QUERIES = 4096
#: Values of all queries of a block (vector components or terms), unless one query alone has more.
MAX_VALUES = 4_000_000
#: Rows scored at a time, and additions of term weights at a time.
STEP, ADDITIONS = 1024, 4_000_000


class Best:
    """The k best rows so far of each query: higher scores first, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries x rows; what is below a query's k-th best isn't sorted, -inf and NaN never enter."""
        n, k = self.scores.shape
        q, at = np.nonzero((scores >= self.scores[:, -1:]) & (scores > -np.inf))
        if not len(q):
            return
        of = np.concatenate([np.repeat(np.arange(n), k), q])
        s = np.concatenate([self.scores.ravel(), scores[q, at]])
        i = np.concatenate([self.ids.ravel(), ids[at]])
        order = np.lexsort((i, -s, of))
        first = np.searchsorted(of[order], np.arange(n))
        keep = order[first[:, None] + np.arange(k)]
        self.scores, self.ids = s[keep], i[keep]

    def batch(self, names: pa.Array) -> pa.RecordBatch:
        ok = self.scores.ravel() > -np.inf
        of = np.repeat(np.arange(len(names)), self.scores.shape[1])[ok]
        return pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(self.ids.ravel()[ok]), pa.array(self.scores.ravel()[ok])], names=["q", "d", "score"])


def searched(asked: DataFrame, size: Callable[[Row], int], pack: Callable[[list[Row]], Any], rows: DataFrame, run: Callable, k: int) -> DataFrame:
    """(q, d, score, rank): the k best rows of each query, in blocks of queries.

    Each block is one pass over the rows, written when it is done, so neither the plan nor the driver's memory
    grows with the number of queries; rows of a query are its tasks' best k.
    """
    spark = asked.sparkSession
    schema = T.StructType([asked.schema["q"], T.StructField("d", T.LongType()), T.StructField("score", T.DoubleType())])
    paths: list[str] = []

    def search(held: list[Row]) -> None:
        shared = spark.sparkContext.broadcast(pack(held))
        paths.append(cut(spark, rows.mapInArrow(lambda batches: run(batches, shared.value, k, STEP, ADDITIONS), schema), "found").cut_path)
        shared.destroy()

    held, values = [], 0
    for r in asked.toLocalIterator():
        n = size(r)
        if held and (len(held) == MAX_QUERIES or values + n > MAX_VALUES):
            search(held)
            held, values = [], 0
        held.append(r)
        values += n
    if held:
        search(held)
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inner_products(batches: Iterator[pa.RecordBatch], block: tuple[pa.Array, np.ndarray], k: int, step: int, _: int) -> Iterator[pa.RecordBatch]:
    names, q = block
    best = Best(len(names), k)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            own = batch.slice(at, step)
            v = np.asarray(own.column(1).flatten(), float).reshape(own.num_rows, -1)
            best.add(q @ v.T, np.asarray(own.column(0)))
    yield best.batch(names)


def dense_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k highest inner products for each query, in double precision, ties to the smaller key; null vectors take no part."""
    src = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("d"), vector)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    pack = lambda held: (pa.array([r["q"] for r in held], pa.int64()), np.array([r["v"] for r in held], float))
    return searched(asked, lambda r: len(r["v"]), pack, src, inner_products, k).select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), "score", "rank")


def term_weights(batches: Iterator[pa.RecordBatch], block: tuple, k: int, step: int, additions: int) -> Iterator[pa.RecordBatch]:
    """Scores of a block by its postings: the weight of a document's term is added for each query that has the term."""
    names, terms, idf, start, holders, average, k1, b = block
    best, n = Best(len(names), k), len(names)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            own = batch.slice(at, step)
            length = pc.list_value_length(own.column(1)).to_numpy(zero_copy_only=False)
            term = pc.index_in(own.column(1).flatten(), value_set=terms)
            known = np.asarray(term.is_valid())
            doc = np.repeat(np.arange(own.num_rows), length)[known]
            pair, tf = np.unique(doc * len(terms) + np.asarray(term.drop_null(), np.int64), return_counts=True)
            doc, t = pair // len(terms), pair % len(terms)
            w = idf[t] * tf / (tf + k1 * (1 - b + b * length[doc] / average))
            many = start[t + 1] - start[t]
            done = np.cumsum(many)
            edges = np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, additions), "right")
            scores = np.zeros(n * own.num_rows)
            for lo, hi in zip(edges, [*edges[1:], len(t)]):
                m = many[lo:hi]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[t[lo:hi]], m)
                scores += np.bincount(holders[place] * own.num_rows + np.repeat(doc[lo:hi], m), np.repeat(w[lo:hi], m), len(scores))
            scores = np.where(scores > 0, np.round(scores, 6), -np.inf).reshape(n, -1)
            best.add(scores, np.asarray(own.column(0)))
    yield best.batch(names)


def bm25_topk(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """BM25 over lower-case white-space tokens with the declared k1 and b: (q, d, score, rank), scores rounded to 6 places.

    Document frequencies are summed before they are shuffled, and documents are scored against blocks of queries
    where they lie: no table of pairs, no task for a common term. Documents without an id count in the statistics only.
    """
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda x: x != "")
    spark = docs.sparkSession
    df = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select(F.col(query).alias("q"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
    asked = cut(spark, asked.join(df, "term").groupBy("q").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "asked")
    n, average = docs.agg(F.count(F.lit(1)), F.avg(F.size(words(F.col(text))))).first()
    kind = to_arrow_type(asked.schema["q"].dataType)

    def pack(held: list[Row]) -> tuple:
        df = {t["term"]: t["df"] for r in held for t in r["terms"]}
        at = {t: i for i, t in enumerate(df)}
        own = np.array([at[t["term"]] for r in held for t in r["terms"]])
        holder = np.repeat(np.arange(len(held)), [len(r["terms"]) for r in held])
        order = np.argsort(own, kind="stable")
        f = np.array(list(df.values()), float)
        return pa.array([r["q"] for r in held], kind), pa.array(list(df), pa.string()), np.log(1 + (n - f + 0.5) / (f + 0.5)), np.searchsorted(own[order], np.arange(len(df) + 1)), holder[order], average, k1, b

    src = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("d"), words(F.col(text)).alias("words"))
    out = searched(asked, lambda r: len(r["terms"]), pack, src, term_weights, k)
    discard(asked)
    return out
