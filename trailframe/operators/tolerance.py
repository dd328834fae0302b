"""Greedy dedup within a tolerance: the lexicographically first independent set, on a grid.

In order, a row joins the first kept row within the tolerance on every axis, or
is kept. Cells a little wider than the tolerance hold at most a few kept rows, so
a row looks at the kept rows of its own and the adjacent cells, not at other
rows: no pairs of a dense cell are made.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.storage import cut, discard

#: Rows of a bucket that one task takes; larger ones go through rounds over all cells at once.
LOCAL_ROWS = 100_000
_SLACK = 1 + 1e-9


def first_reps(order: np.ndarray, values: np.ndarray, tolerance: float) -> np.ndarray:
    """For rows in order the order value of the kept row that each joins."""
    cells: dict[tuple, list[int]] = {}
    near = list(product((-1, 0, 1) if tolerance > 0 else (0,), repeat=values.shape[1]))
    fine = np.isfinite(values).all(1)
    grid = np.floor(values / (tolerance * _SLACK)) if tolerance > 0 else values
    out = order.copy()
    for i in np.flatnonzero(fine).tolist():
        cell = tuple(grid[i].tolist())
        hit = [k for step in near for k in cells.get(tuple(x + y for x, y in zip(cell, step)), ()) if (np.abs(values[i] - values[k]) <= tolerance).all()]
        if hit:
            out[i] = order[min(hit)]
        else:
            cells.setdefault(cell, []).append(i)
    return out


def _grid_rounds(rows: DataFrame, names: list[str], tolerance: float) -> DataFrame:
    """rows: (b, o, values), finite. Rows (b, o, values, rep).

    A round keeps the first open row of every cell that has no earlier open row in the adjacent cells, and closes what is
    within the tolerance of these. Which kept row is the first for a closed one is settled at the end, when all are known.
    """
    spark = rows.sparkSession
    cells = [f"_c{i}" for i in range(len(names))]
    steps = list(product((-1.0, 0.0, 1.0) if tolerance > 0 else (0.0,), repeat=len(names)))
    cell = lambda v: F.floor(F.col(v) / F.lit(tolerance * _SLACK)).cast("double") if tolerance > 0 else F.col(v)
    placed = cut(spark, rows.select("*", *(cell(v).alias(c) for v, c in zip(names, cells))), "placed")
    around = lambda df: df.withColumn("_s", F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(s, cells))) for s in steps)))).withColumns({c: F.col(c) + F.col("_s")[c] for c in cells}).drop("_s")

    within = _all(F.abs(F.col(v) - F.col(f"_k{v}")) <= tolerance for v in names)
    kept = None
    open_ = placed
    while True:
        heads = cut(spark, open_.groupBy("b", *cells).agg(F.min("o").alias("o")), "heads")
        if heads.isEmpty():
            break
        before = around(heads).groupBy("b", *cells).agg(F.min("o").alias("_first"))
        fresh = heads.join(before, ["b", *cells]).where("o <= _first").select("b", "o")
        fresh = cut(spark, placed.join(fresh, ["b", "o"], "left_semi").select("b", F.col("o").alias("_o"), *(F.col(v).alias(f"_k{v}") for v in names), *cells), "kept")
        kept = fresh if kept is None else cut(spark, kept.union(fresh), "kept")
        closed = open_.join(around(fresh), ["b", *cells]).where(within).select("b", "o").distinct()
        after = cut(spark, open_.join(closed, ["b", "o"], "left_anti"), "open")
        if open_ is not placed:
            discard(open_)
        discard(heads)
        open_ = after
    if kept is None:
        return placed.select("b", "o", *names, F.col("o").alias("rep"))
    reps = placed.join(around(kept), ["b", *cells]).where(within & (F.col("_o") <= F.col("o"))).groupBy("b", "o").agg(F.min("_o").alias("rep"))
    return placed.join(reps, ["b", "o"]).select("b", "o", *names, "rep")


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def dedup_tolerant(df: DataFrame, bucket: str, order: str, values: list[str], tolerance: float, local: int = LOCAL_ROWS) -> DataFrame:
    """Greedy first-match dedup within each bucket, in an order without ties: adds `rep`, the order value of the row it joins.

    A row with a null or non-finite value joins none.
    """
    names = [f"v{i}" for i in range(len(values))]
    src = df.select(F.col(bucket).cast("string").alias("b"), F.col(order).cast("long").alias("o"), *(F.col(v).cast("double").alias(n) for v, n in zip(values, names)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        return pdf.assign(rep=first_reps(pdf["o"].to_numpy(), pdf[names].to_numpy(float), tolerance))[["b", "o", *names, "rep"]]

    schema = "b string, o long, " + ", ".join(f"{n} double" for n in names) + ", rep long"
    large = src.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local).select("b")
    large = cut(df.sparkSession, large, "large")
    if large.isEmpty():
        return src.groupBy("b").applyInPandas(run, schema)
    out = src.join(large, "b", "left_anti").groupBy("b").applyInPandas(run, schema)
    fine = _all(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) for n in names)
    rest = src.join(large, "b", "left_semi")
    odd = rest.where(~F.coalesce(fine, F.lit(False))).withColumn("rep", F.col("o"))
    return out.union(_grid_rounds(rest.where(fine), names, tolerance)).union(odd)
