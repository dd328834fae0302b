"""Ordered computations over the turns of a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.arrays import gae


def transitions(df: DataFrame, traj: str, order: list[str], state: str, action: str) -> DataFrame:
    """(traj, src, action, dst, ord) for each pair of states with an action between.

    Rows hold a state, an action, or both (the action follows the state); a
    state without an action before the next one starts anew.
    """
    w = Window.partitionBy(traj).orderBy(*order)
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.count(state).over(seen)).withColumn("_n", F.row_number().over(w))
    turn = rows.groupBy(traj, "_block").agg(F.min_by(state, "_n").alias("src"), F.max_by(action, F.when(F.col(action).isNotNull(), F.col("_n"))).alias("action"), F.min("_n").alias("ord")).where("_block > 0")
    nxt = turn.withColumn("dst", F.lead("src").over(Window.partitionBy(traj).orderBy("_block")))
    return nxt.where("dst IS NOT NULL AND action IS NOT NULL").select(traj, "src", "action", "dst", "ord")


def image_offsets(df: DataFrame, conv: str, turn: str, text: str, mark: str = "<image>") -> DataFrame:
    """Number of image marks in each turn and before it."""
    n = ((F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("n_images", n).withColumn("first_image", F.coalesce(F.sum("n_images").over(before), F.lit(0)))


def coverage(df: DataFrame, traj: str, turn: str, item: str, target: DataFrame | None = None) -> DataFrame:
    """Distinct items seen up to each turn, new ones in it, and the share of a target hit so far.

    An item counts at the turn in which it is first seen, so sets are never built.
    """
    first = df.groupBy(traj, item).agg(F.min(turn).alias(turn))
    new = first.groupBy(traj, turn).agg(F.count(F.lit(1)).alias("new"))
    out = df.select(traj, turn).distinct().join(new, [traj, turn], "left").fillna(0, ["new"])
    w = Window.partitionBy(traj).orderBy(turn)
    out = out.withColumn("seen", F.sum("new").over(w))
    if target is not None:
        hits = first.join(target, item, "left_semi").groupBy(traj, turn).agg(F.count(F.lit(1)).alias("_h"))
        out = out.join(hits, [traj, turn], "left").withColumn("hits", F.coalesce(F.sum("_h").over(w), F.lit(0))).drop("_h")
    return out


def turn_gae(df: DataFrame, group: str, traj: str, turn: str, reward: str, value: str, gamma: float, lam: float) -> DataFrame:
    """Generalised advantages over the turns of each trajectory: (group, traj, turn, advantage, return)."""
    once = df.groupBy(group, traj, turn).agg(F.sum(reward).alias("r"), F.max(value).alias("v"))
    seq = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("r").cast("double").alias("r"), F.col("v").cast("double").alias("v"))))
    rows = once.groupBy(group, traj).agg(seq.alias("s"))
    part = lambda f: F.transform("s", lambda x: x[f])
    adv = rows.withColumn("a", gae(part("r"), part("v"), F.transform("s", lambda x: F.lit(1)), gamma, lam))
    flat = adv.select(group, traj, F.explode(F.arrays_zip("s", "a")).alias("z"))
    return flat.select(group, traj, F.col("z.s.t").alias(turn), F.col("z.a").alias("advantage"), (F.col("z.a") + F.col("z.s.v")).alias("return"))


def to_token_rows(advantages: DataFrame, tokens: DataFrame, keys: list[str], last: Column, filler: float = -100.0) -> DataFrame:
    """Turn advantages at the turn's last valid token, the filler at its other tokens."""
    return tokens.join(advantages, keys, "left").withColumn("token_advantage", F.when(last, F.col("advantage")).otherwise(filler))


def concat_turns(df: DataFrame, traj: str, turn: str, prompt: str, response: str, extra: str) -> DataFrame:
    """One row per trajectory: tokens of all turns, with mask 1 on responses, and the last turn's extra."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(prompt).alias("p"), F.col(response).alias("r"))))
    rows = df.groupBy(traj).agg(parts.alias("s"), F.max_by(extra, turn).alias(extra))
    ids = F.flatten(F.transform("s", lambda x: F.concat(x["p"], x["r"])))
    mask = F.flatten(F.transform("s", lambda x: F.concat(F.transform(x["p"], lambda _: F.lit(0)), F.transform(x["r"], lambda _: F.lit(1)))))
    return rows.select(traj, ids.alias("ids"), mask.alias("mask"), F.size("s").alias("turns"), extra)


def recent_window(df: DataFrame, conv: str, turn: str, k: int) -> DataFrame:
    """For each target turn the kept turns: the first one and the last k, as (conv, target, turn)."""
    kept = F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), F.sequence(F.greatest(F.lit(1).cast("long"), F.col(turn).cast("long") - (k - 1)), F.col(turn).cast("long"))))
    wanted = df.where(F.col(turn) >= 1).select(conv, F.col(turn).cast("long").alias("target"), F.explode(kept).alias(turn))
    return wanted.join(df.select(conv, F.col(turn).cast("long").alias(turn)).distinct(), [conv, turn], "left_semi").select(conv, "target", turn)


def salvage(attempts: DataFrame, original: DataFrame, record: str, turn: str, attempt: str, ok: str, body: str) -> DataFrame:
    """The last attempt of which all turns are good, else for each turn its earliest good body, else the original."""
    full = attempts.groupBy(record, attempt).agg(F.bool_and(ok).alias("_all")).where("_all").groupBy(record).agg(F.max(attempt).alias("_best"))
    rows = attempts.join(full, record, "left")
    best = rows.groupBy(record, turn).agg(
        F.max(F.when(F.col(attempt) == F.col("_best"), F.col(body))).alias("_full"),
        F.min_by(body, F.when(F.col(ok), F.col(attempt))).alias("_some"),
        F.bool_or(ok).alias("_any"),
    )
    out = original.join(best, [record, turn], "left")
    return out.select(record, turn, F.coalesce("_full", F.when(F.col("_any"), F.col("_some")), body).alias(body), (F.coalesce(F.col("_full").isNotNull() | F.col("_any"), F.lit(False))).alias("improved"))
