"""Supervised records from graph paths and rollouts: checks, questions, turns, merges.

Every random choice is a hash order (seed, purpose, key), so a generator's stream
doesn't depend on which others are enabled.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators.recipes import mcq
from trailframe.operators.sampling import negatives, order_key, take_per_group, uniform
from trailframe.storage import cut, discard

_PART = re.compile(r"<(observation|action)>(.*?)</\1>", re.DOTALL)
_TURN = re.compile(r'<turn\s+index="(\d+)"\s*>(.*?)</turn>', re.DOTALL)


def flat_chunks(reply: str) -> list[str]:
    """From each observation that an action follows before the next one, to that action's end."""
    out, start = [], None
    for m in _PART.finditer(reply):
        if m[1] == "observation":
            start = m.start()
        elif start is not None:
            out.append(reply[start : m.end()])
            start = None
    return out


def check_turns(reply: str, actions: list[str], longest: int = 1500, repair: bool = True) -> list[tuple[bool, str, str | None]]:
    """For each expected action (ok, reason, body): numbered turns if they cover all, else chunks in order."""
    blocks = {int(m[1]): m[2] for m in _TURN.finditer(reply)}
    wanted = range(1, len(actions) + 1)
    if not all(i in blocks and "<turn" not in blocks[i] for i in wanted):
        blocks = dict(enumerate(flat_chunks(reply), 1))
    out: list[tuple[bool, str, str | None]] = []
    for i, want in zip(wanted, actions):
        body = blocks.get(i)
        found = {} if body is None else {m[1]: m for m in reversed(list(_PART.finditer(body)))}
        if body is None:
            out.append((False, "missing turn", None))
        elif len(body) > longest:
            out.append((False, "too long", None))
        elif len(found) < 2:
            out.append((False, f"missing {'observation' if 'observation' not in found else 'action'}", None))
        elif found["action"][2].strip() == want:
            out.append((True, "", body.strip()))
        elif repair:
            at = found["action"]
            out.append((True, "repaired", (body[: at.start()] + f"<action>{want}</action>" + body[at.end() :]).strip()))
        else:
            out.append((False, "action mismatch", None))
    return out


_CHECK = T.ArrayType(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("body", T.StringType())]))


@F.pandas_udf(_CHECK)
def checked_turns(reply: pd.Series, actions: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("ok", "reason", "body"), t)) for t in check_turns(r or "", list(a))] for r, a in zip(reply, actions)])


def short_enough(df: DataFrame, prompt: str, most: int, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose prompt has at most so many tokens; white-space tokens unless a tokenizer is given."""
    cut = tokens or (lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    return df.where(F.size(cut(F.col(prompt))) <= most)


def clean_episodes(df: DataFrame, reason: str, good: list[str]) -> DataFrame:
    """Episodes with a normal finish reason; nothing is deleted."""
    return df.where(F.col(reason).isin(*good))


def image_passes(pixels: Column) -> Column:
    """Gray values of an image: a deviation of 10 or more, and 70 % void at most; false for no values, nulls and NaN."""
    n = F.size(pixels).cast("double")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("void"))
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["void"] + F.when(F.abs(x - 255) <= 5, 1.0).otherwise(0.0)).alias("void"))
    spread = lambda a: n * a["ss"] - a["s"] * a["s"]
    ok = lambda a: (n > 0) & ~F.isnan(spread(a)) & (spread(a) >= 100 * n * n) & (F.try_divide(a["void"], n) <= 0.7)
    return F.coalesce(F.aggregate(F.transform(pixels, lambda x: x.cast("double")), zero, add, ok), F.lit(False))


def tolerance_neighbours(df: DataFrame, bucket: str, key: str, values: list[str], tolerance: float) -> DataFrame:
    """Pairs (key, other) of a bucket whose values all agree within the tolerance: a band join on grid cells of the first value."""
    cell = F.floor(F.col(values[0]) / (2 * tolerance)).cast("long")
    left = df.select(bucket, key, *values, cell.alias("_c"))
    right = df.select(bucket, F.col(key).alias("other"), *(F.col(v).alias(f"_{v}") for v in values), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    near = [F.abs(F.col(v) - F.col(f"_{v}")) <= tolerance for v in values]
    out = left.join(right, [bucket, "_c"]).where(F.col(key) < F.col("other"))
    for c in near:
        out = out.where(c)
    return out.select(bucket, key, "other")


def action_records(walks: DataFrame, prompt: str = "From {a} reach {b}.") -> DataFrame:
    """Ends of a walk to its action sequence: (walk, prompt, answer)."""
    head, tail = prompt.replace("{b}", "{a}").split("{a}", 1)
    mid, tail = tail.split("{a}", 1)
    return walks.select("walk", F.concat(F.lit(head), F.element_at("nodes", 1), F.lit(mid), F.element_at("nodes", -1), F.lit(tail)).alias("prompt"), F.array_join("actions", " | ").alias("answer"))


def view_questions(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """One right view and three of the same group in a hashed order: (key, options, letter); small groups are left out."""
    wrong = negatives(df, group, key, 3, seed).groupBy(group, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "negative"))), lambda s: s["negative"].cast("string")).alias("_w"))
    q = mcq(F.col(key).cast("string"), F.col("_w"), key, seed)
    return wrong.select(group, key, q["options"].alias("options"), q["letter"].alias("letter"))


#: Net displacement of each move on a grid, as (x, y, turn).
MOVES = {"move_forward": (1, 0, 0), "move_backward": (-1, 0, 0), "move_left": (0, 1, 0), "move_right": (0, -1, 0), "turn_left": (0, 0, 1), "turn_right": (0, 0, -1)}


def displacement(actions: Column) -> Column:
    """Net effect of an action array without regard to order: a key for telling sequences apart."""
    axis = lambda i: F.aggregate(F.transform(actions, lambda a: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in MOVES.items() for x in (k, v[i]))), a), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.concat_ws(",", *(axis(i).cast("string") for i in range(3)))


def sequence_negatives(candidates: DataFrame, key: str, truth: str, option: str, n: int = 3, seed: int = 42) -> DataFrame:
    """n candidate sequences per key whose displacement differs from the truth's and from each other's."""
    rows = candidates.withColumn("_d", displacement(F.col(option))).where(F.col("_d") != displacement(F.col(truth)))
    one = rows.withColumn("_o", F.array_join(option, "|")).groupBy(key, "_d").agg(F.min("_o").alias("negative"))
    return take_per_group(one.withColumn("_k", F.concat_ws("|", F.col(key).cast("string"), "negative")), key, "_k", n, "sequence", seed).select(key, "negative")


def question_kind(key: str, turn: str, share: float, seed: int = 42) -> Column:
    """Per turn a multiple-choice question with the given probability, else a free one."""
    return F.when(uniform("kind", key, turn, seed=seed) < share, "mcq").otherwise("free")


def turn_records(steps: DataFrame, record: str, step: str, observation: str, action: str, system: str, answer: str) -> DataFrame:
    """Messages of a multi-turn record: the system text, a user and an assistant message per step, the final answer."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pair = F.array(message("user", F.col(observation)), message("assistant", F.concat(F.lit("<action>"), F.col(action), F.lit("</action>"))))
    got = F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), pair.alias("p"))))
    rows = steps.groupBy(record).agg(F.flatten(F.transform(got, lambda x: x["p"])).alias("_m"), F.max_by(answer, step).alias("_a"))
    end = F.array(message("assistant", F.concat(F.lit("<action>answer("), F.col("_a"), F.lit(")</action>"))))
    return rows.select(record, F.concat(F.array(message("system", F.lit(system))), "_m", end).alias("messages"))


def mixed_records(steps: DataFrame, record: str, step: str, observation: str, action: str, wrong: str, system: str, answer: str, share: float, seed: int = 42) -> DataFrame:
    """Messages of a multi-turn record (record, messages, kinds) whose turns are each a multiple-choice question with a probability, else free.

    A turn without wrong actions (`wrong`, an array) is free. A question lists the right action at a hashed slot among the
    wrong ones and is answered by its letter; the last turn, the answer, is always free.
    """
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turn = F.concat_ws("|", F.col(record).cast("string"), F.col(step).cast("string"))
    rows = steps.withColumn("_t", turn).withColumn("_k", F.when(F.coalesce(F.size(wrong), F.lit(0)) > 0, question_kind(record, step, share, seed)).otherwise("free"))
    rows = rows.withColumn("_q", mcq(F.col(action), F.col(wrong), "_t", seed))
    letters = F.transform("_q.options", lambda x, i: F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)), F.lit(". "), x))
    is_mcq = F.col("_k") == "mcq"
    asked = F.when(is_mcq, F.concat(F.col(observation), F.lit("\n"), F.array_join(letters, "\n"))).otherwise(F.col(observation))
    said = F.concat(F.lit("<action>"), F.when(is_mcq, F.col("_q.letter")).otherwise(F.col(action)), F.lit("</action>"))
    got = F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), F.array(message("user", asked), message("assistant", said)).alias("p"), F.col("_k").alias("k"))))
    rows = rows.groupBy(record).agg(got.alias("_g"), F.max_by(answer, step).alias("_a"))
    end = F.array(message("assistant", F.concat(F.lit("<action>answer("), F.col("_a"), F.lit(")</action>"))))
    turns = F.flatten(F.transform("_g", lambda x: x["p"]))
    return rows.select(record, F.concat(F.array(message("system", F.lit(system))), turns, end).alias("messages"), F.transform("_g", lambda x: x["k"]).alias("kinds"))


def reward_filtered(df: DataFrame, messages: str, reward: str, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """Records with the reward and the number of messages that they need; a null reward has too little."""
    return df.where((F.col(reward) >= threshold) & (F.size(messages) >= least))


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the records that an earlier output lacks, the first of equal keys; gives their number. The output may not exist yet.

    New records are written apart first, so that an append that fails is done whole when it is run again.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = df.dropDuplicates(keys)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        fresh = fresh.join(spark.read.schema(df.schema).parquet(path), keys, "left_anti").select(df.columns)
    fresh = cut(spark, fresh, "fresh")
    fresh.write.mode("append").parquet(path)
    n = fresh.count()
    discard(fresh)
    return n


def prompt_choice(pool: list[str], generator: str, key: str, seed: int = 42) -> Column:
    """A prompt of a pool by the generator's own hash stream."""
    place = F.pmod(F.conv(F.substring(order_key(generator, key, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(len(pool)).cast("long"))
    return F.element_at(F.array(*map(F.lit, pool)), (place + 1).cast("int"))


def merged_reasoning(original: DataFrame, improved: DataFrame, record: str, turn: str, text: str, keep_plain: bool = True) -> DataFrame:
    """Records with improved turns and their class: full, partial or dropped (kept as they are if asked)."""
    rows = original.join(improved.select(record, turn, F.col(text).alias("_new")), [record, turn], "left")
    got = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce("_new", text).alias("x"))))
    out = rows.groupBy(record).agg(F.transform(got, lambda s: s["x"]).alias("texts"), F.count("_new").alias("_n"), F.count(F.lit(1)).alias("_t"))
    out = out.withColumn("cls", F.when(F.col("_n") == F.col("_t"), "full").when(F.col("_n") > 0, "partial").otherwise("dropped"))
    return out.where(F.lit(keep_plain) | (F.col("cls") != "dropped")).select(record, "texts", "cls")


#: Items of a map's block; pairs of blocks are compared in one task each.
MAP_BLOCK = 2048


def sector(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Number of the eight 45 degree sectors around the axes; NaN, which equals nothing, for missing places."""
    return np.floor(((np.degrees(np.arctan2(dx, dy)) + 360) % 360 + 22.5) / 45) % 8


def agreeing_pairs(pairs: DataFrame, group: str, block: int = MAP_BLOCK) -> DataFrame:
    """Per map the number of item pairs whose guess lies in the truth's direction, one of eight sectors; a missing guess agrees with nothing.

    A map's items are dealt to blocks by hash and every two blocks meet once, so a large map is spread over tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        a = pdf[pdf["_b"] == pdf["_i"].iloc[0]][["x", "y", "gx", "gy"]].to_numpy("float64")
        b = a if same else pdf[pdf["_b"] == pdf["_j"].iloc[0]][["x", "y", "gx", "gy"]].to_numpy("float64")
        hits = 0
        for k, row in enumerate(a):
            side = (b[k + 1 :] if same else b) - row
            hits += int((sector(side[:, 0], side[:, 1]) == sector(side[:, 2], side[:, 3])).sum())
        return pd.DataFrame({group: pdf[group].iloc[:1], "hits": [hits]})

    sizes = pairs.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    place = F.pmod(F.xxhash64("item"), F.col("_n").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("_n") - 1)
    dealt = pairs.join(sizes, group).withColumn("_b", place).withColumn("_o", F.explode(others))
    cells = dealt.select(group, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "gx", "gy")), "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    counted = cells.groupBy(group, "_i", "_j").applyInPandas(run, f"{group} {pairs.schema[group].dataType.simpleString()}, hits long")
    return counted.groupBy(group).agg(F.sum("hits").alias("hits"))


def map_similarity(pairs: DataFrame, group: str, rescale: bool = False) -> DataFrame:
    """Direction, facing and distance agreement per map: pairs hold (item, x, y, facing) of truth and guess (gx, gy, gfacing); absent guesses are null.

    Direction compares the sectors of all pairs of a map's items and the initial
    place (0, 0); a pair with a missing guess is wrong. Facing is over items whose
    truth has one, a missing guess is wrong, 1 without such items. Position is
    exp(-rmse / scale) * coverage, the scale being the root mean square of the
    matched truths; rescale: the guess is first stretched by the least-squares factor.
    """
    x, y, gx, gy = (F.col(c).cast("double") for c in ("x", "y", "gx", "gy"))
    met = gx.isNotNull() & gy.isNotNull()
    side = lambda a, b: F.pmod(F.floor((F.pmod(F.degrees(F.atan2(-a, -b)) + 360, F.lit(360.0)) + 22.5) / 45), F.lit(8))
    start = F.coalesce(side(x, y) == side(gx, gy), F.lit(False))
    factor = pairs.where(met).groupBy(group).agg(F.try_divide(F.sum(x * gx + y * gy), F.sum(gx * gx + gy * gy)).alias("_f"))
    rows = pairs.join(factor, group, "left").withColumn("_f", F.col("_f") if rescale else F.lit(1.0))
    error = (gx * F.col("_f") - x) * (gx * F.col("_f") - x) + (gy * F.col("_f") - y) * (gy * F.col("_f") - y)
    n = F.count(F.lit(1))
    scale = F.sqrt(F.avg(F.when(met, x * x + y * y)))
    got = rows.groupBy(group).agg(
        F.sum(start.cast("long")).alias("_start"), (n * (n + 1) / 2).alias("_pairs"),
        F.coalesce(F.avg(F.when(F.col("facing").isNotNull(), F.coalesce((F.col("facing") == F.col("gfacing")).cast("int"), F.lit(0)))), F.lit(1.0)).alias("facing"),
        F.coalesce(F.when(scale > 0, F.exp(-F.sqrt(F.avg(F.when(met, error))) / scale)) * F.count(F.when(met, 1)) / n, F.lit(0.0)).alias("position"),
    )
    got = got.join(agreeing_pairs(pairs, group), group).withColumn("direction", (F.col("hits") + F.col("_start")) / F.col("_pairs"))
    return got.select(group, "direction", "facing", "position", ((F.col("direction") + F.col("facing") + F.col("position")) / 3).alias("overall"))


def segment_messages(segments: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Messages of tagged segments: code and answer are the assistant's, interpreter the tool's; they must alternate."""
    out: list[tuple[str, str]] = []
    for tag, body in segments:
        role = "tool" if tag == "interpreter" else "assistant"
        if (not out and role == "tool") or (out and out[-1][0] == role):
            raise ValueError(f"segment {tag} is out of order")
        out.append((role, body))
    return out


_MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


@F.pandas_udf(_MESSAGES)
def ordered_messages(segments: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("role", "content"), m)) for m in segment_messages([(s["tag"], s["body"]) for s in row])] for row in segments])


def flood(cells: set[tuple[int, int]], start: tuple[int, int]) -> dict[tuple[int, int, int], int]:
    """Fewest moves (forward, turn left, turn right) from (x, y, heading 0) to every state of a grid."""
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    seen = {(*start, 0): 0} if start in cells else {}
    todo = deque(seen)
    while todo:
        x, y, h = todo.popleft()
        dx, dy = steps[h]
        for state in ((x + dx, y + dy, h), (x, y, (h + 1) % 4), (x, y, (h - 1) % 4)):
            if state[:2] in cells and state not in seen:
                seen[state] = seen[(x, y, h)] + 1
                todo.append(state)
    return seen


#: Cells of a room that one task floods; larger ones go through rounds over all states at once.
ROOM_CELLS = 50_000


def _flood_rounds(cells: DataFrame) -> DataFrame:
    """cells: (room, x, y). Rows (room, x, y, heading, moves), a breadth-first round after the other; each frontier is written."""
    spark = cells.sparkSession
    start = cells.groupBy("room").agg(F.min(F.struct("x", "y")).alias("s")).select("room", "s.x", "s.y", F.lit(0).alias("heading"), F.lit(0).alias("moves"))
    seen = front = cut(spark, start, "states")
    ahead = lambda axis, steps: F.col(axis) + F.element_at(F.array(*map(F.lit, steps)), F.col("heading") + 1)
    for moves in count(1):
        gone = front.select("room", ahead("x", (1, 0, -1, 0)).alias("x"), ahead("y", (0, 1, 0, -1)).alias("y"), "heading").join(cells, ["room", "x", "y"], "left_semi")
        turned = front.select("room", "x", "y", F.explode(F.array(*(F.pmod(F.col("heading") + d, F.lit(4)) for d in (1, 3)))).alias("heading"))
        new = gone.union(turned).distinct().join(seen, ["room", "x", "y", "heading"], "left_anti").withColumn("moves", F.lit(moves))
        front = cut(spark, new, "states")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if moves % 20 == 0:
            seen = cut(spark, seen, "states")


def room_distances(df: DataFrame, room: str, local: int = ROOM_CELLS) -> DataFrame:
    """Fewest moves to every state of each room's grid, from its least cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(pdf["x"].tolist(), pdf["y"].tolist()))
        found = flood(cells, min(cells))
        return pd.DataFrame([(pdf["room"].iloc[0], *s, n) for s, n in found.items()], columns=["room", "x", "y", "heading", "moves"])

    src = df.select(F.col(room).cast("string").alias("room"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    large = cut(df.sparkSession, src.groupBy("room").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("room"), "large")
    schema = "room string, x long, y long, heading int, moves int"
    if large.isEmpty():
        return src.groupBy("room").applyInPandas(run, schema)
    small = src.join(large, "room", "left_anti").groupBy("room").applyInPandas(run, schema)
    return small.union(_flood_rounds(cut(df.sparkSession, src.join(large, "room", "left_semi"), "cells")))


def decoded_cases(df: DataFrame, key: str, text: str) -> DataFrame:
    """Test cases (inputs, outputs) of a JSON column; rows that can't be read go. Nothing is unpickled."""
    parsed = F.from_json(text, T._parse_datatype_string("struct<inputs:array<string>,outputs:array<string>>"))
    return df.withColumn("_p", parsed).where("_p.inputs IS NOT NULL AND _p.outputs IS NOT NULL").select(key, "_p.inputs", "_p.outputs")


def aligned_by_uid(batch: DataFrame, output: DataFrame, uid: str) -> DataFrame:
    """Batch columns at each output row of the same uid; an unknown uid is an error."""
    side = batch.withColumn("_known", F.lit(True))
    out = output.join(side, uid, "left")
    return out.withColumn("_known", F.when(F.col("_known"), True).otherwise(F.raise_error(F.lit("unknown uid")).cast("boolean"))).where("_known").drop("_known")


def region_of(position: Column, starts: list[tuple[int, str]]) -> Column:
    """Label of the last span that starts at or before a position."""
    out = F.lit(None).cast("string")
    for at, label in sorted(starts):
        out = F.when(position >= at, F.lit(label)).otherwise(out)
    return out
