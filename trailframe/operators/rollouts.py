"""Rollout tables: token advantages, batch filling, rejection reports, turn rows, seeds, records of text states.

Random choices are hash orders of (seed, purpose, key), as everywhere in the library.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import arrays
from trailframe.operators.advantages import whiten
from trailframe.operators.batch import numbered, running_total
from trailframe.operators.sampling import SEED, group_rows, order_key, uniform


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def _folded(df: DataFrame, seq: str, pos: str, columns: dict[str, str], out: Column) -> DataFrame:
    """Rows (seq, pos, *columns, o) where o are the entries of an array computed from each sequence's arrays in order."""
    got = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), *(F.col(c).alias(n) for n, c in columns.items()))))
    rows = df.groupBy(seq).agg(got.alias("s")).select(seq, "s", *(_field("s", n).alias(n) for n in columns))
    flat = rows.select(seq, F.explode(F.arrays_zip(F.col("s"), out.alias("o"))).alias("z"))
    return flat.select(seq, F.col("z.s.p").alias(pos), *(F.col(f"z.s.{n}").alias(n) for n in columns), F.col("z.o").alias("o"))


def reinforce_plus_plus(df: DataFrame, seq: str, pos: str, reward: str, mask: str, gamma: float) -> DataFrame:
    """Discounted returns that start anew after a masked token, and as advantages their whitened form on the mask: (seq, pos, returns, adv)."""
    rows = _folded(df, seq, pos, {"r": reward, "m": mask}, arrays.discounted_returns(F.col("r"), F.col("m"), gamma))
    rows = whiten(rows.withColumn("on", F.col("m") > 0), "o", "on", "adv")
    return rows.select(seq, pos, F.col("o").alias("returns"), (F.col("adv") * F.col("m")).alias("adv"))


def gae_whitened(df: DataFrame, seq: str, pos: str, reward: str, value: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Generalised advantages, whitened on the mask, and returns from the advantages before that: (seq, pos, adv, returns)."""
    rows = _folded(df, seq, pos, {"r": reward, "v": value, "m": mask}, arrays.gae(F.col("r"), F.col("v"), F.col("m"), gamma, lam))
    rows = whiten(rows.withColumn("on", F.col("m") > 0), "o", "on", "adv")
    return rows.select(seq, pos, "adv", (F.col("o") + F.col("v")).alias("returns"))


def filled_batch(df: DataFrame, batch: str, uid: str, order: str, metric: str, prompts: int, per_prompt: int, most: int = 0) -> DataFrame:
    """Batches in turn without their flat prompt groups, until `prompts` groups are there; then the first prompts * per_prompt rows.

    Too few groups in all batches, or in the first `most` of them, is an error.
    """
    groups = df.groupBy(batch, uid).agg(F.stddev_pop(metric).alias("_s"), F.count(F.lit(1)).alias("_n")).where("_s > 0 OR _n = 1")
    per = df.select(batch).distinct().join(groups.groupBy(batch).agg(F.count(F.lit(1)).alias("_k")), batch, "left").na.fill(0, ["_k"])
    ranked = numbered(running_total(per, [batch], F.col("_k"), "_before"), [batch], "_place").withColumn("_full", F.col("_before") + F.col("_k") >= prompts)
    limit = F.col("_full") if not most else F.col("_full") & (F.col("_place") < most)
    last = ranked.where(limit).agg(F.min(batch).alias("_last"))
    last = last.select(F.coalesce("_last", F.raise_error(F.lit("too few groups differ in their rewards")).cast(ranked.schema[batch].dataType)).alias("_last"))
    rows = df.join(last, F.col(batch) <= F.col("_last")).join(groups.select(batch, uid), [batch, uid], "left_semi")
    return numbered(rows.select(*df.columns), [batch, order], "place").where(F.col("place") < prompts * per_prompt)


def rejection_report(df: DataFrame, seq: str, log_ratio: str, mask: str, high: float, low: float | None = None, level: str = "token") -> DataFrame:
    """One row of what rejection at a level masks, and statistics of its weights over tokens and sequences."""
    low = 1 / high if low is None else low
    on = F.col(mask)
    own = df.groupBy(seq).agg(F.sum(F.when(on, F.col(log_ratio))).alias("_s"), F.count(F.when(on, 1)).alias("_c"))
    x = {"token": F.col(log_ratio), "sequence": F.coalesce("_s", F.lit(0.0)), "geometric": F.coalesce("_s", F.lit(0.0)) / (F.col("_c") + 1e-8)}[level]
    rows = df.join(own, seq).withColumn("_x", x).withColumn("_w", F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("_x")))))
    rows = rows.withColumn("_b", F.greatest(F.lit(low), F.least(F.lit(high), F.col("_w")))).withColumn("_out", (~F.col("_w").between(low, high)).cast("int"))
    total = lambda c: F.coalesce(F.sum(F.when(on, c)), F.lit(0.0))
    per = rows.groupBy(seq).agg(
        F.count(F.when(on, 1)).alias("n"), total(F.col("_w")).alias("w"), total(F.col("_b")).alias("b"), total(F.col("_b") * F.col("_b")).alias("bb"), F.sum(F.when(on, F.col("_out"))).alias("out"), F.max("_out").alias("any_out"),
        F.sum(F.when(on & (F.col("_w") > high), 1).otherwise(0)).alias("hi"), F.sum(F.when(on & (F.col("_w") < low), 1).otherwise(0)).alias("lo"), F.max(F.when(on, F.col("_w"))).alias("top"), F.min(F.when(on, F.col("_w"))).alias("bottom"), F.max("_x").alias("x"),
    ).withColumn("m", F.col("w") / (F.col("n") + 1e-8))
    n = F.sum("n") + 1e-8
    mean, square = F.sum("b") / n, F.sum("bb") / n
    share = lambda c: F.avg(c.cast("int"))
    if level == "token":
        edges = {"fraction_high": F.sum("hi") / n, "fraction_low": F.sum("lo") / n, "max": F.max("top"), "min": F.min("bottom"), "seq_masked_fraction": share(F.col("out") > 0)}
    else:
        edges = {"fraction_high": share(F.col("x") > F.log(F.lit(high))), "fraction_low": share(F.col("x") < F.log(F.lit(low))), "max": F.exp(F.least(F.lit(20.0), F.max("x"))), "min": F.exp(F.min("x")), "seq_masked_fraction": F.avg("any_out")}
    columns = edges | {
        "masked_fraction": F.sum("out") / n, "mean": F.sum("w") / n, "std": F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))).otherwise(0.0), "ess": 1 / (square / ((mean + 1e-8) * (mean + 1e-8))),
        "seq_mean": F.avg("m"), "seq_std": F.coalesce(F.stddev_samp("m"), F.lit(0.0)), "seq_max": F.max("m"), "seq_min": F.min("m"), "seq_max_deviation": F.max(F.abs(F.col("m") - 1)),
        "seq_fraction_high": share(F.col("m") > high), "seq_fraction_low": share(F.col("m") < low),
    }
    return per.agg(*(c.cast("double").alias(k) for k, c in columns.items())).select(F.lit(level).alias("level"), *columns)


def per_turn_rows(df: DataFrame, key: str, rewards: str, infos: str, keys: list[str]) -> DataFrame:
    """Rows (key, turn, reward, success): turn 0 is the reset without a reward, then a row for each reward.

    With one info more than rewards the first belongs to the reset; the first success key present counts, none is false.
    """
    flag = lambda i: F.coalesce(*(i[k] for k in keys), F.lit(False))
    ahead = F.when(F.size(infos) == F.size(rewards) + 1, 1).otherwise(0)
    row = lambda t, r, s: F.struct(t.cast("int").alias("turn"), r.cast("double").alias("reward"), s.alias("success"))
    steps = F.transform(rewards, lambda r, i: row(i + 1, r, F.coalesce(flag(F.get(infos, i + ahead)), F.lit(False))))
    reset = F.when(F.size(infos) > 0, F.array(row(F.lit(0), F.lit(None), flag(F.get(infos, F.lit(0)))))).otherwise(F.slice(steps, 1, 0))
    return df.select(key, F.explode(F.concat(reset, steps)).alias("t")).select(key, "t.*")


def with_fallbacks(df: DataFrame, field: str, infos: str, meta: DataFrame, key: str) -> DataFrame:
    """The row's own field, else its last info's, else its first info's, else that of the meta table."""
    side = meta.select(key, F.col(field).alias("_meta"))
    found = F.coalesce(F.col(field), F.get(infos, F.size(infos) - 1)[field], F.get(infos, F.lit(0))[field], F.col("_meta"))
    return df.join(side, key, "left").withColumn(field, found).drop("_meta")


def seed_rows(specs: DataFrame, seed: int = SEED) -> DataFrame:
    """`n` seeds of each spec, a row (name, n, rule array, seeds array): (name, place, value).

    seeds: the first n of a list. rule: none or empty: any 31-bit number; low, high: a number of that range; low, high, most:
    the same, each number `most` times at most. A spec that can't give n seeds is an error.
    """
    size = F.size(F.coalesce("rule", F.array().cast("array<bigint>")))
    low, high = (F.when(size >= 2, F.get("rule", F.lit(i))).otherwise(F.lit(x).cast("long")) for i, x in ((0, 0), (1, (1 << 31) - 1)))
    plain = specs.select("name", "n", "seeds", size.alias("_size"), low.alias("low"), high.alias("high"), F.get("rule", F.lit(2)).alias("most"))
    wrong = F.when(F.col("seeds").isNotNull(), F.size("seeds") < F.col("n")).when(F.col("_size") > 3, True).when(F.col("_size") < 3, F.col("high") < F.col("low"))
    wrong = wrong.otherwise((F.col("high") < F.col("low")) | (F.col("most") < 1) | ((F.col("high") - F.col("low") + 1) * F.col("most") < F.col("n")))
    fine = plain.where(F.when(wrong, F.raise_error(F.concat(F.lit("the spec can't give its seeds: "), F.col("name"))).cast("boolean")).otherwise(F.col("n") > 0))
    upto = lambda first, last: F.explode(F.sequence(first, last))
    placed = fine.where(F.col("seeds").isNotNull() | (F.col("_size") < 3)).withColumn("place", upto(F.lit(0).cast("long"), F.col("n") - 1))
    drawn = (F.col("low") + F.floor(uniform("seed", "name", "place", seed=seed) * (F.col("high") - F.col("low") + 1))).cast("long")
    open_ = placed.select("name", "place", F.when(F.col("seeds").isNotNull(), F.get("seeds", F.col("place").cast("int"))).otherwise(drawn).alias("value"))
    capped = fine.where(F.col("seeds").isNull() & (F.col("_size") == 3)).withColumn("value", upto(F.col("low"), F.col("high"))).withColumn("copy", upto(F.lit(1).cast("long"), F.col("most")))
    ranked = group_rows(capped.select("name", "n", "value", "copy", order_key("seed", "name", "value", "copy", seed=seed).alias("_h")), "name", ["_h", "value", "copy"], "place", "_n")
    return open_.union(ranked.where(F.col("place") < F.col("n")).select("name", "place", "value"))


def spec_seeds(spark: SparkSession, specs: list[dict], seed: int = SEED) -> DataFrame:
    """`seed_rows` of listed specs (name, n, seeds or rule), checked at once."""
    for s in specs:
        n, rule, seeds = s["n"], tuple(s.get("rule", ())), s.get("seeds")
        if len(rule) > 3 or (seeds is not None and len(seeds) < n) or (seeds is None and len(rule) > 1 and (rule[1] < rule[0] or len(rule) == 3 and (rule[2] < 1 or (rule[1] - rule[0] + 1) * rule[2] < n))):
            raise ValueError(f"the spec can't give its seeds: {s['name']}")
    rows = [(s["name"], s["n"], [x for x in s.get("rule", ()) if isinstance(x, int)], s.get("seeds")) for s in specs]
    return seed_rows(spark.createDataFrame(rows, "name string, n long, rule array<bigint>, seeds array<bigint>"), seed)


#: Moves and their opposites.
OPPOSITES = {"turn_left": "turn_right", "move_forward": "move_backward", "move_left": "move_right", "look_up": "look_down"}
OPPOSITES |= {v: k for k, v in OPPOSITES.items()}


def opposite_action(truth: Column) -> Column:
    """The opposite move; null for anything else."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in OPPOSITES.items() for x in kv)), F.trim(truth))


def other_option(truth: Column, options: Column, *keys: str, seed: int = SEED) -> Column:
    """A hashed choice of the options that aren't the truth; null without one."""
    rest = F.filter(options, lambda o: F.trim(o) != F.trim(truth))
    return F.get(rest, F.floor(uniform("option", *keys, seed=seed) * F.size(rest)).cast("int"))


def near_number(truth: Column, *keys: str, seed: int = SEED) -> Column:
    """The number 1 to 4 away, not below 0 on the way down, and never the truth."""
    delta = 1 + F.floor(uniform("delta", *keys, seed=seed) * 4)
    down = uniform("sign", *keys, seed=seed) < 0.5
    found = F.when(down, F.greatest(F.lit(0), truth - delta)).otherwise(truth + delta)
    return F.when(found == truth, truth + 1).otherwise(found).cast("long")


def _message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


# The layout of the messages about text states.
def forward_records(paths: DataFrame, system: Column) -> DataFrame:
    """paths: (path, nodes, actions). First state and actions ask for the last state: (path, messages)."""
    user = F.concat(F.lit("Current state:\n"), F.get("nodes", F.lit(0)), F.lit("\n\nAction sequence: "), F.array_join("actions", " | "))
    answer = F.concat(F.lit("<prediction>\n"), F.element_at("nodes", -1), F.lit("\n</prediction>"))
    return paths.select("path", F.array(_message("system", system), _message("user", user), _message("assistant", answer)).alias("messages"))


def choice_records(paths: DataFrame, nodes: DataFrame, system: Column, seed: int = SEED) -> DataFrame:
    """The last state among three others of the table `nodes` (node), none of them an end of the path; paths without three are left out.

    The others are the path's next ones on a hashed ring of all states: five rows per path, however many states there are.
    """
    ring = numbered(nodes.select("node").distinct().withColumn("_h", order_key("ring", "node", seed=seed)), ["_h", "node"], "_at").select("node", "_at")
    size = ring.agg(F.count(F.lit(1)).alias("_n"))
    first, last = F.get("nodes", F.lit(0)), F.element_at("nodes", -1)
    start = paths.withColumn("_u", uniform("start", "path", seed=seed)).join(size, F.lit(True))
    wanted = start.select("path", first.alias("_a"), last.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_j"), F.floor(F.col("_u") * F.col("_n")).alias("_s"), "_n").where("_j < _n")
    others = wanted.withColumn("_at", F.pmod(F.col("_s") + F.col("_j"), F.col("_n"))).join(ring, "_at").where("node <> _a AND node <> _b")
    picked = others.groupBy("path").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("_j", "node"))), lambda x: x["node"]), 1, 3).alias("_o")).where(F.size("_o") == 3)
    rows = paths.join(picked, "path").withColumn("_slot", F.floor(uniform("slot", "path", seed=seed) * 4).cast("int"))
    options = F.concat(F.slice("_o", F.lit(1), F.col("_slot")), F.array(last), F.slice("_o", F.col("_slot") + 1, F.lit(3)))
    letters = F.array(*map(F.lit, "ABCD"))
    listed = F.array_join(F.zip_with(letters, options, lambda a, o: F.concat(a, F.lit(")\n"), o)), "\n\n")
    user = F.concat(F.lit("Current state:\n"), first, F.lit("\n\nAction sequence: "), F.array_join("actions", " | "), F.lit("\n\nWhich of the following is the correct resulting state?\n\n"), listed)
    return rows.select("path", F.array(_message("system", system), _message("user", user), _message("assistant", F.get(letters, F.col("_slot")))).alias("messages"))


def inverse_records(edges: DataFrame, system: Column) -> DataFrame:
    """edges: (path, src, dst, action). Two states ask for the action between them."""
    user = F.concat(F.lit("Initial state:\n"), "src", F.lit("\n\nResulting state:\n"), "dst")
    return edges.select("path", F.array(_message("system", system), _message("user", user), _message("assistant", F.col("action"))).alias("messages"))


def reach_records(paths: DataFrame, system: Column) -> DataFrame:
    """One turn per action from the first state to the last; the record ends with the last action."""
    first, last, ask = F.get("nodes", F.lit(0)), F.element_at("nodes", -1), F.lit("\n\nDecide your next action(s).")
    begin = F.concat(F.lit("Initial state:\n"), first, F.lit("\n\nGoal state:\n"), last, F.lit("\n\nCurrent state:\n"), first, ask)
    shown = lambda a, i: F.concat(F.lit("After action '"), a, F.lit("', current state:\n"), F.get("nodes", i + 1), ask)
    turns = F.flatten(F.transform("actions", lambda a, i: F.array(_message("assistant", a), _message("user", shown(a, i)))))
    body = F.slice(turns, F.lit(1), F.greatest(F.lit(0), F.size(turns) - 1))
    return paths.select("path", F.concat(F.array(_message("system", system), _message("user", begin)), body).alias("messages"))


def search_rows(df: DataFrame, question: str, truth: str, source: str, index: str, split: str, system: str, prefix: str, tag: str) -> DataFrame:
    """Prompt, tagged source and nested tool arguments of a search task."""
    name = F.concat(F.lit(tag), F.coalesce(F.col(source).cast("string"), F.lit("")))
    asked = F.coalesce(F.col(question), F.lit(""))
    create = F.struct(F.col(truth).alias("ground_truth"), asked.alias("question"), name.alias("data_source"))
    return df.select(
        name.alias("data_source"), F.array(_message("system", F.lit(system)), _message("user", F.concat(F.lit(prefix.rstrip("\n")), asked))).alias("prompt"),
        F.struct(F.col(index).alias("index"), F.lit(True).alias("need_tools_kwargs"), asked.alias("question"), F.lit(split).alias("split"), F.struct(F.struct(create.alias("create_kwargs")).alias("search")).alias("tools_kwargs")).alias("extra_info"),
    )


def sharegpt_strict(conversations: Column) -> Column:
    """Messages (role, content array of (type, value), loss_weight) of an array of (from, value).

    Unknown roles go, and so do tool calls that aren't JSON; a list of calls is one part each; answers and calls weigh 1.
    """
    roles = F.create_map(*(F.lit(x) for kv in {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}.items() for x in kv))
    call = lambda m: m["from"] == "function_call"
    known = F.filter(conversations, lambda m: F.map_contains_key(roles, m["from"]) & (~call(m) | F.try_parse_json(m["value"]).isNotNull()))
    part = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    listed = lambda v: F.coalesce(F.transform(F.try_variant_get(F.try_parse_json(v), "$", "array<variant>"), lambda x: F.to_json(x)), F.array(F.to_json(F.try_parse_json(v))))
    content = lambda m: F.when(call(m), F.transform(listed(m["value"]), lambda v: part("tool_call", v))).otherwise(F.array(part("text", m["value"])))
    return F.transform(known, lambda m: F.struct(F.element_at(roles, m["from"]).alias("role"), content(m).alias("content"), F.when(m["from"].isin("gpt", "function_call"), 1.0).otherwise(0.0).alias("loss_weight")))


def to_columns(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """A list of rows to a row of lists, for each group."""
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    return df.groupBy(group).agg(got.alias("_s")).select(group, *(_field("_s", c).alias(c) for c in columns))


def to_rows(df: DataFrame, group: str, columns: list[str], place: str = "place") -> DataFrame:
    """A row of lists to a list of rows with their place; lists of different lengths are an error."""
    same = F.lit(True)
    for c in columns[1:]:
        same &= F.size(c) == F.size(columns[0])
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("lists of different lengths")).cast(df.select(F.arrays_zip(*columns)).schema[0].dataType))
    return df.select(group, F.posexplode(zipped).alias(place, "_z")).select(group, place, *(F.col(f"_z.{c}").alias(c) for c in columns))


def save_batch(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A batch and its meta values as Parquet."""
    df.write.parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "meta string").write.parquet(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def merged_by_content(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, content), edges (src, dst, action): nodes of one content become one, the first table's least key first, and edges follow."""
    nodes = old_nodes.withColumn("_t", F.lit(0)).unionByName(new_nodes.withColumn("_t", F.lit(1)))
    kept = nodes.groupBy("content").agg(F.min(F.struct("_t", "node"))["node"].alias("key"))
    to = nodes.join(kept, "content").select("node", "key").distinct()
    src, dst = (to.select(F.col("node").alias(c), F.col("key").alias(f"_{c}")) for c in ("src", "dst"))
    edges = old_edges.unionByName(new_edges).join(src, "src").join(dst, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "action")
    return kept.select(F.col("key").alias("node"), "content"), edges.where("src <> dst").distinct()


def stable_checkpoints(before: DataFrame, now: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings (checkpoint, size, modified) of two polls: checkpoints that didn't change in between and weren't taken before."""
    same = now.join(before, ["checkpoint", "size", "modified"], "left_semi")
    return same.join(seen.select("checkpoint"), "checkpoint", "left_anti")
