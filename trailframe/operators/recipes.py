"""Dataset recipes: dedup, conversion, unpivot, distractors, set scores, step metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.arrays import carry_forward
from trailframe.operators.batch import numbered
from trailframe.operators.sampling import order_key, uniform
from trailframe.storage import cut, shared_dir

#: Roles of the shared-conversation format.
ROLES = {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}


def first_by_content(df: DataFrame, content: Column, pos: str) -> DataFrame:
    """The first row of each content, compared by the hash of its JSON or text."""
    w = Window.partitionBy("_k").orderBy(pos)
    return df.withColumn("_k", F.md5(content.cast("binary"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def latest_turn(df: DataFrame, conv: str, turn: str, score: str) -> DataFrame:
    w = Window.partitionBy(conv).orderBy(F.desc(turn), F.desc(score))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_in_order(df: DataFrame, value: str, pos: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(pos).alias(pos)).orderBy(pos)


def with_required(df: DataFrame, required: list[str], answers: list[str]) -> DataFrame:
    """Required columns, the first present answer column, and the rest packed as JSON; a null required value is an error."""
    rest = [c for c in df.columns if c not in required and c not in answers]
    must = [F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"{c} is missing")).cast("string")).alias(c) for c in required]
    return df.select(*must, F.coalesce(*(F.col(c) for c in answers)).alias("ground_truth"), F.to_json(F.struct(*rest)).alias("extra_info"))


def sharegpt(conversations: Column) -> Column:
    """Messages (role, type, content, loss_weight) of an array of (from, value); unknown roles go; only answers weigh 1."""
    roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    known = F.filter(conversations, lambda m: F.map_contains_key(roles, m["from"]))
    one = lambda m: F.struct(F.element_at(roles, m["from"]).alias("role"), F.when(m["from"] == "function_call", "tool_call").otherwise("text").alias("type"), m["value"].alias("content"), F.when(m["from"] == "gpt", 1.0).otherwise(0.0).alias("loss_weight"))
    return F.transform(known, one)


def alpaca(instruction: Column, extra: Column, output: Column) -> Column:
    user = F.when(F.coalesce(extra, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit("\n"), extra))
    part = lambda r, c, w: F.struct(F.lit(r).alias("role"), c.alias("content"), F.lit(w).alias("loss_weight"))
    return F.array(part("user", user, 0.0), part("assistant", output, 1.0))


def unpivot_pair(df: DataFrame, key: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows of each pair: the chosen answer first."""
    return df.unpivot([key], [chosen, rejected], "kind", "text")


def head_tail(df: DataFrame, row: str, share: float = 0.75) -> DataFrame:
    """Rows numbered from 0, split at a share of their count."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, F.lit(True)).withColumn("split", F.when(F.col(row) < F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_n")


def mcq(correct: Column, wrong: Column, key: str, seed: int = 42) -> Column:
    """(options, letter): the right option at a hashed slot among the wrong ones in hashed order."""
    slot = F.pmod(F.conv(F.substring(order_key("slot", key, seed=seed), 1, 8), 16, 10).cast("long"), (F.size(wrong) + 1).cast("long")).cast("int")
    options = F.concat(F.slice(wrong, F.lit(1), slot), F.array(correct), F.slice(wrong, slot + 1, F.size(wrong)))
    return F.struct(options.alias("options"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), slot + 1, F.lit(1)).alias("letter"))


def distractor_number(truth: Column, key: str, low: int = 0, high: int = 20, seed: int = 42) -> Column:
    """A number in [low, high] other than the truth, by hash."""
    pick = low + F.floor(uniform("number", key, seed=seed) * (high - low)).cast("int")
    return F.when(pick >= truth, pick + 1).otherwise(pick)


def rarity(df: DataFrame, path: str, actions: str) -> DataFrame:
    """Score of each path: its action counts, each by total over the action's frequency."""
    tokens = df.select(path, F.explode(actions).alias("a"))
    freq = tokens.groupBy("a").agg(F.count(F.lit(1)).alias("f"))
    total = freq.agg(F.sum("f").alias("t"))
    return tokens.groupBy(path, "a").agg(F.count(F.lit(1)).alias("n")).join(freq, "a").join(total, F.lit(True)).groupBy(path).agg(F.sum(F.col("n") * F.col("t") / F.col("f")).alias("rarity"))


def path_class(counts: Column) -> Column:
    return F.when(F.forall(counts, lambda n: n == 1), "single").when(F.exists(counts, lambda n: n == 1), "mix").otherwise("multi")


class CappedChoice:
    """Takes rows in order while none of their actions exceeds its share of all actions taken so far."""

    def __init__(self, cap: float, counts: dict[str, int] | None = None, begun: bool = False) -> None:
        self.cap, self.counts, self.begun = cap, dict(counts or {}), begun
        self.total = sum(self.counts.values())

    def take(self, actions: list[str]) -> bool:
        own = Counter(actions)
        total = self.total + len(actions)
        if self.begun and any(self.counts.get(a, 0) + n > self.cap * total for a, n in own.items()):
            return False
        for a, n in own.items():
            self.counts[a] = self.counts.get(a, 0) + n
        self.total, self.begun = total, True
        return True


#: Rows of a range of the ordered scan.
RANGE_ROWS = 100_000


def balanced_rows(df: DataFrame, key: str, actions: str, score: str, target: int, cap: float = 0.15, rows: int = RANGE_ROWS) -> DataFrame:
    """The chosen rows (all, if fewer than `target`), with `pass`: 1 under the cap, by falling score, 2 filled up without it.

    The order is written in ranges, each scanned by one task that starts from the counts of the one before; only these counts
    (one per action) pass from range to range, and the scan ends when the target is reached.
    """
    spark = df.sparkSession
    placed = numbered(df, [F.desc(score), key], "_place").withColumn("_range", F.floor(F.col("_place") / rows))
    path = shared_dir(spark, "ranges")
    placed.write.partitionBy("_range").parquet(path)
    dealt = spark.read.schema(placed.schema).parquet(path)
    last = dealt.agg(F.max("_range")).first()[0]
    taken, counts, chosen = 0, {}, []
    for r in range(-1 if last is None else int(last) + 1):
        if taken >= target:
            break

        def scan(pdfs: Iterator[pd.DataFrame], counts=counts, left=target - taken, begun=taken > 0) -> Iterator[pd.DataFrame]:
            choice, n = CappedChoice(cap, counts, begun), 0
            own = pd.concat([pd.DataFrame({"_place": [], actions: []}), *pdfs]).sort_values("_place")  # a range
            places = []
            for place, acts in zip(own["_place"], own[actions]):
                if n == left:
                    break
                if choice.take(list(acts)):
                    places.append(place)
                    n += 1
            n_left = len(choice.counts)
            yield pd.DataFrame({"_place": pd.array([*places, *[None] * n_left], "Int64"), "action": [*[None] * len(places), *choice.counts], "n": pd.array([*[None] * len(places), *choice.counts.values()], "Int64")})

        found = cut(spark, dealt.where(F.col("_range") == r).select("_place", actions).coalesce(1).mapInPandas(scan, "_place long, action string, n long"), "choice")
        counts = {x["action"]: x["n"] for x in found.where("action IS NOT NULL").collect()}
        picked = found.where("_place IS NOT NULL").select("_place")
        taken += picked.count()
        chosen.append(picked)
    first = reduce(DataFrame.union, chosen) if chosen else dealt.select("_place").limit(0)
    rest = dealt.join(first, "_place", "left_anti")
    filled = numbered(rest, ["_place"], "_n").where(F.col("_n") < target - taken).drop("_n").withColumn("pass", F.lit(2))
    return dealt.join(first, "_place", "left_semi").withColumn("pass", F.lit(1)).unionByName(filled).select(*df.columns, "pass")


def bucket_selection(df: DataFrame, bucket: str, key: str, per_bucket: int, total: int, seed: int = 42) -> DataFrame:
    """Up to a quota per bucket, then the leftovers in hashed order up to the total."""
    w = Window.partitionBy(bucket).orderBy("_h", key)
    rows = df.withColumn("_h", order_key("bucket", key, seed=seed)).withColumn("_late", F.row_number().over(w) > per_bucket)
    return rows.orderBy("_late", "_h", key).limit(total).drop("_h", "_late")


def set_scores(pred: DataFrame, gold: DataFrame, group: str, item: str) -> DataFrame:
    """Precision, recall and F1 of item sets per group; 0 for an empty prediction."""
    p, g = pred.select(group, item).distinct().withColumn("p", F.lit(1)), gold.select(group, item).distinct().withColumn("g", F.lit(1))
    n = p.join(g, [group, item], "full").groupBy(group).agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return n.select(group, share("hit", F.col("n_pred")).alias("precision"), share("hit", F.col("n_gold")).alias("recall"), share("hit", (F.col("n_pred") + F.col("n_gold")) / 2).alias("f1"))


def carried_average(df: DataFrame, group: str, values: str) -> DataFrame:
    """Mean per place of ragged arrays, shorter ones continued with their last value."""
    longest = df.groupBy(group).agg(F.max(F.size(values)).alias("_n"))
    rows = df.join(longest, group).select(group, F.posexplode(carry_forward(F.col(values), F.col("_n"))).alias("place", "v"))
    return rows.groupBy(group, "place").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def overlap_means(df: DataFrame, item: str, image: str, value: str) -> DataFrame:
    """Mean and deviation of values of items seen in several images against those in one."""
    kind = df.groupBy(item).agg((F.count_distinct(image) >= 2).alias("shared"))
    return df.join(kind, item).groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"))


def nearest(points: DataFrame, explored: DataFrame, group: str, key: str, x: str) -> DataFrame:
    """Distance on a line from each point to its group's nearest explored one; infinity without any.

    The nearest neighbours before and after come from ordered windows, so pairs aren't made.
    """
    both = points.select(group, key, F.col(x).alias("_x"), F.lit(0).alias("_e")).union(explored.select(group, F.lit(None).cast(points.schema[key].dataType), F.col(x), F.lit(1)))
    seen = F.max(F.when(F.col("_e") == 1, F.col("_x"))).over(Window.partitionBy(group).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("_e") == 1, F.col("_x"))).over(Window.partitionBy(group).orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_a", F.col("_x") - seen).withColumn("_b", ahead - F.col("_x")).where("_e = 0")
    return out.select(group, key, F.coalesce(F.least("_a", "_b"), F.lit(float("inf"))).alias("distance"))


def weight_shares(df: DataFrame, row: str, weight: str, masked: Column) -> DataFrame:
    """Share of each row's weight on masked columns; an empty row divides by 1."""
    total = F.sum(weight)
    return df.groupBy(row).agg((F.coalesce(F.sum(F.when(masked, F.col(weight))), F.lit(0.0)) / F.when(total == 0, 1.0).otherwise(total)).alias("share"))


#: Reduction of a step metric by its name, the first that matches; weighted averages are asked for by name.
STEP_RULES = {"time_sum": F.sum, "timing_s": F.sum, "avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "total": F.sum}


def step_metrics(df: DataFrame, name: str, value: str, step: str, weight: str | None = None, weighted: tuple[str, ...] = ()) -> DataFrame:
    """One value per metric: by its name's rule, the last step's otherwise."""
    rule = F.when(F.col(name).isin(*weighted), "weighted") if weighted else F.when(F.lit(False), "")
    for word in STEP_RULES:
        rule = rule.when(F.col(name).contains(word), {"time_sum": "sum", "timing_s": "sum", "avg": "avg", "mean": "avg", "total": "sum"}.get(word, word))
    per = df.withColumn("rule", rule.otherwise("last")).groupBy(name, "rule").agg(
        F.sum(value).alias("_sum"), F.avg(value).alias("_avg"), F.max(value).alias("_max"), F.min(value).alias("_min"), F.max_by(value, step).alias("_last"),
        (F.sum(F.col(value) * F.col(weight or value)) / F.sum(weight or value)).alias("_weighted") if weight else F.lit(None).cast("double").alias("_weighted"),
    )
    out = F.when(F.lit(False), 0.0)
    for r in ("sum", "avg", "max", "min", "last", "weighted"):
        out = out.when(F.col("rule") == r, F.col(f"_{r}").cast("double"))
    return per.select(name, "rule", out.alias("value"))


def assembly_stats(df: DataFrame, seconds: str, version: str, partial: Column) -> DataFrame:
    """Times and parameter versions of all samples of a batch."""
    return df.agg(
        F.avg(seconds).alias("avg"), F.max(seconds).cast("double").alias("max"), F.min(seconds).cast("double").alias("min"), *(F.percentile(seconds, F.lit(q)).alias(n) for n, q in (("tp50", 0.5), ("tp95", 0.95), ("tp99", 0.99))),
        F.count_distinct(version).alias("versions"), F.count_if(partial).alias("partial"), F.avg(partial.cast("int")).alias("partial_ratio"), (F.max(version) - F.min(version)).cast("long").alias("span"),
    )


def choice_quality(df: DataFrame, group: str, count: str, most: int) -> DataFrame:
    """Sum of log2(M / C) over N * log2 M, counts from 1; 0 where it doesn't apply."""
    c = F.greatest(F.lit(1), F.col(count))
    return df.groupBy(group).agg(F.coalesce(F.try_divide(F.sum(F.log2(F.lit(float(most)) / c)), F.count(F.lit(1)) * F.log2(F.lit(float(most)))), F.lit(0.0)).alias("quality"))


def arc_consistent(cells: DataFrame, constraints: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates (var, value) that keep support under every constraint (a, b, kind) with allowed (kind, x, y)."""
    from trailframe.storage import cut

    spark = cells.sparkSession
    sym = constraints.select("a", "b", "kind", F.lit(False).alias("turned")).union(constraints.select(F.col("b"), F.col("a"), "kind", F.lit(True)))
    pairs = allowed.select("kind", "x", "y", F.lit(False).alias("turned")).union(allowed.select("kind", F.col("y"), F.col("x"), F.lit(True)))
    now = cut(spark, cells.select("var", "value").distinct(), "domain")
    size = now.count()
    while True:  # each round takes values away, or is the last
        need = now.join(sym, F.col("var") == F.col("a")).select("var", "value", "b", "kind", "turned")
        other = now.select(F.col("var").alias("b"), F.col("value").alias("y"))
        held = need.join(pairs, [need["kind"] == pairs["kind"], need["turned"] == pairs["turned"], need["value"] == pairs["x"]]).select(need["var"], need["value"], need["b"], need["kind"], need["turned"], pairs["y"]).join(other, ["b", "y"], "left_semi").select("var", "value", "b", "kind", "turned").distinct()
        lost = need.join(held, ["var", "value", "b", "kind", "turned"], "left_anti").select("var", "value").distinct()
        now = cut(spark, now.join(lost, ["var", "value"], "left_anti"), "domain")
        left = now.count()
        if left == size:
            return now
        size = left


def detected_fields(df: DataFrame, json: str) -> DataFrame:
    """Top-level fields of a JSON column: (field, n, n_distinct, numeric, groupable).

    numeric: numbers in at least half of the rows, with a range of 1e-9 or more;
    groupable: between 2 distinct values and 90 % of the rows.
    """
    rows = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    v = F.col("value").try_cast("double")
    per = rows.groupBy("field").agg(F.count("value").alias("n"), F.count_distinct("value").alias("n_distinct"), F.count(v).alias("_c"), (F.max(v) - F.min(v)).alias("_r")).join(total, F.lit(True))
    numeric = (F.col("_c") * 2 >= F.col("_t")) & (F.col("_r") >= 1e-9)
    return per.select("field", "n", "n_distinct", F.coalesce(numeric, F.lit(False)).alias("numeric"), ((F.col("n_distinct") >= 2) & (F.col("n_distinct") <= 0.9 * F.col("_t"))).alias("groupable"))
