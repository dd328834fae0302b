"""Rollups, advantages, batches, sampling and graphs on hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from trailframe.operators import advantages, aggregates, batch, graph, joins, recipes, retrieval, sampling, sft, trajectories
from trailframe.operators.retrieval import bm25_topk, dense_topk
from trailframe.registry import Registry


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def group(spark, values, name="g"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "g string, i long, r double")


def test_transitions_skip_a_missing_action(spark):
    df = spark.createDataFrame([("t", 0, "s0", None), ("t", 1, None, None), ("t", 2, "s1", None), ("t", 3, None, "a1"), ("t", 4, "s2", None)], "traj string, n long, s string, a string")
    assert [r[1:4] for r in rows(trajectories.transitions(df, "traj", ["n"], "s", "a"))] == [("s1", "a1", "s2")]


def test_edges(spark):
    t = spark.createDataFrame([("A", "a|b", "B", 1), ("A", "c", "B", 2), ("A", "d", "B", 3), ("A", "x", "A", 4)], "src string, action string, dst string, ord long")
    assert [(r["src"], r["dst"], r["action"]) for r in graph.shorter_wins(graph.build_edges(t)).collect()] == [("A", "B", "c")]


def test_tolerant_dedup_is_greedy(spark):
    df = spark.createDataFrame([("b", 0, 0.0), ("b", 1, 0.0008), ("b", 2, 0.0016)], "b string, o long, v double")
    assert [r["rep"] for r in graph.dedup_tolerant(df, "b", "o", ["v"], 0.001).orderBy("o").collect()] == [0, 0, 2]


def edges(spark, spec):
    return spark.createDataFrame([(s, d, a, i) for i, (s, a, d) in enumerate(spec)], "src string, dst string, action string, ord long")


def test_refinement(spark):
    e = edges(spark, [("p", "a", "x"), ("p", "a", "y"), ("x", "b", "s"), ("q", "c|d", "r")])
    merged = graph.congruent(graph.split_multi(e))
    real = {(r["src"], r["action"], r["dst"]) for r in merged.collect() if "__virt_" not in r["src"] + r["dst"]}
    assert real == {("p", "a", "x"), ("x", "b", "s")}
    back = {(r["src"], r["action"], r["dst"]) for r in graph.collapse_virtual(merged).collect()}
    assert ("q", "c | d", "r") in back and len(back) == 3


def test_redundant_edges(spark):
    e = edges(spark, [("u", "a|b", "v"), ("u", "a", "w"), ("w", "b", "v")])
    assert {(r["src"], r["dst"]) for r in graph.drop_redundant(e).collect()} == {("u", "w"), ("w", "v")}


def test_graph_statistics(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    e = edges(spark, [("A", "x", "B"), ("A", "y", "B")])
    assert rows(graph.degrees(nodes, e).select("node", "degree"), "node") == [("A", 2), ("B", 2), ("C", 0)]
    assert graph.degree_report(graph.degrees(nodes, e)).first()["isolated"] == 1
    assert graph.component_stats(e).first()["avg_degree_simple"] == 1.0
    labelled = graph.weak_components(nodes, e)
    assert rows(labelled, "node") == [("A", "A"), ("B", "A"), ("C", "C")]
    assert rows(graph.component_sizes(labelled, e).select("component", "avg_degree_multi"), "component") == [("A", 2.0), ("C", 0.0)]


def test_paths_and_cycles(spark):
    e = edges(spark, [("a", "1", "b"), ("b", "2", "c"), ("c", "3", "a"), ("c", "4", "d"), ("e", "5", "f")])
    assert dict(rows(graph.strong_components(e))) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    assert graph.shortest_path(e, "a", "d") == {"length": 3, "path": ["a", "b", "c", "d"], "actions": ["1", "2", "4"]}
    assert graph.shortest_path(e, "d", "a")["length"] == -1
    assert graph.shortest_path(e, "a", "zz")["length"] is None
    assert graph.component_stats(e).where("component = 'a'").first()["diameter"] == 2
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    own, inner = graph.cluster(nodes, e, graph.weak_components(nodes, e).withColumnRenamed("component", "label"), "a", min_degree=2)
    assert sorted(r["node"] for r in own.collect()) == ["a", "b", "c"] and inner.count() == 3
    got = graph.node_detail(e, "c").first()
    assert [x["node"] for x in got["out_edges"]] == ["a", "d"] and [x["node"] for x in got["in_edges"]] == ["b"]


def test_walks(spark):
    e = edges(spark, [("a", "1", "b"), ("b", "2", "c"), ("c", "3", "d"), ("b", "4", "d")])
    for r in graph.random_walks(e, 40, 2, 3).collect():
        assert len(set(r["nodes"])) == len(r["nodes"]) == len(r["actions"]) + 1 and 2 <= len(r["actions"]) <= 3


def adv(df, column):
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_advantages(spark):
    two, single = group(spark, [1, 3]), group(spark, [5])
    assert [round(x, 8) for x in adv(two, advantages.grpo("r", "g"))] == [-0.70710628, 0.70710628]
    assert math.isclose(adv(single, advantages.grpo("r", "g"))[0], 5 / (1 + 1e-6))
    assert adv(two, advantages.rloo("r", "g")) == [-2.0, 2.0]
    assert adv(single, advantages.rloo("r", "g")) == [5.0] and adv(single, advantages.rloo("r", "g", single=False)) == [0.0]
    assert [round(x, 6) for x in adv(group(spark, [1, 3, 2]), advantages.best_only("r", "g", "i"))] == [0.0, round(1 / (1 + 1e-6), 6), 0.0]
    with pytest.raises(Exception, match="two rows"):
        adv(single, advantages.best_only("r", "g", "i"))
    flat = group(spark, [1, 3, 3]).union(group(spark, [5, 4], None)).union(spark.createDataFrame([("h", 0, None), ("h", 1, 2.0)], "g string, i long, r double"))
    for scale in (True, False):
        by_window = flat.select("g", "i", advantages.best_only("r", "g", "i", scale).alias("adv"))
        assert sorted(rows(advantages.best_leads(flat, "r", "g", "i", scale).select("g", "i", "adv")), key=str) == sorted(rows(by_window), key=str)
    with pytest.raises(Exception, match="two rows"):
        advantages.best_leads(single, "r", "g", "i").collect()
    assert adv(two.withColumn("n", F.col("r")), advantages.opo("r", "g", "n")) == [-1.5, 0.5]


def variances(spark):
    """Groups with variances 5, 3 and 2."""
    return spark.createDataFrame([(g, s * math.sqrt(v)) for g, v in (("a", 5), ("b", 3), ("c", 2)) for s in (-1, 1)], "g string, r double")


def test_reward_filters(spark):
    df = variances(spark)
    kept = advantages.top_p_groups(df, "g", "r", 0.79)
    assert {(r["g"], round(r["scale"], 6)) for r in kept.collect()} == {("a", round(math.sqrt(2 / 3), 6)), ("b", round(math.sqrt(2 / 3), 6))}
    five = spark.createDataFrame([(str(g), float(x)) for g in range(5) for x in (0, g)], "g string, r double")
    assert {r["g"] for r in advantages.top_groups(five, "g", "r", 0.2).collect()} == {"4"}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 2.0)], "g string, r double")
    assert {r["g"] for r in advantages.drop_flat_groups(flat, "g", "r").collect()} == {"b", "c"}


def test_reductions(spark):
    df = spark.createDataFrame([(1.0, 0.8, 5.0, 0.1), (2.0, 0.9, 8.0, 0.05), (3.0, 0.7, 6.0, 0.2)], "loss double, accuracy double, max_reward double, min_error double")
    got = aggregates.reduce_by_name(df, df.columns).first()
    assert [round(x, 6) for x in got] == [2.0, 0.8, 8.0, 0.05]
    votes = spark.createDataFrame([("u", "A", 0.9, 0), ("u", "B", 0.8, 1), ("u", "A", 0.7, 2)], "u string, p string, v double, i long")
    assert aggregates.majority(votes, "u", "p", "v", "i").first()["value"] == 0.9
    boot = aggregates.bootstrap(group(spark, [1, 2, 3, 4, 5]), "g", "r", 100, 3).first()
    assert abs(boot["mean_mean"] - 3) < 0.3 and 3.5 < boot["max_mean"] < 5
    assert round(aggregates.best_of_n(group(spark, [1, 2]), "g", "r", 2).first()["best"], 6) == 1.75


def test_tri_state(spark):
    df = spark.createDataFrame([(True, "x", "p"), (True, "x", "q"), (False, "y", "p"), (None, "y", "p")], "f boolean, b string, g string")
    got = next(r for r in aggregates.tri_state_stats(df, "f", "b", "g").collect() if r["level"] == "overall")
    assert (round(got["true_rate"], 6), got["missing_rate"]) == (round(2 / 3, 6), 0.25)


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0) for i in range(12)], "x double, y double, c double")
    assert round(aggregates.spearman(df, "x", "y").first()["rho"], 6) == 1.0
    assert aggregates.spearman(df, "x", "c").first()["rho"] == 0.0
    r = aggregates.pearson(df, "x", "y").first()
    assert 0.9 < r["r"] < 1 and r["p"] < 1e-4
    assert aggregates.pearson(df, "x", "c").first()["r"] is None
    assert round(aggregates._p_value(0.5, 27), 4) == 0.0079


def test_tolerances():
    segments = joins.tolerance_segments("0.5,30;3-5:1,30;1,60")
    pick = lambda n: next((p, a) for lo, hi, p, a in segments if lo <= n and (hi is None or n <= hi))
    assert [pick(n) for n in (2, 3, 5, 6)] == [(0.5, 30), (1, 30), (1, 30), (1, 60)]
    with pytest.raises(ValueError, match="default"):
        joins.tolerance_segments("3-5:1,30;1,60")


def test_coverage(spark):
    df = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("t", 1, 2), ("t", 1, 3)], "t string, n long, v long")
    got = trajectories.coverage(df, "t", "n", "v", spark.createDataFrame([(3,)], "v long"))
    assert [(r["seen"], r["new"], r["hits"]) for r in got.orderBy("n").collect()] == [(2, 2, 0), (3, 1, 1)]


def test_recent_window_and_salvage(spark):
    df = spark.createDataFrame([("c", i) for i in range(1, 7)], "c string, n long")
    assert sorted(r["n"] for r in trajectories.recent_window(df, "c", "n", 2).where("target = 5").collect()) == [1, 4, 5]
    tries = spark.createDataFrame([("r", 1, 1, True, "x"), ("r", 2, 1, False, None), ("r", 1, 2, False, None), ("r", 2, 2, False, None)], "r string, n long, a long, ok boolean, b string")
    original = spark.createDataFrame([("r", 1, "o1"), ("r", 2, "o2")], "r string, n long, b string")
    assert [r["b"] for r in trajectories.salvage(tries, original, "r", "n", "a", "ok", "b").orderBy("n").collect()] == ["x", "o2"]


def test_zip_and_align(spark):
    a = spark.createDataFrame([(0, 1.0, "x"), (1, float("nan"), None)], "n long, v double, s string")
    assert joins.zip_columns(a, a.select("n", "v", F.lit(1).alias("w")), "n").count() == 2
    with pytest.raises(Exception, match="differs"):
        joins.zip_columns(a, a.select("n", (F.col("v") + 1).alias("v")), "n").collect()


def test_quotas(spark):
    assert sampling.ratio_quotas([6, 2, 2], 10, [3, 5, 9]) == [3, 5, 2]
    assert sampling.ratio_quotas([1, 0, 0], 10, [3, 9, 9]) == [3, 0, 0]
    for n, want in ((10, [8, 1, 1]), (7, [5, 1, 1])):
        got = spark.range(1).select(*(q.alias(str(i)) for i, q in enumerate(sampling.quotas([80, 10, 10], F.lit(n))))).first()
        assert list(got) == want


def test_splits_and_mixes(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 10).alias("g"))
    got = sampling.group_split(df, "g", ["a", "b", "c"], [8, 1, 1])
    assert got.select("g", "split").distinct().groupBy("split").count().where("split = 'a'").first()["count"] == 8
    assert sampling.take(df, "id", 7).count() == 7 and sampling.resampled(df, "id", 50).count() == 50
    over = sampling.interleaved(df.where("g < 2 AND (g = 0 OR id < 50)"), "g", "id", mode="over")
    assert {r["count"] for r in over.groupBy("g").count().collect()} == {20}
    hot = df.withColumn("g", F.when(F.col("id") >= 150, F.lit(None)).when(F.col("id") < 120, 1).otherwise(2))
    once = sampling.interleaved(hot, "g", "id", mode="once")
    assert {r["g"]: r["l"] for r in once.groupBy("g").agg(F.sort_array(F.collect_list("round")).alias("l")).collect()} == {g: list(range(1, n + 1)) for g, n in ((1, 120), (2, 30), (None, 50))}
    assert sampling.interleaved(hot, "g", "id").count() == 90 and sampling.interleaved(hot.where("false"), "g", "id").count() == 0
    ring = {r["id"]: r["l"] for r in sampling.negatives(hot, "g", "id", 3).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("slot", "negative"))).alias("l")).collect()}
    order = [r["id"] for r in hot.where("g = 1").orderBy(sampling.order_key("ring", "id"), "id").collect()]
    assert len(ring) == 200 and all([n["negative"] for n in ring[k]] == [order[(i + s) % 120] for s in (1, 2, 3)] for i, k in enumerate(order))
    draws = sampling.weighted_draws(spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 1.0)], "k long, w double"), "k", "w", 400)
    n = {r["k"]: r["count"] for r in draws.groupBy("k").count().collect()}
    assert 1 not in n and sum(n.values()) == 400 and 250 < n[2] < 350
    neg = sampling.negatives(df, "g", "id", 3)
    assert neg.count() == 600 and neg.where("id = negative").count() == 0


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    assert [r["chunk"] for r in batch.chunked(df, "n", 4).orderBy("n").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r["n"] for r in batch.sliced(df, "n", 2, 9, 3).orderBy("n").collect()] == [2, 5, 8]
    for divisor in (3, 4, 5, 32):
        got = batch.padded(df, "n", divisor)
        assert sorted(r["n"] for r in got.collect()) == list(range(-(-10 // divisor) * divisor)) and got.where("NOT is_pad").count() == 10
    back = batch.unfolded(batch.folded(df.withColumn("v", F.col("n") * 2), "n", 5, ["v"]), "fold", 5, ["v"], "n")
    assert rows(back, "n") == [(i, 2 * i) for i in range(10)]
    assert [r["row_no"] for r in batch.numbered(df, [F.desc("n")]).orderBy("n").collect()] == list(range(9, -1, -1))
    epochs = batch.mini_batches(df, ["n"], 4, 2, 7)
    assert epochs.groupBy("epoch", "batch").count().count() == 6
    with pytest.raises(ValueError, match="differs"):
        batch.concat([df, df], [{"a": 1}, {"a": 2}])


def test_balancing(spark):
    sizes = [8, 7, 6, 5, 4, 3, 2, 1]
    parts = batch.karmarkar_karp(sizes, 2)
    assert sorted(i for p in parts for i in p) == list(range(8)) and {sum(sizes[i] for i in p) for p in parts} == {18}
    equal = batch.karmarkar_karp(sizes, 4, equal=True)
    assert {len(p) for p in equal} == {2} and {sum(sizes[i] for i in p) for p in equal} == {9}
    assert batch.least_loaded([3, 1, 2], 2) == [[0], [1, 2]]
    micro = batch.micro_batches(sizes, 12)
    assert len(micro) == 3 and sorted(i for p in micro for i in p) == list(range(8))
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "b long, i long, s long")
    assert batch.imbalance(batch.balanced(df, "b", "i", "s", 2), "part", "size").first()["gap"] == 0


def test_recipes(spark):
    df = spark.createDataFrame([("u", 0, 2.0), ("v", 5, 1.0)], "g string, k long, x double")
    far = recipes.nearest(df, df.where("g = 'u'"), "g", "k", "x")
    assert dict((r["g"], r["distance"]) for r in far.collect()) == {"u": 0.0, "v": float("inf")}
    conv = spark.createDataFrame([(["system", "human", "function_call", "observation", "gpt", "x"],)], "w array<string>").select(F.transform("w", lambda w: F.struct(w.alias("from"), F.lit("1").alias("value"))).alias("c"))
    got = conv.select(recipes.sharegpt(F.col("c")).alias("m")).first()["m"]
    assert [m["role"] for m in got] == ["system", "user", "assistant", "tool", "assistant"] and [m["loss_weight"] for m in got] == [0, 0, 0, 0, 1] and got[2]["type"] == "tool_call"
    cells = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3)], "var string, value long")
    less = spark.createDataFrame([("lt", a, b) for a in range(4) for b in range(4) if a < b and b < 3], "kind string, x long, y long")
    kept = recipes.arc_consistent(cells, spark.createDataFrame([("x", "y", "lt")], "a string, b string, kind string"), less)
    assert rows(kept, "var", "value") == [("x", 1), ("y", 2)]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, "green")], "d long, t string")
    got = bm25_topk(docs, "d", "t", spark.createDataFrame([(9, "Red fox")], "q long, x string"), "q", "x", 2)
    assert [r["d"] for r in got.orderBy("rank").collect()] == [1, 2]
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)] + [(7, None)], "k long, v array<double>")
    top = dense_topk(v.where("k = 2"), v, "k", "v", 3)
    assert [(r["doc_id"], r["score"]) for r in top.orderBy("rank").collect()] == [(2, 5.0), (5, 5.0), (1, 3.0)]


def test_retrieval_against_brute_force(spark, monkeypatch):
    """Blocks of two queries, steps of seven documents and of nine additions give the definition's rows; terms are shared unevenly."""
    import random

    for name, value in (("MAX_QUERIES", 2), ("STEP", 7), ("ADDITIONS", 9)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "", "W1  w2\tw1\n"]
    asked = [(i, " ".join(word() for _ in range(6))) for i in range(5)] + [(5, None), (6, "nowhere"), (7, "W1 w1")]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(3)
    got = retrieval.bm25_topk(docs, "d", "t", spark.createDataFrame(asked, "q long, x string"), "q", "x", 4)
    bags = [(t or "").lower().split() for t in texts]
    mean = sum(map(len, bags)) / (len(bags) - 1)
    want = []
    for q, x in asked:
        scored = []
        for d, bag in enumerate(bags):
            hits = [t for t in set((x or "").lower().split()) if t in bag]
            df = {t: sum(t in o for o in bags) for t in hits}
            s = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag.count(t) / (bag.count(t) + 0.9 * (0.6 + 0.4 * len(bag) / mean)) for t in hits)
            if hits:
                scored.append((-round(s, 6), d))
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:4])]
    assert [(q, d, round(s, 6), r) for q, d, s, r in rows(got, "q", "d", "score", "rank")] == sorted(want)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(vectors, "k long, v array<double>").repartition(3)
    top = dense_topk(v.where("k < 5"), v, "k", "v", 3)
    want = [(q, d, s, i + 1) for q, a in vectors[:5] for i, (s, d) in enumerate([(-s, d) for s, d in sorted((-sum(x * y for x, y in zip(a, b)), d) for d, b in vectors)[:3]])]
    assert rows(top, "query_id", "doc_id", "score", "rank") == sorted(want)
    assert retrieval.bm25_topk(docs.where("false"), "d", "t", spark.createDataFrame(asked, "q long, x string"), "q", "x", 4).count() == 0


def test_image_quality_predicate(spark):
    cases = [([0.0, 20.0], True), ([0.0, 19.0], False), ([255.0] * 7 + [0.0] * 3, True), ([255.0] * 8 + [0.0] * 2, False), ([], False), (None, False), ([0.0, None], False), ([0.0, float("nan")], False), ([0.0, float("inf")], False)]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i long, p array<double>").select("i", sft.image_passes(F.col("p")).alias("ok"))
    assert [ok for _, ok in rows(got, "i")] == [want for _, want in cases]


def test_registry():
    r = Registry("metric")
    r.register("a")(lambda x: x + 1)
    r.register("b")(lambda x: x / 0)
    out = r.run_all(1)
    assert out["a"] == 2 and isinstance(out["b"], ZeroDivisionError)
