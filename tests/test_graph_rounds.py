"""Distributed graph steps against plain ones, in a task and in rounds."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import connectivity, refinement, tolerance
from trailframe.operators import graph as G

EDGE = "src string, dst string, action string, ord long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graph(rng, n, m):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", " | ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), i) for i in range(m)]


def reach(near, start):
    seen, todo = {start}, [start]
    while todo:
        new = near[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


def strong_brute(edges):
    near, nodes = defaultdict(set), set()
    for s, d, *_ in edges:
        near[s].add(d)
        nodes |= {s, d}
    seen = {n: reach(near, n) for n in nodes}
    return sorted((n, min(m for m in nodes if m in seen[n] and n in seen[m])) for n in nodes)


@pytest.mark.parametrize("local", [connectivity.LOCAL, 4])
def test_strong_components(spark, local):
    edges = graph(random.Random(local), 30, 45) + [("loop", "loop", "a", 99), ("n1", "n2", "a", 100), ("n1", "n2", "b", 101)]
    assert rows(connectivity.strong_components(spark.createDataFrame(edges, EDGE), local)) == strong_brute(edges)
    assert connectivity.strong_components(spark.createDataFrame([], EDGE), local).count() == 0


def test_one_giant_component_goes_through_no_single_task(spark, monkeypatch):
    n = 3000
    ring = [(f"r{i}", f"r{(i * 7 + 1) % n}", "a", i) for i in range(n)] + [(f"r{i}", f"r{(i + 1) % n}", "a", n + i) for i in range(n)] + [(f"r{i}", f"t{i}", "a", 2 * n + i) for i in range(n)]
    monkeypatch.setattr(connectivity, "strong_of", None)
    got = dict(connectivity.strong_components(spark.createDataFrame(ring, EDGE), local=100).collect())
    assert {v for k, v in got.items() if k[0] == "r"} == {"r0"} and all(got[f"t{i}"] == f"t{i}" for i in range(n))


def test_names_are_numbered_not_hashed(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # all names collide
    edges = spark.createDataFrame([("a", "b", "x", 0), ("c", "d", "x", 1)], EDGE)
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert dict(connectivity.weak_components(nodes, edges).collect()) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_shortest_paths(spark):
    rng = random.Random(5)
    edges = graph(rng, 25, 50) + [(f"c{i}", f"c{i + 1}", "go", 100 + i) for i in range(11)]
    near = defaultdict(list)
    for s, d, a, _ in edges:
        near[s].append((d, a))
    df = spark.createDataFrame(edges, EDGE)
    for src, dst in (("n0", "n7"), ("c0", "c11"), ("n3", "n3"), ("c3", "c1"), ("n0", "none")):
        seen, queue = {src: (0, None, None)}, [src]
        for x in queue:
            for d, a in near[x]:
                hops = seen[x][0] + 1
                if d not in seen:
                    queue.append(d)
                if d not in seen or (seen[d][0] == hops and (x, a) < seen[d][1:]):
                    seen[d] = (hops, x, a)
        got = G.shortest_path(df, src, dst)
        if dst == "none":
            assert got == {"length": None, "error": "unknown node"}
        elif dst not in seen:
            assert got == {"length": -1, "error": "no path"}
        else:
            path, actions = [dst], []
            while path[0] != src:
                actions.insert(0, seen[path[0]][2])
                path.insert(0, seen[path[0]][1])
            assert got == {"length": len(actions), "path": path, "actions": actions}


def test_diameters():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(2, 200)
        a = [rng.randrange(i) for i in range(1, n)] + [rng.randrange(n) for _ in range(rng.randrange(30))]
        b = [*range(1, n), *(rng.randrange(n) for _ in range(len(a) - n + 1))]
        near = defaultdict(set)
        for x, y in zip(a, b):
            near[x].add(y)
            near[y].add(x)

        def far(start):
            steps, queue = {start: 0}, [start]
            for x in queue:
                for y in near[x] - steps.keys():
                    steps[y] = steps[x] + 1
                    queue.append(y)
            return max(steps.values())

        assert connectivity.diameter_of(np.array(a), np.array(b)) == max(map(far, range(n)))


def test_component_stats_beyond_the_bound(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}", "a", i) for i in range(20)] + [("x", "y", "a", 50), ("y", "x", "a", 51), ("y", "x", "b", 52), ("z", "z", "a", 53)]
    df = spark.createDataFrame(chain, EDGE)
    assert rows(connectivity.component_stats(df, most=20)) == [("c00", 21, 20, 40 / 21, -1), ("x", 2, 3, 2.0, 1), ("z", 1, 1, 2.0, 0)]
    assert rows(connectivity.component_stats(df))[0] == ("c00", 21, 20, 40 / 21, 20)


def prune_brute(edges):
    """Edge after edge, by all least costs between nodes."""
    live = {i: e for i, e in enumerate(sorted(edges, key=lambda e: (e[3], e[0], e[1], e[2])))}
    cost = lambda e: len(e[2].split("|"))
    for i in list(live):
        far = {live[i][0]: 0}
        for _ in range(len(live)):
            for j, e in live.items():
                if j != i and e[0] in far and far[e[0]] + cost(e) < far.get(e[1], 10**9):
                    far[e[1]] = far[e[0]] + cost(e)
        if far.get(live[i][1], 10**9) <= cost(live[i]):
            del live[i]
    return sorted(live.values())


@pytest.mark.parametrize("seed", [0, 1])
def test_redundant_edges(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(s, d): (s, d, a, o) for s, d, a, o in graph(rng, 9, 60) if s != d}.values())
    want = prune_brute(edges)
    assert len(want) < len(edges) - 5
    df = spark.createDataFrame(edges, EDGE)
    assert rows(refinement.drop_redundant(df)) == want
    assert rows(refinement.drop_redundant(df, local=3)) == want


def collapse_brute(edges):
    out_of, best = defaultdict(list), {}
    count = lambda a: len(a.split("|"))
    edges = sorted(edges, key=lambda e: (e[3], e[0], e[1], e[2]))
    for e in edges:
        out_of[e[0]].append(e)
    virtual = lambda n: n.startswith("__virt_")

    def offer(e):
        if e[0] != e[1] and (e[:2] not in best or count(e[2]) < count(best[e[:2]][2])):
            best[e[:2]] = e

    for src, dst, action, ord_ in edges:
        if virtual(src):
            continue
        if not virtual(dst):
            offer((src, dst, action, ord_))
            continue
        seen, stack = {dst}, [(dst, action)]
        while stack:
            node, path = stack.pop()
            for _, nxt, step, _ in reversed(out_of[node]):
                if not virtual(nxt):
                    offer((src, nxt, f"{path} | {step}", ord_))
                elif nxt not in seen:
                    seen.add(nxt)
                    stack.append((nxt, f"{path} | {step}"))
    return sorted(best.values())


@pytest.mark.parametrize("starts", [refinement.STARTS, 2])
def test_collapse(spark, starts):
    rng = random.Random(7)
    name = lambda: rng.choice(["r", "r", "__virt_"]) + str(rng.randrange(6))
    edges = [(name(), name(), rng.choice("abc"), i) for i in range(120)]
    edges += [("r0", "__virt_c0", "a", 200), *((f"__virt_c{i}", f"__virt_c{i + 1}", "b", 201 + i) for i in range(40)), ("__virt_c40", "far", "c", 300)]
    want = collapse_brute(edges)
    assert rows(refinement.collapse_virtual(spark.createDataFrame(edges, EDGE), starts)) == want and any(e[1] == "far" for e in want)
    assert refinement.collapse_virtual(spark.createDataFrame([], EDGE)).count() == 0


def greedy(values, tol):
    kept, out = [], []
    for i, v in enumerate(values):
        hit = next((k for k in kept if all(x is not None and y is not None and abs(x - y) <= tol for x, y in zip(v, values[k]))), i)
        if hit == i:
            kept.append(i)
        out.append(hit)
    return out


@pytest.mark.parametrize("tol", [0.0, 0.3])
def test_tolerant_dedup_keeps_the_greedy_order(spark, tol):
    rng = random.Random(3)
    values = [(round(rng.uniform(-2, 2), 1), round(rng.uniform(-1, 1), 1)) for _ in range(400)] + [(None, 0.0), (float("nan"), 0.0), (float("inf"), 0.0), (0.3, 0.0), (0.6, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([("b", i, *v) for i, v in enumerate(values)] + [("c", 1000, 0.0, 0.0), ("c", 1001, 0.1, 0.0)], "k string, n long, x double, y double")
    want = greedy(values, tol)
    for local in (tolerance.LOCAL_ROWS, 50):
        got = tolerance.dedup_tolerant(df, "k", "n", ["x", "y"], tol, local).orderBy("o").collect()
        assert [r["rep"] for r in got if r["b"] == "b"] == want and [r["rep"] for r in got if r["b"] == "c"] == [1000, 1000 if tol else 1001]
