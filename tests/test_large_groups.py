"""Steps that deal a large group to many tasks, against plain ones."""

import math
import random
from collections import Counter

import pandas as pd
import pytest

from trailframe.functions import text
from trailframe.operators import batch, recipes, sft


def test_partitions_of_a_large_batch(spark):
    rng = random.Random(0)
    rows = [(b, i, rng.choice([0, 1, rng.randrange(2000), 5000])) for b, n in ((0, 3000), (1, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "b long, i long, s long")
    got = batch.balanced(df, "b", "i", "s", 7, rows=100, fan=4).collect()
    assert sorted((r["batch"], r["row"], r["size"]) for r in got) == sorted(rows)
    for b in range(3):
        own = [(r["size"], r["part"]) for r in got if r["batch"] == b]
        sums = Counter({p: 0 for p in range(7)})
        for s, p in own:
            sums[p] += s
        assert max(sums.values()) - min(sums.values()) <= max(s for s, _ in own) and set(sums) == set(range(7))
    plain = batch.karmarkar_karp([s for b, _, s in rows if b == 1], 7)
    assert sorted(sum(r["size"] for r in got if r["batch"] == 1 and r["part"] == p) for p in range(7)) == sorted(sum(rows[3000 + i][2] for i in p) for p in plain)
    assert batch.balanced(df.limit(0), "b", "i", "s", 3).count() == 0


def selection_brute(scored, target, cap):
    order = sorted(scored, key=lambda x: (-x[2], x[0]))
    counts, chosen = {}, []
    for name, actions, _ in order:
        new = Counter(counts) + Counter(actions)
        if len(chosen) < target and (not chosen or all(new[a] <= cap * sum(new.values()) for a in set(actions))):
            counts = new
            chosen.append(name)
    rest = [n for n, *_ in order if n not in set(chosen)]
    return {n: 1 for n in chosen} | {n: 2 for n in rest[: max(0, target - len(chosen))]}


@pytest.mark.parametrize("target", [0, 25, 500])
def test_balanced_rows_over_ranges(spark, target):
    rng = random.Random(1)
    scored = [(f"p{i:03}", [rng.choice("aabcdefgh") for _ in range(rng.randrange(6))], float(rng.randrange(20))) for i in range(200)]
    df = spark.createDataFrame(scored, "path string, acts array<string>, score double")
    for cap in (0.2, 0.3):
        got = {r["path"]: r["pass"] for r in recipes.balanced_rows(df, "path", "acts", "score", target, cap, rows=30).collect()}
        assert got == selection_brute(scored, target, cap)
    assert recipes.balanced_rows(df.limit(0), "path", "acts", "score", 3).count() == 0


def overlap_brute(pred, gold):
    a, b = (pred or "").split(), (gold or "").split()
    if not a or not b:
        return (0.0, 0.0, 0.0, 0.0)
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hits = [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 5)]
    logs = [math.log((h + (n > 1)) / (max(len(a) - n + 1, 0) + (n > 1))) if h + (n > 1) else -math.inf for n, h in enumerate(hits, 1)]
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    f = lambda h, p, r: 200 * h / (p + r) if p > 0 and r > 0 else 0.0
    return (100 * math.exp(min(0.0, 1 - len(b) / len(a)) + sum(logs) / 4), f(hits[0], len(a), len(b)), f(hits[1], len(a) - 1, len(b) - 1), f(row[-1], len(a), len(b)))


def test_text_overlap_in_batches(monkeypatch):
    rng = random.Random(2)
    make = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    pairs = [(make(rng.randrange(300), k), make(rng.randrange(300), k)) for k in (2, 5, 40) for _ in range(40)]
    pairs += [(None, "a"), ("a", None), ("", " "), ("a b", "a b"), (" a　b\n c ", "a b c"), ("x " * 63 + "y", "x " * 64), ("x " * 64, "x " * 129), ("é ü", "ü é")]
    for words in (text._MASK_WORDS, 3):
        monkeypatch.setattr(text, "_MASK_WORDS", words)
        got = text.text_overlap.func(pd.Series([p for p, _ in pairs]), pd.Series([g for _, g in pairs]))
        for row, pair in zip(got.itertuples(index=False), pairs):
            assert tuple(row) == pytest.approx(overlap_brute(*pair), abs=1e-4), pair
    assert len(text.text_overlap.func(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


def test_a_room_larger_than_a_task(spark):
    rng = random.Random(3)
    cells = [("r", x, y) for x in range(6) for y in range(6) if rng.random() < 0.8] + [("s", 0, 0), ("s", 0, 1)]
    df = spark.createDataFrame(cells, "room string, x long, y long")
    plain = sorted(map(tuple, sft.room_distances(df, "room").collect()))
    assert sorted(map(tuple, sft.room_distances(df, "room", local=5).collect())) == plain and len(plain) > 50
