"""Quantiles and choices by rounds of counting, against plain sorts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import advantages, quantiles


def plain(values, q):
    v = sorted(x for x in values if x is not None and x == x)
    if not v:
        return None
    at = q * (len(v) - 1)
    low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
    share = at - int(at)
    return low if low == high or share == 0 else low * (1 - share) + high * share


@pytest.mark.parametrize("limit", [quantiles.LIMIT, 5])
def test_quantiles(spark, limit):
    rng = random.Random(4)
    groups = {
        "even": [rng.random() for _ in range(3000)],
        "ties": [float(rng.choice([0, 0, 0, 1])) for _ in range(500)],
        "two": [0.0] * 300 + [1.0] * 300,
        "tails": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(800)],
        "odd": [None, float("nan"), float("inf"), float("-inf"), 3.0, *([2.0] * 20)],
        "few": [1.0, 2.0],
        "none": [None, None],
        None: [float(i) for i in range(50)],
    }
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "k string, x double").repartition(5)
    got = {r["k"]: r for r in quantiles.quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}, limit).collect()}
    assert got.keys() == groups.keys()
    for g, own in groups.items():
        for n, q in (("a", 0.0), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
            want = plain(own, q)
            assert got[g][n] == want or got[g][n] == pytest.approx(want, rel=1e-12), (g, n)


@pytest.mark.parametrize("k", [0, 1, 37, 400, 10_000])
def test_choose_takes_exactly_k_with_ties_by_key(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice([None, float("nan"), 1.0, 2.0, 2.0, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, x double").repartition(3)
    fit = [(i, x) for i, x in rows if x is not None and x == x]
    for largest in (True, False):
        want = {i for i, _ in sorted(fit, key=lambda r: (-r[1] if largest else r[1], r[0]))[:k]}
        got = quantiles.choose(df, F.col("x"), k, ["i"], largest, limit=7).collect()
        assert {r["i"] for r in got if r["chosen"]} == want and len(got) == 600


def test_covariance_losses(spark):
    rng = np.random.default_rng(0)
    n = 500
    p, o, a, m = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.8
    df = spark.createDataFrame([(i, float(p[i]), float(o[i]), float(a[i]), bool(m[i])) for i in range(n)], "i long, p double, o double, a double, m boolean")
    args = (["i"], F.col("p"), F.col("o"), F.col("a"), F.col("m"))
    cov = (a - a[m].mean()) * (p - p[m].mean())
    ratio = np.exp(p - o)

    got = advantages.kl_cov_losses(df, *args, ratio=0.1, coef=2.0, limit=20).orderBy("i").collect()
    top = sorted(np.flatnonzero(m), key=lambda i: -cov[i])[: int(0.1 * m.sum())]
    assert [r["i"] for r in got if r["penalised"]] == sorted(top)
    want = np.where(m, -a * ratio + np.where(np.isin(np.arange(n), top), 2 * np.abs(p - o), 0), 0)
    assert np.allclose([r["loss"] for r in got], want)

    got = advantages.clip_cov_losses(df, *args, ratio=0.05, low=0.1, high=2.0, limit=20).orderBy("i").collect()
    plain_, clipped = -a * ratio, -a * np.clip(ratio, 0.8, 1.2)
    fit = m & (cov > 0.1) & (cov < 2.0) & ~(clipped > plain_)
    gone = np.array([r["dropped"] for r in got])
    assert gone.sum() == int(0.05 * m.sum()) and (fit | ~gone).all()
    assert np.allclose([r["loss"] for r in got], np.where(m & ~gone, np.maximum(plain_, clipped), 0))
    few = advantages.clip_cov_losses(df, *args, ratio=0.9, low=0.1, high=2.0)
    assert few.where("dropped").count() == fit.sum()
    assert advantages.kl_cov_losses(df.limit(0), *args).count() == advantages.clip_cov_losses(df.limit(0), *args).count() == 0
