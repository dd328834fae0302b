"""Ratio quotas applied to rows, mixes by probability, mixed records and appended outputs."""

import hashlib
from collections import Counter

import pytest

from trailframe.operators import aggregates, batch, joins, sampling, sft


def order(purpose, key):
    return hashlib.md5(f"42|{purpose}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("ratio", [{"single": 1, "mix": 1, "multi": 1}, {"single": 3, "mix": 0, "multi": 1}, {"single": 0, "mix": 2, "multi": 5}, {"single": 0, "mix": 0, "multi": 0}])
@pytest.mark.parametrize("local", [sampling.GROUP_ROWS, 3])
def test_ratio_quotas_on_rows(spark, monkeypatch, ratio, local):
    monkeypatch.setattr(sampling, "GROUP_ROWS", local)
    have = {"s": (2, 9, 30), "t": (40, 0, 1), None: (5, 5, 5)}
    rows, n = [], 0
    for g, counts in have.items():
        for c, k in zip(("single", "mix", "multi", "other"), (*counts, 4)):
            rows += [(g, c, n + i) for i in range(k)]
            n += k
    df = spark.createDataFrame(rows, "scene string, kind string, id long")
    got = [tuple(r) for r in sampling.ratio_rows(df, "scene", "kind", "id", ratio, 20).collect()]
    want = []
    for g, counts in have.items():
        quota = sampling.ratio_quotas(list(ratio.values()), 20, [k if w else 0 for k, w in zip(counts, ratio.values())])
        for c, q in zip(ratio, quota):
            own = sorted((i for h, d, i in rows if (h, d) == (g, c)), key=lambda i: order("ratio", i))
            want += [(g, c, i) for i in own[:q]]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("mode", ["under", "over"])
def test_mix_by_probability(spark, mode):
    rows = [("a" if i < 50 else "b" if i < 70 else "c", i) for i in range(73)] + [("unused", 99)]
    shares = {"a": 0.5, "b": 0.25, "c": 0.25}
    df = spark.createDataFrame(rows, "source string, id long")
    got = sorted((r["draw"], r["source"], r["id"]) for r in sampling.interleaved_by(df, "source", "id", shares, mode).collect())
    own = {s: sorted((i for t, i in rows if t == s), key=lambda i: order("interleave", i)) for s in shares}
    want, used, place = [], Counter(), 0
    while True:
        u = int(order("source", place)[:8], 16) / 2**32
        s = "a" if u < 0.5 else "b" if u < 0.75 else "c"
        if mode == "under" and used[s] == len(own[s]):
            break
        want.append((place, s, own[s][used[s] % len(own[s])]))
        used[s] += 1
        place += 1
        if mode == "over" and all(used[t] >= len(own[t]) for t in shares):
            break
    assert got == want
    assert sampling.interleaved_by(df.where("source <> 'c'"), "source", "id", shares, mode).count() == 0


def test_mixed_records(spark):
    rows = [("r", s, f"see {s}", f"a{s}", ["x", "y"] if s != 2 else [], "end") for s in range(12)] + [("q", 0, "one", "go", None, "stop")]
    df = spark.createDataFrame(rows, "id string, s long, o string, a string, w array<string>, e string")
    got = {r["id"]: r for r in sft.mixed_records(df, "id", "s", "o", "a", "w", "sys", "e", 0.5).collect()}
    assert [m["content"] for m in got["q"]["messages"]] == ["sys", "one", "<action>go</action>", "<action>answer(stop)</action>"]
    record = got["r"]
    assert set(record["kinds"]) == {"mcq", "free"} and record["kinds"][2] == "free" and len(record["messages"]) == 2 + 24
    for s, kind in enumerate(record["kinds"]):
        asked, said = (record["messages"][1 + 2 * s + i]["content"] for i in range(2))
        if kind == "free":
            assert (asked, said) == (f"see {s}", f"<action>a{s}</action>")
        else:
            lines = asked.split("\n")
            assert sorted(x[3:] for x in lines[1:]) == sorted([f"a{s}", "x", "y"]) and f"{said[8]}. a{s}" in lines


def test_rewarded_records_are_appended_once(spark, tmp_path):
    rows = [(1, ["a"] * 3, 0.5), (2, ["a"] * 2, 0.9), (3, ["a"] * 4, None), (4, ["a"] * 4, 0.49), (5, ["a"] * 3, 1.0), (1, ["b"] * 3, 0.7)]
    df = spark.createDataFrame(rows, "id long, m array<string>, r double")
    kept = sft.reward_filtered(df, "m", "r")
    path = str(tmp_path / "out")
    assert sft.append_new(kept.where("id < 3"), path, ["id"]) == 1
    assert sft.append_new(kept, path, ["id"]) == 1 and sft.append_new(kept, path, ["id"]) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 5]


def test_columns_of_a_batch(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    left, popped = batch.columns(df, pop=["b"], rename={"c": "x"})
    assert (left.columns, popped.columns, tuple(left.first()), tuple(popped.first())) == (["a", "x"], ["b"], (1, 3), (2,))
    assert batch.columns(df, keep=["c", "a"])[0].columns == ["c", "a"]
    for bad in ({"keep": ["z"]}, {"pop": ["z"]}, {"rename": {"a": "b"}}):
        with pytest.raises(ValueError):
            batch.columns(df, **bad)


def test_factors_moments_and_sources(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), (None, 5.0)], "k string, v double")
    factors = spark.createDataFrame([("a", 7), ("b", None)], "k string, f long")
    got = {r["k"]: r["f"] for r in joins.with_factors(rows, factors, "k").collect()}
    assert got["a"] == 7.0 and got["b"] != got["b"] and got[None] != got[None]
    moments = {r["k"]: tuple(r)[1:] for r in aggregates.group_moments(rows, "k", "v").collect()}
    assert moments["a"] == (0.0, 1.0, 1) and moments["b"] == (3.0, pytest.approx(2**0.5), 2)
    assert {r["source"]: (r["mean"], r["n"]) for r in aggregates.source_scores(rows, "k", "v").collect()} == {"a": (1.0, 1), "b": (3.0, 2), "unknown": (5.0, 1)}
