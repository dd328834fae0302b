"""Rollout operators on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from trailframe.operators import rollouts as R
from trailframe.storage import shared_dir


def test_batches_fill_up_and_are_cut(spark):
    rows = [(0, "a", 0, 1), (0, "a", 1, 1), (0, "b", 2, 0), (0, "b", 3, 1), (1, "c", 4, 1), (2, "d", 5, 0), (2, "d", 6, 1), (3, "e", 7, 0), (3, "e", 8, 1)]
    df = spark.createDataFrame(rows, "b long, u string, o long, x int")
    got = lambda *a, **k: [r["o"] for r in R.filled_batch(df, "b", "u", "o", "x", *a, **k).orderBy("place").collect()]
    assert got(2, 2) == [2, 3, 4]  # a is flat, c alone stays; batches 0 and 1 are enough
    assert got(3, 1) == [2, 3, 4]
    with pytest.raises(Exception, match="too few groups"):
        got(9, 1)
    with pytest.raises(Exception, match="too few groups"):
        got(3, 2, most=2)


def test_turn_rows(spark):
    schema = "k string, r array<double>, i array<struct<success:boolean,solved:boolean>>"
    df = spark.createDataFrame([("a", [0.5, 1.0], [(None, None), (None, True), (False, True)]), ("b", [0.5, 1.0], [(True, None)]), ("c", [1.0], [])], schema)
    got = {(r["k"], r["turn"]): (r["reward"], r["success"]) for r in R.per_turn_rows(df, "k", "r", "i", ["success", "solved"]).collect()}
    assert got == {("a", 0): (None, False), ("a", 1): (0.5, True), ("a", 2): (1.0, False), ("b", 0): (None, True), ("b", 1): (0.5, True), ("b", 2): (1.0, False), ("c", 1): (1.0, False)}


def test_seeds(spark):
    rows = R.spec_seeds(spark, [{"name": "few", "n": 6, "rule": (1, 3, 2)}, {"name": "one", "n": 2, "seeds": [1, 2, 3]}]).collect()
    few = sorted(r["value"] for r in rows if r["name"] == "few")
    assert few == [1, 1, 2, 2, 3, 3] and [r["value"] for r in rows if r["name"] == "one"] == [1, 2]
    for bad in ({"n": 7, "rule": (1, 3, 2)}, {"n": 4, "seeds": [1, 2, 3]}, {"n": 1, "rule": (3, 1)}, {"n": 1, "rule": (1, 2, 3, 4)}):
        with pytest.raises(ValueError):
            R.spec_seeds(spark, [{"name": "x", **bad}])


def test_strict_conversion(spark):
    talk = [("system", "s"), ("human", "h"), ("function_call", '{"a": 1}'), ("function_call", "[1, {}]"), ("function_call", "{bad"), ("observation", "o"), ("judge", "?"), ("gpt", "g")]
    df = spark.createDataFrame([(talk,)], "c array<struct<from:string,value:string>>")
    got = df.select(R.sharegpt_strict(F.col("c")).alias("m")).first()["m"]
    assert [(m["role"], [(p["type"], p["value"]) for p in m["content"]], m["loss_weight"]) for m in got] == [
        ("system", [("text", "s")], 0.0), ("user", [("text", "h")], 0.0), ("assistant", [("tool_call", '{"a":1}')], 1.0), ("assistant", [("tool_call", "1"), ("tool_call", "{}")], 1.0),
        ("tool", [("text", "o")], 0.0), ("assistant", [("text", "g")], 1.0),
    ]


def test_batches_survive_a_round_trip(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "c")], "g long, o long, x string")
    lists = R.to_columns(df, "g", "o", ["o", "x"])
    path = shared_dir(spark, "batch")
    R.save_batch(lists, path, {"step": 3})
    back, meta = R.load_batch(spark, path)
    assert meta == {"step": 3} and sorted(map(tuple, R.to_rows(back, "g", ["o", "x"]).collect()), key=str) == sorted([(1, 0, 0, "a"), (1, 1, 1, None), (2, 0, 0, "c")], key=str)
    with pytest.raises(Exception, match="different lengths"):
        R.to_rows(spark.createDataFrame([(1, [1], [1, 2])], "g long, a array<long>, b array<long>"), "g", ["a", "b"]).collect()


def test_only_stable_checkpoints_that_are_new(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "checkpoint string, size long, modified long")
    now = rows(("a", 1, 1), ("b", 2, 1), ("c", 3, 1))
    assert [r["checkpoint"] for r in R.stable_checkpoints(rows(("a", 1, 1), ("b", 1, 1), ("c", 3, 1)), now, rows(("a", 1, 1))).collect()] == ["c"]


def test_numbers_near_the_truth(spark):
    got = [r["n"] for r in spark.range(400).select(R.near_number(F.lit(2), "id").alias("n")).collect()]
    assert set(got) <= {0, 1, 3, 4, 5, 6} and 2 not in got
    zero = [r["n"] for r in spark.range(400).select(R.near_number(F.lit(0), "id").alias("n")).collect()]
    assert min(zero) == 1
