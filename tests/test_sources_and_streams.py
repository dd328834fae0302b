"""Readers, writers and streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from trailframe.sources import readers
from trailframe.streaming import streams


def test_rollouts(spark, tmp_path):
    good = json.dumps({"input": "a", "output": "b", "score": 1.0, "reward_scores": "[1]"})
    (tmp_path / "12.jsonl").write_text(good + "\n\n" + good + "\n")
    (tmp_path / "x.jsonl").write_text("{broken\n" + good + "\n")
    loose = readers.read_rollouts(spark, str(tmp_path / "*.jsonl"), strict=False, number=True)
    assert sorted((r["step_idx"], r["line_idx"]) for r in loose.collect()) == [(0, 1), (12, 0), (12, 2)]
    with pytest.raises(Exception):  # noqa: B017
        readers.read_rollouts(spark, str(tmp_path / "x.jsonl")).collect()
    assert readers.read_line(spark, str(tmp_path / "12.jsonl"), 2) == good
    with pytest.raises(IndexError):
        readers.read_line(spark, str(tmp_path / "12.jsonl"), 9)


def test_metrics_and_tags(spark, tmp_path):
    d = tmp_path / "m1" / "tag_a" / "r0"
    d.mkdir(parents=True)
    (d / "metrics.json").write_text(json.dumps({"success": True, "num_turns": 3}, indent=1))
    (d / "messages.json").write_text("[]")
    got = readers.read_metrics(spark, str(tmp_path), "success boolean, num_turns int").first()
    assert (got["model"], got["tag"], got["rollout"], got["success"]) == ("m1", "tag_a", "r0", True)
    assert readers.scan_tags(spark, str(tmp_path), "a").count() == 1 and readers.scan_tags(spark, str(tmp_path), "b").count() == 0


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"key": "n1", "text": "hi", "images": ["i"],},], "edges": [{"from": "n1", "to": "n2", "obs_str": "go"},]}')
    nodes, edges = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first()["obs_str"] == "hi" and nodes.first()["image_paths"] == ["i"] and tuple(edges.first())[:3] == ("n1", "n2", "go")
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    merged = readers.merge_graph(old, spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c")]


def test_formats_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5), ("n", 0.75)], "model string, score double")
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert readers.read_any(spark, str(tmp_path / "p")).count() == readers.read_any(spark, str(tmp_path / "c")).count() == 2
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("a", pa.int64())])) as w:
        w.write_batch(pa.record_batch([pa.array([1, 2])], names=["a"]))
    assert sorted(r["a"] for r in readers.read_any(spark, str(tmp_path / "t.arrow")).collect()) == [1, 2]
    (tmp_path / "z.bin").write_text("x")
    with pytest.raises(ValueError, match="unknown file type"):
        readers.read_any(spark, str(tmp_path / "z.bin"))
    assert readers.result_table(df, "score", "csv").splitlines()[1] == "n,0.7500"
    assert readers.result_table(df, "score", "markdown").count("|") > 6 and "tabular" in readers.result_table(df, "score", "latex")
    info = readers.write_datasets(spark, {"a": df, "b": df.limit(0)}, str(tmp_path / "out"))
    assert list(info) == ["a"]
    with pytest.raises(ValueError, match="empty"):
        readers.write_datasets(spark, {"b": df.limit(0)}, str(tmp_path / "out2"))
    reg = readers.register_datasets(spark, {"first": {"path": str(tmp_path / "p"), "size": 1}})
    assert reg["first"].count() == 1 and spark.sql("SELECT * FROM first").count() == 1
    with pytest.raises(ValueError, match="streaming"):
        readers.register_datasets(spark, {"a": {"path": "x", "streaming": True}, "b": {"path": "y"}})


def test_live_summary_equals_the_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "k string, v double", per_trigger=1)
    streams.run_to_end(streams.live_summary(stream, "k", "v"), "live", str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.sql("SELECT k, n, mean FROM live").collect())) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_windows_over_event_time(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "))
    streams.run_to_end(streams.windowed_summary(stream, "ts", "k", "v"), "win", str(tmp_path / "cp"))
    assert sorted(r["total"] for r in spark.sql("SELECT total FROM win").collect()) == [3.0, 4.0]


def test_incremental_edges(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: streams.incremental_edges(streams.file_stream(spark, str(tmp_path / "in"), "k long, v string"), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    run()
    spark.createDataFrame([(2, "z"), (3, "d")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out") + "/*").collect()) == [1, 2, 3]


def test_incremental_edges_of_a_batch_that_runs_again(spark, tmp_path):
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda cp: streams.incremental_edges(streams.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / cp), ["k"]).awaitTermination()
    got = lambda: sorted(r["k"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/*/*").collect())
    run("cp")
    spark.createDataFrame([(2, "z"), (3, "d")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("cp")
    assert got() == [1, 2, 3]
    commits = sorted((f for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run("cp")  # the last batch again
    assert got() == [1, 2, 3]
    run("other")  # from the start, into the same table
    assert got() == [1, 2, 3]


def test_shuffle_buffer_keeps_all_rows(spark):
    df = spark.range(0, 1000, 1, 2)
    got = [r["id"] for r in streams.shuffled(df, 5, buffer=16).collect()]
    assert sorted(got) == list(range(1000)) and got != sorted(got)
    assert got == [r["id"] for r in streams.shuffled(df, 5, buffer=16).collect()]
    assert streams.shuffled(df.limit(0), 5).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 5 else "" for i in range(5000)]
    (tmp_path / "3.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "4.txt").write_text("a\n\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r["step_idx"], r["line_idx"], r["value"]) for r in readers.text_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(3, i, x) for i, x in enumerate(lines)] + [(4, 0, "a"), (4, 1, ""), (4, 2, "b")]


def test_result_table_has_all_rows_and_quotes_cells(spark):
    df = spark.range(12_000).selectExpr("concat('a,\"', id) AS name", "CAST(id AS double) AS score")
    import csv

    rows = list(csv.reader(readers.result_table(df, "score", "csv").splitlines()))
    assert len(rows) == 12_001 and rows[1] == ['a,"11999', "11999.0000"]


def test_bounded_queue_drops_the_oldest(spark, tmp_path):
    spark.createDataFrame([("q", i, i) for i in range(5)], "q string, x long, o long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "q string, x long, o long")
    streams.run_to_end(streams.bounded_queue(stream, "q", "x", "o", 3), "queue", str(tmp_path / "cp"), "update")
    got = spark.sql("SELECT * FROM queue").first()
    assert list(got["items"]) == [2, 3, 4] and got["dropped"] == 2


def test_bounded_queue_of_more_rows_than_a_frame(spark, tmp_path):
    spark.range(30_000).selectExpr("'q' q", "(id * 7919) % 30000 x", "(id * 7919) % 30000 o").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "q string, x long, o long")
    streams.run_to_end(streams.bounded_queue(stream, "q", "x", "o", 5), "long_queue", str(tmp_path / "cp"), "update")
    got = spark.sql("SELECT * FROM long_queue").first()
    assert list(got["items"]) == [29995, 29996, 29997, 29998, 29999] and got["dropped"] == 29_995


def test_routing_buffers_and_resume(spark):
    router = streams.StickyRouter(2, 1)
    assert [router.route(k) for k in "abac"] == [0, 1, 0, 0]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate("abac")], "s string, o long, k string")
    assert [r["worker"] for r in streams.sticky_routes(df, "s", "o", "k", 2, 1).orderBy("o").collect()] == [0, 1, 0, 0]
    buffer = streams.BatchBuffer(2)
    assert buffer.add([1, 2, 3]) == [[1, 2]] and streams.BatchBuffer.restore(buffer.state()).add([4]) == [[3, 4]]
    assert streams.admitted(False, 3, 2, 1.0) and not streams.admitted(False, 4, 2, 1.0) and not streams.admitted(True, 0, 2, 1.0)
    marks = spark.createDataFrame([(1, "rl"), (1, "sft"), (2, "rl")], "iteration int, phase string")
    assert streams.last_complete(marks, ["rl", "graph", "sft"]) == (2, "rl")
    assert streams.fresh_enough(spark.createDataFrame([(1,), (5,)], "v int"), "v", 6, 2).count() == 1
