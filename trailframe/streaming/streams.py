"""Structured Streaming: live summaries, incremental graphs, bounded queues, staleness."""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """New files of a folder, a bounded number per trigger; files seen before are skipped by the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def live_summary(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running counts and means per key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def windowed_summary(stream: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event-time window with a watermark."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all that is there into a memory table and stop."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path; none if it doesn't exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(root) if f.isDirectory()) if files.exists(root) else []


def incremental_edges(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each micro-batch adds the edges that the table lacks, the first of equal keys; a batch that runs again replaces its own.

    The keys seen are the query's state, in the state store of its checkpoint, so a batch costs what it brings, not what came
    before it. Only tables that other checkpoints wrote before this one are compared as files. A session that sets
    `spark.sql.streaming.stateStore.providerClass` to the RocksDB provider keeps the keys on disk.
    """
    run = f"run={zlib.crc32(checkpoint.encode()):08x}"

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        others = [f"{path}/{r}/{e}" for r in _folders(spark, path) if r != run for e in _folders(spark, f"{path}/{r}")]
        fresh = batch.join(spark.read.schema(batch.schema).parquet(*others), keys, "left_anti").select(batch.columns) if others else batch
        fresh.write.mode("overwrite").parquet(f"{path}/{run}/epoch={epoch}")

    return stream.dropDuplicates(keys).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(queue_full: bool, samples: int, required: int, threshold: float) -> bool:
    """Whether the producer may go on: not with a full queue or beyond its staleness budget."""
    return not queue_full and samples < required * (threshold + 1)


def fresh_enough(df: DataFrame, version: str, current: Column | int, most: int) -> DataFrame:
    """Rows whose parameter version is at most so many versions old."""
    now = F.lit(current) if isinstance(current, int) else current
    return df.where(now - F.col(version) <= most)


def bounded_queue(stream: DataFrame, queue: str, item: str, order: str, size: int) -> DataFrame:
    """FIFO per queue that drops its oldest when full: after each batch its content and the drop count.

    A batch's rows come in by their order, in however many frames; only the last `size` of them are held.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ([], 0)
        held = list(held)
        n, last = len(held), pd.DataFrame({"o": [], "x": []})
        for pdf in frames:
            n += len(pdf)
            last = pd.concat([last, pdf[["o", "x"]]]).sort_values("o", kind="stable").tail(size)
        dropped += max(0, n - size)
        held = (held + [int(x) for x in last["x"]])[-size:]
        state.update((held, dropped))
        yield pd.DataFrame({"queue": [key[0]], "items": [held], "dropped": [dropped]})

    rows = stream.select(F.col(queue).cast("string").alias("queue"), F.col(item).cast("long").alias("x"), F.col(order).cast("long").alias("o"))
    return rows.groupBy("queue").applyInPandasWithState(step, "queue string, items array<long>, dropped long", "items array<long>, dropped long", "update", GroupStateTimeout.NoTimeout)


def shuffled(df: DataFrame, seed: int, buffer: int = 16384) -> DataFrame:
    """Rows of each partition through a shuffle buffer: a row that comes in takes the place of a random one, which goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held, schema = np.random.default_rng([seed, TaskContext.get().partitionId()]), [], None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if len(held) < buffer:
                    held.append(row)
                    continue
                at = int(rng.integers(buffer))
                out.append(held[at])
                held[at] = row
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        rng.shuffle(held)
        for at in range(0, len(held), 4096):
            yield pa.RecordBatch.from_pylist(held[at : at + 4096], schema)

    return df.mapInArrow(run, df.schema)


class StickyRouter:
    """Keys stay with a worker; the least recently used goes when a worker is full."""

    def __init__(self, workers: int, capacity: int) -> None:
        self.capacity = capacity
        self.of: list[OrderedDict[str, None]] = [OrderedDict() for _ in range(workers)]

    def route(self, key: str) -> int:
        for w, keys in enumerate(self.of):
            if key in keys:
                keys.move_to_end(key)
                return w
        w = min(range(len(self.of)), key=lambda i: (len(self.of[i]), i))
        self.of[w][key] = None
        if len(self.of[w]) > self.capacity:
            self.of[w].popitem(last=False)
        return w


def sticky_routes(df: DataFrame, stream: str, order: str, key: str, workers: int, capacity: int) -> DataFrame:
    """Routes of each stream's requests in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        router = StickyRouter(workers, capacity)
        pdf = pdf.sort_values("o")
        return pdf.assign(worker=[router.route(k) for k in pdf["k"]])

    src = df.select(F.col(stream).cast("string").alias("s"), F.col(order).cast("long").alias("o"), F.col(key).cast("string").alias("k"))
    return src.groupBy("s").applyInPandas(run, "s string, o long, k string, worker int")


class BatchBuffer:
    """Rows kept until a batch is full; its state can be saved and restored."""

    def __init__(self, size: int, rows: list[Any] | None = None) -> None:
        self.size, self.rows = size, list(rows or [])

    def add(self, rows: list[Any]) -> list[list[Any]]:
        self.rows += rows
        out = []
        while len(self.rows) >= self.size:
            out.append(self.rows[: self.size])
            self.rows = self.rows[self.size :]
        return out

    def state(self) -> dict:
        return {"size": self.size, "rows": list(self.rows)}

    @classmethod
    def restore(cls, state: dict) -> BatchBuffer:
        return cls(state["size"], state["rows"])


def last_complete(markers: DataFrame, phases: list[str]) -> tuple[int, str] | None:
    """The latest (iteration, phase) with a marker, by iteration and the phases' order: markers (iteration, phase)."""
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    got = markers.where(rank > 0).agg(F.max(F.struct("iteration", rank.alias("r"))).alias("m")).first()["m"]
    return None if got is None else (got["iteration"], phases[got["r"] - 1])
