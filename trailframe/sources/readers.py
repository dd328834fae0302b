"""Scans of rollouts, metrics, graphs and datasets, through Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLLOUT = "input string, output string, score double, reward_scores string"
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "orc": "orc"}


def stem_number(path: Column) -> Column:
    """Step number in a file's stem; 0 where it isn't a number."""
    return F.coalesce(F.regexp_extract(path, r"/([0-9]+)\.[^/]*$", 1).try_cast("int"), F.lit(0))


def text_lines(spark: SparkSession, path: str, number: bool = True) -> DataFrame:
    """Lines with their file, step and, if asked, line number; blank lines keep their number.

    Lines are numbered inside each split of a file, after those of the splits before it.
    """
    if not number:
        return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).withColumn("step_idx", stem_number(F.col("file")))
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            places = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now, n = key, n + 1 if key == now else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "block", "value", "place"])

    numbered = rows.mapInArrow(run, "file string, block long, value string, place long")
    per = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # one row for each split of a file
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    out = numbered.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return out.select("file", (F.col("start") + F.col("place")).alias("line_idx"), "value").withColumn("step_idx", stem_number(F.col("file")))


def read_rollouts(spark: SparkSession, path: str, strict: bool = True, number: bool = False) -> DataFrame:
    """Rollout rows of JSON-lines files; blank lines go. strict: malformed lines raise, else they are skipped."""
    rows = text_lines(spark, path, number).where(F.trim("value") != "")
    schema = T._parse_datatype_string(ROLLOUT)
    if strict:
        parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
        return rows.select("step_idx", *(["line_idx"] if number else []), parsed.alias("r")).select("step_idx", *(["line_idx"] if number else []), "r.*")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("step_idx", *(["line_idx"] if number else []), parsed.alias("r")).where("r._bad IS NULL").select("step_idx", *(["line_idx"] if number else []), "r.*").drop("_bad")


def read_line(spark: SparkSession, path: str, index: int) -> str:
    got = text_lines(spark, path).where(F.col("line_idx") == index).select("value").first()
    if got is None:
        raise IndexError(index)
    return got["value"]


def read_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All metrics.json files below a directory; unreadable ones are skipped; `_path`, model, tag and rollout from the path."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").option("multiLine", True).option("mode", "DROPMALFORMED")
    if schema:
        reader = reader.schema(schema)
    return with_path_columns(reader.json(path).withColumn("_path", F.col("_metadata.file_path")), "_path")


def with_path_columns(df: DataFrame, path: str) -> DataFrame:
    """model / tag / rollout of `.../model/tag_x/rollout/file`."""
    pattern = r"/([^/]+)/(tag_[^/]+)/([^/]+)/[^/]+$"
    return df.withColumns({n: F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")) for i, n in enumerate(("model", "tag", "rollout"))})


def scan_tags(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Rollout directories with a messages.json, of one tag or all."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "messages.json").option("recursiveFileLookup", True).load(path).select("path")
    out = with_path_columns(found, "path").where("tag IS NOT NULL")
    return out if tag is None else out.where(F.col("tag") == f"tag_{tag}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of graph JSON files, with older field names and trailing commas allowed."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r",\s*([}\]])", "$1").alias("value"))
    node = "key string, obs_str string, text string, image_paths array<string>, images array<string>, state string, extra string"
    edge = "`from` string, `to` string, obs_str string, text string, extra string"
    got = text.select(F.from_json("value", f"struct<nodes:array<struct<{_ddl(node)}>>,edges:array<struct<{_ddl(edge)}>>>").alias("g"))
    nodes = got.select(F.explode("g.nodes").alias("n")).select(F.col("n.key").alias("node"), "n.state", F.coalesce("n.obs_str", "n.text").alias("obs_str"), F.coalesce("n.image_paths", "n.images").alias("image_paths"), "n.extra")
    edges = got.select(F.explode("g.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.obs_str", "e.text").alias("action"), "e.extra")
    return nodes, edges


def _ddl(columns: str) -> str:
    return ",".join(c.strip().replace(" ", ":", 1) for c in columns.split(", "))


def merge_graph(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the old table and those new ones whose key it lacks: the first writer wins."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def read_parquet_sample(spark: SparkSession, paths: list[str], key: str, most: int | None = None, seed: int | None = None) -> DataFrame:
    """Files as one table; a sample of fixed size is the first rows by key, or by hash with a seed."""
    df = spark.read.parquet(*paths)
    if most is None:
        return df
    order = F.col(key) if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(order, key).limit(most)


def read_any(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A file or directory by the extension of its (first) file."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else None
    if kind not in FORMATS:
        first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).first()
        kind = first["path"].rsplit(".", 1)[-1].lower() if first else None
    if kind not in FORMATS:
        raise ValueError(f"unknown file type of {path}")
    if FORMATS[kind] == "arrow":
        return _read_arrow(spark, path)
    if FORMATS[kind] == "csv":
        options = {"header": "true"} | options
    return spark.read.options(**options).format(FORMATS[kind]).load(path)


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, each decoded in the task that reads its bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def tables(raw: bytes) -> Iterator[pa.RecordBatch]:
        try:
            with pa.ipc.open_file(raw) as f:
                yield from (f.get_batch(i) for i in range(f.num_record_batches))
        except pa.ArrowInvalid:
            with pa.ipc.open_stream(raw) as f:
                yield from f

    first = files.first()
    if first is None:
        raise ValueError(f"no file at {path}")
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(next(tables(bytes(first["content"]))).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield from tables(raw.as_py())

    return files.mapInArrow(run, schema)


def register_datasets(spark: SparkSession, spec: dict[str, dict]) -> dict[str, DataFrame]:
    """Datasets of a registry as temporary views; streaming for all or none; `size` takes a hashed sample."""
    if len({bool(v.get("streaming")) for v in spec.values()}) > 1:
        raise ValueError("streaming must hold for all datasets or none")
    out = {}
    for name, v in spec.items():
        df = read_any(spark, v["path"])
        if v.get("streaming"):
            df = spark.readStream.schema(df.schema).format(FORMATS[v["path"].rsplit(".", 1)[-1]] if "." in v["path"].rsplit("/", 1)[-1] else v.get("format", "parquet")).load(v["path"])
        elif v.get("size"):
            df = df.orderBy(F.xxhash64(*df.columns)).limit(int(v["size"]))
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def write_datasets(spark: SparkSession, datasets: dict[str, DataFrame], path: str) -> dict:
    """One JSON directory per dataset that isn't empty, and a manifest; an error if all are empty."""
    info = {}
    for name, df in datasets.items():
        if df.limit(1).count():
            df.write.mode("overwrite").json(f"{path}/{name}")
            shared = bool({"messages", "conversations"} & set(df.columns))
            info[name] = {"file_name": name, "formatting": "sharegpt" if shared else "alpaca"}
    if not info:
        raise ValueError("all datasets are empty")
    spark.createDataFrame([(json.dumps(info, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/dataset_info")
    return info


def _quoted(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\r\n') else cell


def result_table(df: DataFrame, score: str, kind: str) -> str:
    """A result table, best score first, as csv (quoted where needed), markdown or latex; all rows, so for reports of a row per model."""
    if kind not in ("csv", "markdown", "latex"):
        raise ValueError(kind)
    names = df.columns
    shown = lambda v: "" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [[shown(v) for v in r] for r in df.orderBy(F.desc(score)).toLocalIterator()]
    if kind == "csv":
        return "".join(",".join(map(_quoted, r)) + "\n" for r in [names, *cells])
    if kind == "markdown":
        mark = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in cells]
        return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *mark]) + "\n"
    body = " \\\\\n".join(" & ".join(r) for r in [names, *cells])
    return f"\\begin{{tabular}}{{{'l' * len(names)}}}\n{body} \\\\\n\\end{{tabular}}\n"


def eval_to_rollout(df: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """One ChatML text per conversation: (key, text), turns in order."""
    from trailframe.functions.parse import chatml_text

    parts = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return df.groupBy(key).agg(chatml_text(parts).alias("text"))


def rl_rows(df: DataFrame, source: str, prompt: Column, truth: Column, split: str, index: str) -> DataFrame:
    """Rows of the nested training format."""
    return df.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), F.lit("text").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"),
    )
