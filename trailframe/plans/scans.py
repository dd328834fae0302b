"""Sources, sinks and streams: the driver's tables written to the shared folder and read back through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import geometry, parse, text
from trailframe.operators import batch as B
from trailframe.operators import graph as G
from trailframe.operators import recipes as X
from trailframe.operators import sft
from trailframe.plans.catalog import EVENTS, Catalog, events, r6, table
from trailframe.plans.graphs import EDGES, transition_edges, transition_nodes
from trailframe.sources import readers
from trailframe.storage import shared_dir
from trailframe.streaming import streams

catalog = Catalog()


@catalog.add("""
SELECT conv_id || ':' || turn AS input, sha256(text) AS output, CAST(turn AS DOUBLE) / 2 AS score FROM conversations WHERE conv_id % 5 <> 0""")
def rollout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines; those of every fifth conversation are cut short and skipped."""
    rows = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("input"), F.col("text").alias("output"), (F.col("turn") / 2).alias("score")))
    path = shared_dir(spark, "rollouts")
    rows.select(F.when(F.col("conv_id") % 5 == 0, "{broken").otherwise(line).alias("value")).write.text(path)
    return readers.read_rollouts(spark, path, strict=False).select("input", F.sha2(F.col("output").cast("binary"), 256).alias("output"), "score")


@catalog.add("""
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS line_idx, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file, some of its lines blank, numbered in splits."""
    path = shared_dir(spark, "lines")
    rows = table(spark, sf_dir, "orders").repartition(1).sortWithinPartitions("o_orderkey")
    rows.select(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("value")).write.text(path)
    return readers.text_lines(spark, path).select("line_idx", "value")


@catalog.add("""
SELECT kind, n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation), (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind)""")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = shared_dir(spark, "formats") + f".{kind}"
        rows.write.options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)
        own = readers.read_any(spark, path).select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        out = own if out is None else out.union(own)
    return out


@catalog.add("""
SELECT 'customers' AS name, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'nations', 10""")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset whole, of the other a sample of the registered size."""
    found = readers.register_datasets(spark, {"customers": {"path": f"{sf_dir}/customer.parquet"}, "nations": {"path": f"{sf_dir}/nation.parquet", "size": 10}})
    return found["customers"].agg(F.lit("customers").alias("name"), F.count(F.lit(1)).alias("n")).union(found["nations"].agg(F.lit("nations"), F.count(F.lit(1))))


@catalog.add("""
SELECT 'shared' AS name, CAST(conv_id AS BIGINT) AS id, sha256(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id UNION ALL SELECT 'plain', CAST(item_id AS BIGINT), sha256(text) FROM benchmark""")
def dataset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets written with a manifest, a third that is empty left out, and read back."""
    path = shared_dir(spark, "datasets")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    shared = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
    plain = table(spark, sf_dir, "benchmark").select("item_id", "text")
    info = readers.write_datasets(spark, {"shared": shared, "plain": plain, "none": plain.limit(0)}, path)
    if set(info) != {"shared", "plain"}:
        raise ValueError(f"unexpected datasets {sorted(info)}")
    one = spark.read.schema(shared.schema).json(f"{path}/shared").select(F.lit("shared").alias("name"), F.col("conv_id").alias("id"), F.sha2(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|").cast("binary"), 256).alias("digest"))
    return one.union(spark.read.schema(plain.schema).json(f"{path}/plain").select(F.lit("plain"), "item_id", F.sha2(F.col("text").cast("binary"), 256)))


@catalog.add("""
WITH r AS (SELECT n_name, avg(c_acctbal) AS score, row_number() OVER (ORDER BY avg(c_acctbal) DESC) AS i FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(i AS INTEGER) AS place, n_name || ',' || printf('%.4f', score) AS line FROM r UNION ALL SELECT 0, 'n_name,score'""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a row per nation as lines of CSV."""
    per = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("c_acctbal").alias("score"))
    lines = readers.result_table(per, "score", "csv").splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


@catalog.add("""
WITH r AS (SELECT event_id, event_type, props, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id % 2, event_id) AS r FROM events)
SELECT event_id, event_type, props FROM r WHERE r = 1 OR event_id % 2 = 0""")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of even events first; of odd ones the first row of each key that it lacks."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    new = rows.where("event_id % 2 = 1").groupBy("event_type", "props").agg(F.min("event_id").alias("event_id"))
    return readers.merge_graph(rows.where("event_id % 2 = 0"), new.select(rows.columns), ["event_type", "props"])


def _stream(spark: SparkSession, df: DataFrame, files: int) -> tuple[DataFrame, str]:
    """The table as a stream of files, one per micro-batch, and a folder for checkpoint and results."""
    path = shared_dir(spark, "stream")
    df.repartition(files).write.parquet(f"{path}/in")
    return streams.file_stream(spark, f"{path}/in", df.schema.simpleString()[7:-1].replace(":", " "), per_trigger=1), path


def _result(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """What the last micro-batch gives, written and read back."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


@catalog.add("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 9) + 0.0 AS mean FROM events GROUP BY user_id""")
def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, path = _stream(spark, table(spark, sf_dir, "events").select("user_id", "value"), 3)
    return _result(streams.live_summary(stream, "user_id", "value"), path, "complete").select("user_id", "n", (F.round("mean", 9) + 0.0).alias("mean"))


@catalog.add(f"WITH {EDGES} SELECT DISTINCT src, dst, action FROM e")
def incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that come in four files, the table extended batch by batch."""
    edges = transition_edges(spark, sf_dir).select("src", "dst", "action")
    stream, path = _stream(spark, edges.union(edges), 4)
    streams.incremental_edges(stream, f"{path}/edges", f"{path}/checkpoint", ["src", "dst", "action"]).awaitTermination()
    return spark.read.schema(edges.schema).parquet(f"{path}/edges/*/*").select("src", "dst", "action")


@catalog.add("""
SELECT CAST(user_id AS VARCHAR) AS queue, array_to_string(list(event_id ORDER BY event_id)[-5:], ',') AS items, CAST(greatest(0, count(*) - 5) AS BIGINT) AS dropped FROM events GROUP BY user_id""")
def bounded_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, path = _stream(spark, table(spark, sf_dir, "events").select("user_id", "event_id"), 1)
    out = _result(streams.bounded_queue(stream, "user_id", "event_id", "event_id", 5), path, "update")
    return out.select("queue", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "dropped")


@catalog.add("""
SELECT o_orderkey FROM orders WHERE 25 - o_custkey % 30 <= 10""")
def staleness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.fresh_enough(table(spark, sf_dir, "orders").withColumn("version", F.col("o_custkey") % 30), "version", 25, 10).select("o_orderkey")


@catalog.add("""
SELECT CAST(iteration AS BIGINT) AS iteration, phase FROM (SELECT l_orderkey AS iteration, ['collect', 'train', 'evaluate'][l_linenumber] AS phase, l_linenumber FROM lineitem WHERE l_linenumber <= 3) ORDER BY iteration DESC, l_linenumber DESC LIMIT 1""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = ["collect", "train", "evaluate"]
    name = F.get(F.array(*map(F.lit, [*phases, "other"])), F.least(F.col("l_linenumber"), F.lit(4)).cast("int") - 1)
    found = streams.last_complete(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("iteration"), name.alias("phase")), phases)
    return spark.createDataFrame([found] if found else [], "iteration long, phase string")


@catalog.add("""
SELECT epoch, doc_id, CAST((row_number() OVER (PARTITION BY epoch ORDER BY md5('7|' || epoch || '|' || doc_id), doc_id) - 1) // 64 AS BIGINT) AS batch FROM documents, (SELECT CAST(unnest(range(0, 2)) AS INTEGER) AS epoch)""")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.mini_batches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 64, 2, 7).select("epoch", "doc_id", "batch")


@catalog.add("""
SELECT doc_id, lang, 1 AS part FROM documents UNION ALL SELECT doc_id, lang, 2 FROM documents WHERE doc_id % 2 = 0""")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out, meta = B.concat([rows.withColumn("part", F.lit(1)), rows.where("doc_id % 2 = 0").withColumn("part", F.lit(2))], [{"metrics": 1, "model": "m"}, {"metrics": 2, "model": "m"}])
    if meta != {"metrics": [1, 2], "model": "m"}:
        raise ValueError("meta values")
    return out


@catalog.add(f"""
WITH {EDGES}, bad AS (SELECT node FROM nodes WHERE node LIKE '%:error') SELECT src, dst, action FROM e WHERE src NOT IN (FROM bad) AND dst NOT IN (FROM bad)""")
def dropped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = transition_nodes(spark, sf_dir)
    return G.drop_nodes(nodes, transition_edges(spark, sf_dir), nodes.where(F.col("node").endswith(":error")))[1].select("src", "dst", "action")


@catalog.add(f"""
WITH {EDGES}, o AS (SELECT node FROM nodes WHERE node LIKE '%:view' OR node LIKE '%:click'), i AS (SELECT src, dst, action FROM e WHERE src IN (FROM o) AND dst IN (FROM o)),
d AS (SELECT node FROM (SELECT src AS node FROM i UNION ALL SELECT dst FROM i) GROUP BY node HAVING count(*) >= 6) SELECT src, dst, action FROM i WHERE src IN (FROM d) AND dst IN (FROM d)""")
def cluster_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two event types, those of a degree under six dropped once."""
    nodes = transition_nodes(spark, sf_dir)
    labels = nodes.withColumn("label", F.when(F.col("node").rlike(":(view|click)$"), "seen").otherwise("other"))
    return G.cluster(nodes, transition_edges(spark, sf_dir), labels, "seen", 6)[1].select("src", "dst", "action")


@catalog.add(f"""
WITH {EDGES}, n AS (SELECT min(node) AS n FROM nodes) SELECT coalesce((SELECT string_agg(dst || '|' || action, ',' ORDER BY dst, action) FROM e WHERE src = n), '') AS out_edges, coalesce((SELECT string_agg(src || '|' || action, ',' ORDER BY src, action) FROM e WHERE dst = n), '') AS in_edges FROM n""")
def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = transition_nodes(spark, sf_dir).agg(F.min("node").alias("n")).first()["n"]
    out = G.node_detail(transition_edges(spark, sf_dir), first)
    return out.select(*(F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["node"], x["action"])), ",").alias(c) for c in ("out_edges", "in_edges")))


@catalog.add("""
WITH h AS (SELECT doc_id, lang, md5('42|bucket|' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) > 20 AS late FROM h) SELECT doc_id, lang FROM r ORDER BY late, h, doc_id LIMIT 100""")
def bucket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of each bucket, then the rest up to a hundred: the operator's quota and total."""
    return X.bucket_selection(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, 100).select("doc_id", "lang")


@catalog.add("""
SELECT event_id, '{' || event_id || '}' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '/' || user_id END AS boxed, CASE WHEN event_id % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE value END AS score, 'q.  b ' || user_id AS clean FROM events""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxed answers with nested braces, a score per data source, cleaned completions."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").withColumn("even", F.col("event_id") % 2 == 0)
    s = F.concat(F.lit(r"so \boxed{1} or \boxed{{"), e, F.lit("}"), F.when(F.col("even"), "").otherwise(F.concat(F.lit("/"), u)), F.lit("} end}"))
    score = text.dispatch_score(F.when(F.col("even"), "math").otherwise("code"), {"math": F.lit(1.0), "code": F.col("value")})
    return rows.select("event_id", text.boxed_answer(s).alias("boxed"), score.alias("score"), text.completion_clean(F.concat(F.lit(" q [title] [x] b  "), u)).alias("clean"))


@catalog.add("""
SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), 'x'] AS inputs, ['1'] AS outputs FROM orders WHERE o_orderkey % 3 <> 0""")
def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cases in JSON; every third can't be read."""
    body = F.concat(F.lit('{"inputs": ["'), F.col("o_custkey").cast("string"), F.lit('", "x"], "outputs": ["1"]}'))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "not json").otherwise(body).alias("cases"))
    return sft.decoded_cases(rows, "o_orderkey", "cases")


@catalog.add("""
SELECT l_orderkey, l_linenumber, round(300 * x / z + 160, 6) + 0.0 AS u, round(300 * y / z + 120, 6) + 0.0 AS v, z > 0 AND 300 * x / z + 160 >= 0 AND 300 * x / z + 160 < 320 AND 300 * y / z + 120 >= 0 AND 300 * y / z + 120 < 240 AND z <= d + 0.1 AS visible FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 3.5 AS y, l_discount * 100 - 5 AS x, l_quantity AS z, 10.0 + l_tax * 300 AS d FROM lineitem)""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of camera-space points, visible if in view and not behind the depth map."""
    x, y = F.col("l_discount") * 100 - 5, F.col("l_linenumber") - 3.5
    p = geometry.projected(x, y, F.col("l_quantity"), 10.0 + F.col("l_tax") * 300, 300.0, 320, 240)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(p["u"]).alias("u"), r6(p["v"]).alias("v"), p["visible"].alias("visible"))


@catalog.add(f"""
WITH {EVENTS} SELECT event_id, CAST(greatest(0, least(7, floor(k / 10.0))) + 8 * greatest(0, least(7, floor(value / 10))) AS INTEGER) AS cell FROM ev""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", geometry.grid_cell(F.col("k"), F.col("value"), 10.0, 8, 8).cast("int").alias("cell"))


@catalog.add("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '#@' || chr(10) || ' ' || event_id END AS first, CASE WHEN event_id % 2 = 1 THEN '#.' || chr(10) || ' ' || event_id END AS after FROM events""")
def text_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of first and later observations, lines stripped on the right."""
    tail = F.concat(F.col("event_id").cast("string"), F.lit("  \nDecide your next action"))
    seen = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[Initial Observation]:\n#@  \n "), tail)).otherwise(F.concat(F.lit("After that, the observation is:\n#. \t\n "), tail))
    return table(spark, sf_dir, "events").select("event_id", parse.text_grid(seen, True).alias("first"), parse.text_grid(seen, False).alias("after"))


@catalog.add("""
SELECT event_id, user_id FROM events ORDER BY md5('7|' || event_id), event_id LIMIT 2500""")
def parquet_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of fixed size from a table that comes as several files: the sampling operator itself."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    paths = [shared_dir(spark, f"sample{i}") for i in range(3)]
    for i, path in enumerate(paths):
        rows.where(F.pmod("event_id", F.lit(3)) == i).write.parquet(path)
    return readers.read_parquet_sample(spark, paths, "event_id", 2500, seed=7)
