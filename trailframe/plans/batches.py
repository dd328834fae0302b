"""Joins, batch rows, splits and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators import batch as B
from trailframe.operators import joins as J
from trailframe.operators import sampling as S
from trailframe.operators.retrieval import bm25_topk, dense_topk
from trailframe.plans.catalog import Catalog, r6, table

catalog = Catalog()


@catalog.add("""
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1)
SELECT s_suppkey, c_custkey FROM supplier JOIN s ON s_nationkey = c_nationkey""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n")
    index = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n")
    return J.lookup(rows, index, "n", "c_custkey").select("s_suppkey", "c_custkey")


@catalog.add("""
WITH i AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) SELECT d.doc_id, CAST(coalesce(a.q, b.q, -1) AS INTEGER) AS q FROM documents d LEFT JOIN i a ON a.doc_id = d.doc_id LEFT JOIN i b ON b.doc_id = d.doc_id // 2""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 2").alias("half"))
    index = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("quality").alias("q"))
    return J.lookup_or(docs, index, [("doc_id", "k"), ("half", "k")], "q").select("doc_id", F.coalesce("q", F.lit(-1)).alias("q"))


@catalog.add("""
SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)""")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"))
    return J.common_keys(a, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), "n", least=1)


@catalog.add("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@catalog.add("""
WITH a AS (SELECT l_orderkey AS uid, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
b AS (SELECT l_orderkey AS uid, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey DESC, l_partkey) AS k FROM lineitem WHERE l_tax > 0.01)
SELECT uid, CAST(k AS INTEGER) AS k, coalesce(l_partkey, -1) AS l_partkey, coalesce(l_suppkey, -1) AS l_suppkey, l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AS ok FROM a FULL JOIN b USING (uid, k)""")
def strict_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("uid", F.col("l_orderkey"))
    a = li.withColumn("_s", F.col("l_suppkey")).select("uid", "l_partkey", "l_linenumber", "_s")
    b = li.where("l_tax > 0.01").select("uid", "l_suppkey", F.col("l_partkey").alias("_p"))
    out = J.aligned(a, b, "uid", ["l_linenumber", "l_partkey", "_s"], [F.desc("l_suppkey"), "_p"])
    return out.select("uid", "k", F.coalesce("l_partkey", F.lit(-1)).alias("l_partkey"), F.coalesce("l_suppkey", F.lit(-1)).alias("l_suppkey"), "ok")


@catalog.add("""
SELECT doc_id, CASE WHEN q IS NULL THEN 'missing' WHEN q THEN 'success' ELSE 'fail' END AS outcome FROM documents LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q FROM labels GROUP BY 1) USING (doc_id)""")
def success_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return J.success_split(table(spark, sf_dir, "documents").select("doc_id"), metrics, "doc_id", "ok")


@catalog.add("""
SELECT conv_id, array_to_string(list(CASE WHEN length(text) > 100 THEN 'new' ELSE role END ORDER BY turn), ',') AS texts, CAST(count(*) FILTER (WHERE length(text) > 100) AS BIGINT) AS n_improved FROM conversations GROUP BY conv_id""")
def reassemble_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    better = rows.where(F.length("text") > 100).select("conv_id", "turn", F.lit("new").alias("role"))
    return J.reassembled(rows.select("conv_id", "turn", "role"), better, "conv_id", "turn", "role").withColumn("texts", F.array_join("texts", ","))


@catalog.add("""
WITH u AS (SELECT unnest(['http://a', 'http://b', 'http://c', 'http://d', 'http://e']) AS url), s AS (SELECT o_orderkey, url, row_number() OVER (PARTITION BY o_orderkey ORDER BY substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || url), 1, 16) DESC, url DESC) AS r FROM orders, u)
SELECT o_orderkey, array_to_string(list(url ORDER BY r), ' ') AS servers FROM s GROUP BY 1""")
def hrw_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = J.rendezvous(F.col("o_orderkey"), [f"http://{c}" for c in "abcde"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(servers, " ").alias("servers"))


@catalog.add("""
SELECT o_orderkey AS row_no, c.c_custkey, c.c_nationkey FROM orders JOIN customer c ON c.c_custkey = o_orderkey""")
def zip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("row_no", F.col("c_custkey"))
    out = J.zip_columns(c.select("row_no", "c_custkey", "c_nationkey"), c.select("row_no", "c_nationkey"), "row_no")
    return out.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no")), "row_no")


@catalog.add("""
WITH n AS (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS row_no, count(*) OVER () AS t FROM customer)
SELECT c_custkey, row_no, CAST(floor(row_no / ceil(t / 7)) AS BIGINT) AS chunk FROM n""")
def batch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])
    return B.chunked(rows, "row_no", 7).select("c_custkey", "row_no", "chunk")


@catalog.add("""
SELECT n_nationkey, CAST(c AS BIGINT) AS copy, CAST(n_nationkey * 3 + c AS BIGINT) AS place, CAST(c * 25 + n_nationkey AS BIGINT) AS tiled FROM nation, (SELECT unnest(range(3)) AS c)""")
def batch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("row_no"))
    a = B.repeated(rows, "row_no", 3)
    b = B.repeated(rows, "row_no", 3, interleave=False).select("n_nationkey", "copy", F.col("place").alias("tiled"))
    return a.join(b, ["n_nationkey", "copy"]).select("n_nationkey", "copy", "place", "tiled")


@catalog.add("""
SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS row_no, false AS is_pad FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey + 25 AS BIGINT), true FROM nation WHERE n_nationkey < 7""")
def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("row_no"))
    return B.padded(rows, "row_no", 32)


@catalog.add("""
SELECT n_nationkey, CAST(24 - n_nationkey AS BIGINT) AS row_no FROM nation WHERE (24 - n_nationkey) >= 4 AND (24 - n_nationkey) < 20 AND (24 - n_nationkey - 4) % 3 = 0""")
def batch_slice_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("row_no"))
    order = spark.range(25).select(F.col("id").alias("row_no"), (24 - F.col("id")).alias("to"))
    return B.sliced(B.reordered(rows, "row_no", order, "to"), "row_no", 4, 20, 3).select("n_nationkey", "row_no")


@catalog.add("""
SELECT CAST(n_nationkey // 4 AS BIGINT) AS fold, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY 1""")
def batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("row_no"))
    return B.folded(rows, "row_no", 4, ["n_name"]).select("fold", F.array_join("n_name", ",").alias("names"))


@catalog.add()
def seqlen_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in 8 parts of nearly equal length, and how unequal they are."""
    rows = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("b"), "doc_id", "n_chars")
    parts = B.balanced(rows, "b", "doc_id", "n_chars", 8)
    return parts.groupBy("batch", "part").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))


@catalog.add("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('42|split|' || source), source) AS r, count(*) OVER () AS t FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CASE WHEN r <= floor(t * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(t * 0.8 + 1e-9) + floor(t * 0.1 + 1e-9) THEN 'valid' ELSE 'test' END AS split FROM documents JOIN g USING (source)""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["train", "valid", "test"], [8, 1, 1]).select("doc_id", "split")


@catalog.add("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|take|' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 3""")
def mini_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source: the sampling operator itself."""
    return S.take_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@catalog.add("""
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42|rows|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.9 THEN 'train' ELSE 'validation' END AS split FROM documents""")
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.row_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.9).select("doc_id", "split")


@catalog.add("""
WITH w AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 2.25 ELSE 1.0 END AS w, CAST('0x' || substr(md5('42|mix|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents)
SELECT doc_id, CAST(unnest(range(1, CAST(floor(w) + (CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END) + 1 AS BIGINT))) AS INTEGER) AS copy FROM w""")
def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.weighted_mix(rows, "lang", "doc_id", {"en": 0.5, "fr": 2.25, "de": 1.0, "es": 1.0}).select("doc_id", "copy")


@catalog.add("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|interleave|' || doc_id), doc_id) AS r FROM documents), m AS (SELECT min(n) AS lo FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
SELECT doc_id, lang, CAST(r AS BIGINT) AS round FROM r, m WHERE r <= lo""")
def interleave_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interleaved(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "round")


@catalog.add("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|ring|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT a.source, a.doc_id, CAST(s.slot AS INTEGER) AS slot, b.doc_id AS negative FROM r a, (SELECT unnest(range(1, 4)) AS slot) s, r b WHERE a.n > 3 AND b.source = a.source AND b.r = (a.r - 1 + s.slot) % a.n + 1""")
def mcq_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.negatives(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@catalog.add("""
WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS s FROM customer), e AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM c),
w AS (SELECT 'pow' AS weighting, c_custkey, pow(abs(s), 2) + CAST(1e-8 AS DOUBLE) AS w FROM c UNION ALL SELECT 'max_min', c_custkey, CASE WHEN s IN (lo, hi) THEN CAST(1 AS DOUBLE) ELSE 0 END + CAST(1e-8 AS DOUBLE) FROM c, e
  UNION ALL SELECT 'max_random', c_custkey, CASE WHEN s = hi THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END + CAST(1e-8 AS DOUBLE) FROM c, e),
u AS (SELECT weighting, c_custkey, greatest(1, CAST(floor(w / sum(w) OVER (PARTITION BY weighting) * 1125899906842624) AS BIGINT)) AS u FROM w),
p AS (SELECT weighting, c_custkey, sum(u) OVER (PARTITION BY weighting ORDER BY c_custkey) - u AS start, sum(u) OVER (PARTITION BY weighting) AS total FROM u),
d AS (SELECT weighting, draw, least(total - 1, CAST(floor(CAST('0x' || substr(md5('42|draw|' || draw), 1, 13) AS BIGINT) / 4503599627370496.0 * total) AS HUGEINT)) AS at FROM (SELECT DISTINCT weighting, CAST(total AS DOUBLE) AS total FROM p), (SELECT unnest(range(0, n)) AS draw FROM e))
SELECT d.weighting, d.draw, p.c_custkey FROM d ASOF JOIN p ON p.weighting = d.weighting AND d.at >= p.start""")
def resample_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By each weighting as many draws with replacement as there are customers."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    parts = [S.weighted_draws(S.draw_weights(rows, "c_acctbal", how), "c_custkey", "weight").select(F.lit(how).alias("weighting"), "draw", "c_custkey") for how in ("pow", "max_min", "max_random")]
    return parts[0].union(parts[1]).union(parts[2])


@catalog.add("""
WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_inner_product(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM q, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM s)
SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank, round(s, 6) + 0.0 AS score FROM r WHERE r <= 5""")
def dense_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries (ids divisible by 100) against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = dense_topk(rows.where("vec_id % 100 = 0"), rows, "vec_id", "v", 5)
    return out.select("query_id", "doc_id", "rank", r6("score").alias("score"))


@catalog.add(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS term FROM benchmark),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(w) / mean))), 6) AS score FROM a JOIN df USING (term) JOIN tf USING (term) JOIN w USING (doc_id), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) SELECT item_id AS q, doc_id AS d, score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries against all documents."""
    return bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 5)


@catalog.add("""
WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars < 400 THEN 'single' WHEN n_chars < 2500 THEN 'mix' ELSE 'multi' END AS cls FROM documents),
n AS (SELECT lang, count(*) FILTER (WHERE cls = 'single') AS a, count(*) FILTER (WHERE cls = 'multi') AS c FROM d GROUP BY lang),
q AS (SELECT lang, a, c, least(a, 75) AS qa, least(c, 25 + greatest(75 - a, 0)) AS qc, greatest(25 + greatest(75 - a, 0) - c, 0) AS l FROM n),
b AS (SELECT lang, qa + least(a - qa, l - least(c - qc, l)) AS qa, qc + least(c - qc, l) AS qc FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, cls ORDER BY md5('42|ratio|' || doc_id), doc_id) AS r FROM d WHERE cls <> 'mix')
SELECT r.lang, r.cls, r.doc_id FROM r JOIN b ON b.lang IS NOT DISTINCT FROM r.lang WHERE r.r <= CASE r.cls WHEN 'single' THEN qa ELSE qc END""")
def ratio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents of each language, 3 short ones to 1 long one; those between are excluded."""
    cls = F.when(F.col("n_chars") < 400, "single").when(F.col("n_chars") < 2500, "mix").otherwise("multi")
    return S.ratio_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", cls.alias("cls")), "lang", "cls", "doc_id", {"single": 3, "mix": 0, "multi": 1}, 100).select("lang", "cls", "doc_id")


@catalog.add("""
WITH n AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'a' WHEN doc_id % 5 < 3 THEN 'b' ELSE 'c' END AS s, doc_id FROM documents), r AS (SELECT s, doc_id, row_number() OVER (PARTITION BY s ORDER BY md5('42|interleave|' || doc_id), doc_id) AS r FROM n),
c AS (SELECT s, count(*) AS n FROM n GROUP BY s), u AS (SELECT i, CAST('0x' || substr(md5('42|source|' || i), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT unnest(range(0, 2 * count(*))) AS i FROM documents)),
d AS (SELECT i, s, row_number() OVER (PARTITION BY s ORDER BY i) AS r FROM (SELECT i, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS s FROM u)),
e AS (SELECT min(i) AS stop FROM d JOIN c USING (s) WHERE r = n + 1)
SELECT d.s AS source, doc_id, i AS draw FROM d JOIN r ON r.s = d.s AND r.r = d.r, e WHERE i < stop""")
def interleave_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of documents drawn 5 : 3 : 2 until one has no more."""
    group = F.when(F.col("doc_id") % 5 == 0, "a").when(F.col("doc_id") % 5 < 3, "b").otherwise("c")
    return S.interleaved_by(table(spark, sf_dir, "documents").select("doc_id", group.alias("source")), "source", "doc_id", {"a": 0.5, "b": 0.3, "c": 0.2}).select("source", "doc_id", "draw")


@catalog.add("""
WITH f AS (SELECT o_custkey, avg(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(round(spend, 6), -1) AS spend, coalesce(orders, -1) AS orders, spend IS NULL AS missing FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def coverage_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders' factors; NaN, shown as -1, without any."""
    factors = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("orders"))
    out = J.with_factors(table(spark, sf_dir, "customer").select("c_custkey"), factors, "c_custkey")
    shown = lambda c: F.when(F.isnan(c), -1.0).otherwise(F.round(c, 6)).alias(c)
    return out.select("c_custkey", shown("spend"), shown("orders"), F.isnan("spend").alias("missing"))


@catalog.add("""
WITH RECURSIVE d AS (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS b, n_chars AS s, row_number() OVER (PARTITION BY CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) ORDER BY doc_id) AS r FROM documents),
g AS (SELECT b, CAST(0 AS BIGINT) AS r, list_transform(range(0, 4), lambda x: CAST(0 AS BIGINT)) AS l FROM (SELECT DISTINCT b FROM d)
  UNION ALL SELECT d.b, d.r, list_transform(range(1, 5), lambda i: CASE WHEN i = list_position(l, list_min(l)) THEN l[i] + d.s ELSE l[i] END) FROM g JOIN d ON d.b = g.b AND d.r = g.r + 1),
e AS (SELECT b, l FROM g QUALIFY row_number() OVER (PARTITION BY b ORDER BY r DESC) = 1)
SELECT b AS batch, list_min(l) AS least, list_max(l) AS most, list_max(l) - list_min(l) AS gap FROM e""")
def greedy_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, in id order, each to the least loaded of 4 parts; how unequal these become."""
    rows = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("b"), "doc_id", "n_chars")
    per = B.balanced(rows, "b", "doc_id", "n_chars", 4, "greedy").groupBy("batch", "part").agg(F.sum("size").alias("s"))
    parts = per.groupBy("batch").agg(F.min("s").alias("lo"), F.max("s").alias("most"), F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("n") < 4, 0).otherwise(F.col("lo"))
    return parts.select("batch", least.alias("least"), "most", (F.col("most") - least).alias("gap"))


@catalog.add("""
SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS popped FROM customer""")
def batch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns renamed and one popped, put side by side again by row."""
    rows = B.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"), ["c_custkey"])
    left, popped = B.columns(rows, ["row_no", "c_custkey", "c_mktsegment"], [], {"c_custkey": "id", "c_mktsegment": "segment"})[0], B.columns(rows, None, ["row_no", "c_acctbal"])[1]
    return left.join(popped, "row_no").select("id", "segment", F.col("c_acctbal").alias("popped"))
