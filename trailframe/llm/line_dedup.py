"""Line dedup with DataFrame functions only.

Lines are exploded with their position and normalised; each key that is long
enough becomes one row (document, position, two 64-bit hashes), written once.
Hashes that fewer rows than the threshold hold are out by a count with map-side
partial sums; for the others distinct documents are counted, and the largest
document id that holds each. Positions to drop are collected per document, and
the lines between them are put together again in order, in linear time, with
their original bytes.

Defined cases: null or empty text is one empty line; rows that repeat a doc_id
are one document when documents are counted, each keeps and drops its own lines,
and all rows of the largest doc_id keep the line; rows without a doc_id are one
document, smaller than any other; line length and the number of lines have no
limit; an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import read
from trailframe.storage import cut

MIN_CHARS = 40
MIN_DOCS = 5
_STRIP = " \t\n\x0b\x0c\r"
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    key = F.btrim(line, F.lit(_STRIP))
    # both forms agree on ASCII, where the first one is faster
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UP, _UP.lower()))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: (k, t). Rows (k, u, pos, a, b) for each line whose key has min_chars code points; u is the text's hash."""
    hashed = docs.select("k", "t", F.xxhash64("t").alias("u"))  # before the lines: once for each text
    lines = hashed.select("k", "u", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    keys = lines.where(F.octet_length("line") >= min_chars).select("k", "u", "pos", _key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("k", "u", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, text kept, n_lines, n_dropped, rest), one per input row; rest is a struct of the carried columns, if any."""
    spark = df.sparkSession
    rest = [F.struct(*(df[c] for c in carry)).alias("rest")] if carry else []
    docs = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t"), *rest)
    keys = cut(spark, line_keys(docs.select("k", "t"), min_chars), "lines")
    # written, so that the joins see their sizes and can split a line that very many documents hold
    often = cut(spark, keys.groupBy("a", "b").count().where(F.col("count") >= min_docs).select("a", "b"), "often")
    held = cut(spark, keys.join(often, ["a", "b"]), "held")
    common = held.select("a", "b", "k").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last")).where(F.col("n") >= min_docs).select("a", "b", "last")
    common = cut(spark, common, "common")
    drop = held.join(common, ["a", "b"]).where(~F.col("k").eqNullSafe(F.col("last")))
    drop = drop.groupBy(F.col("k").alias("d"), F.col("u").alias("v")).agg(F.collect_set("pos").alias("drop"))
    joined = docs.withColumn("u", F.xxhash64("t")).join(drop, (F.col("u") == F.col("v")) & F.col("k").eqNullSafe(F.col("d")), "left")
    more = ["rest"] if carry else []
    # the lambda below must find the lines as a column: an expression would be split again for each of its steps
    split = joined.select("k", *more, "t", "drop", F.explode(F.array(_lines(F.col("t")))).alias("line"))
    size = F.size("line")
    stay = F.array_except(F.sequence(F.lit(0), size - 1), "drop")  # by a hash set, in order
    text = F.when(F.col("drop").isNull(), F.coalesce("t", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("line", i)), "\n"))
    result = split.select("k", *more, text.alias("kept"), size.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return result.select(F.col("k").alias(id_col), F.col("kept").alias(text_col), "n_lines", "n_dropped", *more)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM s),
y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(doc_id) AS last FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
z AS (SELECT y.*, c.last IS NOT NULL AND c.last <> y.doc_id AS gone FROM y LEFT JOIN c ON y.key = c.key AND length(y.key) >= 40)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM z GROUP BY doc_id
"""
