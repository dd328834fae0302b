"""Secret scans with DataFrame functions only: multipart credential linking.

Every kind's matches are marked inside the text by one regexp_replace with
control characters, split into pieces, and only the pieces' lengths leave the
scan. Running sums over the pieces give code-point spans. Kinds, as listed:

    assign    keyword, assignment sign and a value of 6 or more characters
    access    access key id (strong identifier)
    hex       run of 24 or more hexadecimal digits
    ident     assigned client, account or key id (weak identifier)
    secret    run of 40 or more base64 characters (weak secret)
    endpoint  URL with a host (weak)

The first three are reported always. A weak span that overlaps one of them is
dropped; of the others, taken by start and then in the order above, one is kept
if it overlaps no weak span kept before it: one value is one part. Identifiers are `access` and `ident`;
secrets are `secret`, and those of `assign` and `hex` that don't overlap an
`access`. The weak spans left are linked by an interval join within a scope of
SCOPE code points: an `ident` needs a secret, a `secret` an identifier, an
`endpoint` both. As only the existence of a partner counts, the join looks at
the nearest partner before and after, by two sorted passes over a document's
parts, and never makes pairs.

Defined cases: null text counts as empty; rows that repeat an id and a text
give repeated results; texts are never cut and the work is linear in them and
their matches; null ids pass through; an empty table gives an empty result;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.llm._text import read

SCOPE = 300
KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]


def _either(words: str) -> str:
    """A pattern with its ASCII letters in either case, alike in all engines."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: The patterns of the base kinds; two groups where the second one's length counts.
ASSIGN = rf"""((?:{_either("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = rf"""(?:{_either("client|account|access_?key|key")})_?{_either("id")}["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{{4,}}"""
SECRET = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~/-]*)?"
_OPEN, _MID, _SHUT, _ELSE = "\x01", "\x02", "\x03", "\x04"


def _pieces(text: Column, kind: int, pattern: str, needs: Column | None = None) -> Column:
    """Pieces of the text, each but the first beginning with a match: (kind, place, length, match length, ok)."""
    grouped = pattern == ASSIGN
    marks = 2 if grouped else 1
    put = f"{_OPEN}$1{_MID}$2{_SHUT}" if grouped else f"{_OPEN}$0{_SHUT}"
    parts = F.split(F.regexp_replace(text, pattern, put), _OPEN, -1)
    parts = F.when(F.size(parts) > 1, parts)
    if needs is not None:
        parts = F.when(needs, parts)

    def piece(x: Column, i: Column) -> Column:
        shut = F.instr(x, _SHUT)
        ok = (shut - F.instr(x, _MID) > 6) if grouped else F.lit(True)
        head = i == 0
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.when(head, F.char_length(x)).otherwise(F.char_length(x) - marks).alias("size"),
            (shut - marks).alias("match"),
            (~head & ok).alias("ok"),
        )

    return F.coalesce(F.transform(parts, piece), F.array().cast("array<struct<kind:int,i:int,size:int,match:int,ok:boolean>>"))


def secret_parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of all kinds, not yet linked: (k, h, kind, start, end); h is the text's hash."""
    t = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    marked = F.col("t").contains(_OPEN) | F.col("t").contains(_MID) | F.col("t").contains(_SHUT)
    docs = docs.select("k", "h", F.when(marked, F.translate("t", _OPEN + _MID + _SHUT, _ELSE * 3)).otherwise(F.col("t")).alias("t"))
    x = F.col("t")
    patterns = [(ASSIGN, None), (ACCESS, x.contains("AKIA")), (HEX, None), (IDENT, None), (SECRET, None), (ENDPOINT, x.contains("://"))]
    rows = docs.select("k", "h", F.explode(F.flatten(F.array(*(_pieces(x, n, p, needs) for n, (p, needs) in enumerate(patterns))))).alias("p")).select("k", "h", "p.*")
    own = Window.partitionBy("k", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition("k", "h").dropDuplicates(["k", "h", "kind", "i"])
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.where("ok").select("k", "h", "kind", "start", (F.col("start") + F.col("match")).alias("end"))


def _apart(weak: DataFrame) -> DataFrame:
    """weak: (k, h, kind, start, end). In order, those that overlap none kept before.

    Only spans that hang together by overlaps, a few of the three kinds, are folded in one array.
    """
    order = Window.partitionBy("k", "h").orderBy("start", "kind", "end")
    edge = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    rows = weak.withColumn("edge", edge.cast("int")).withColumn("cluster", F.sum("edge").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    none = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["last"], F.struct(x["end"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    return rows.groupBy("k", "h", "cluster").agg(spans.alias("spans")).select("k", "h", F.explode(F.aggregate("spans", none, step, lambda acc: acc["kept"])).alias("x")).select("k", "h", "x.kind", "x.start", "x.end")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and the weak ones whose complementary parts stand within the scope."""
    kind = F.col("kind")
    base = kind < 3
    ahead = Window.partitionBy("k", "h").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("k", "h").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)

    def before(of: Column) -> Column:
        return F.max(F.when(of, F.col("end"))).over(ahead)

    def after(of: Column) -> Column:
        return F.min(F.when(of, F.col("start"))).over(behind)

    def overlaps(of: Column) -> Column:
        return F.coalesce(before(of) > F.col("start"), F.lit(False)) | F.coalesce(after(of) < F.col("end"), F.lit(False))

    def near(of: Column) -> Column:
        return F.coalesce(F.col("start") - before(of) <= scope, F.lit(False)) | F.coalesce(after(of) - F.col("end") <= scope, F.lit(False))

    rows = parts.withColumns({"covered": overlaps(base), "one": overlaps(kind == 1)}).where(base | ~F.col("covered"))
    apart = _apart(rows.where(~base)).withColumns({"one": F.lit(False), "covered": F.lit(False)})
    rows = rows.where(base).select("k", "h", "kind", "start", "end", "one", "covered").unionByName(apart)
    secret = (kind == 4) | kind.isin(0, 2) & ~F.col("one")
    rows = rows.withColumns({"by_id": near(kind.isin(1, 3)), "by_secret": near(secret)})
    keep = base | F.when(kind == 3, F.col("by_secret")).when(kind == 4, F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret"))
    return rows.where(keep).select("k", "h", "kind", "start", "end")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Rows (id, spans array of (start, kind, end)), one per input row; kind is a place in KINDS."""
    found = link_parts(secret_parts(df, id_col, text_col), scope).groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    docs = df.select(df[id_col].alias("k"), F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("h"))
    found = found.select(F.col("k").alias("fk"), F.col("h").alias("fh"), "spans")
    out = docs.join(found, (F.col("h") == F.col("fh")) & F.col("k").eqNullSafe(F.col("fk")), "left")
    return out.select(F.col("k").alias(id_col), F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = span_text(F.filter("spans", lambda s: s["kind"] < 3))
    return out.select("doc_id", *n, F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in SQL: pieces between marks for the spans, and every pair of a document's parts for the links."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    arms = []
    for n, p in enumerate((ASSIGN, ACCESS, HEX, IDENT, SECRET, ENDPOINT)):
        put = r"chr(1) || '\1' || chr(2) || '\2' || chr(3)" if n == 0 else r"chr(1) || '\0' || chr(3)"
        arms.append(f"SELECT doc_id, {n} AS kind, {2 if n == 0 else 1} AS marks, string_split(regexp_replace(t, {quoted(p)}, {put}, 'g'), chr(1)) AS a FROM d")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM documents),
s AS ({" UNION ALL ".join(arms)}),
x AS (SELECT doc_id, kind, marks, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS i FROM s WHERE len(a) > 1),
y AS (SELECT doc_id, kind, i, strpos(piece, chr(3)) AS shut, strpos(piece, chr(2)) AS mid, marks,
  sum(length(piece) - CASE WHEN i = 1 THEN 0 ELSE marks END) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM x),
p AS (SELECT doc_id, kind, CAST(start AS BIGINT) AS start, CAST(start + shut - marks AS BIGINT) AS fin FROM y WHERE i > 1 AND (kind > 0 OR shut - mid > 6)),
o AS (SELECT a.doc_id, a.kind, a.start, a.fin, coalesce(bool_or(b.kind < 3), false) AS covered, coalesce(bool_or(b.kind = 1), false) AS one
  FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND (a.start, a.kind) <> (b.start, b.kind) AND b.start < a.fin AND a.start < b.fin GROUP BY ALL),
w AS (SELECT * FROM o WHERE kind < 3 OR NOT covered),
wn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, kind, fin) AS r FROM w WHERE kind > 2),
g AS (SELECT doc_id, r, kind, start, fin, fin AS last, true AS keep FROM wn WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, n.kind, n.start, n.fin, CASE WHEN n.start >= g.last THEN n.fin ELSE g.last END, n.start >= g.last FROM g JOIN wn n ON n.doc_id = g.doc_id AND n.r = g.r + 1),
v AS (SELECT doc_id, kind, start, fin, one FROM w WHERE kind < 3 UNION ALL SELECT doc_id, kind, start, fin, false FROM g WHERE keep),
near AS (SELECT a.doc_id, a.kind, a.start, a.fin, coalesce(bool_or(b.kind IN (1, 3)), false) AS by_id, coalesce(bool_or(b.kind = 4 OR b.kind IN (0, 2) AND NOT b.one), false) AS by_secret
  FROM v a LEFT JOIN v b ON a.doc_id = b.doc_id AND (a.start - b.fin BETWEEN 0 AND {SCOPE} OR b.start - a.fin BETWEEN 0 AND {SCOPE}) GROUP BY ALL),
k AS (SELECT * FROM near WHERE CASE kind WHEN 3 THEN by_secret WHEN 4 THEN by_id WHEN 5 THEN by_id AND by_secret ELSE true END)
SELECT documents.doc_id, CAST(count(*) FILTER (WHERE kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE kind = 2) AS BIGINT) AS n_hex,
  sha256({text} FILTER (WHERE kind < 3), '')) AS base_sha256, {text} FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id GROUP BY documents.doc_id
"""


SQL = _sql()
