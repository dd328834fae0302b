"""Parsing, text and geometry on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import arrays, geometry, parse, text
from trailframe.plans.catalog import EVENTS, Catalog, events, r6, table
from trailframe.sources.readers import eval_to_rollout

catalog = Catalog()


@catalog.add(r"""
WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(t, '(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>', 1)) AS INTEGER) AS n_messages,
  array_to_string(regexp_extract_all(t, '(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>', 1), ',') AS roles FROM c""")
def chatml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eval_to_rollout(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    got = rows.withColumn("m", parse.chatml_messages(F.col("text")))
    return got.select("conv_id", F.length("text").alias("n_chars"), F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"))


@catalog.add(r"""
WITH t AS (SELECT l_orderkey, l_linenumber, '[tx=' || CAST(l_linenumber AS VARCHAR) || '.5, ty=-' || CAST(l_suppkey AS VARCHAR) || ', tz=1e1, rx=' || CAST(l_partkey AS VARCHAR) || '°, ry=0, rz=9°]' AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(regexp_extract(s, '\[tx=([\d.e+-]+),\s*ty=([\d.e+-]+)', 1) AS DOUBLE) AS tx,
  CAST(regexp_extract(s, '\[tx=([\d.e+-]+),\s*ty=([\d.e+-]+)', 2) AS DOUBLE) AS ty, CAST(10 AS DOUBLE) AS tz,
  CAST(regexp_extract(s, 'rx=([\d.e+-]+)°', 1) AS DOUBLE) AS rx FROM t""")
def pose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    s = F.concat(F.lit("[tx="), c("l_linenumber"), F.lit(".5, ty=-"), c("l_suppkey"), F.lit(", tz=1e1, rx="), c("l_partkey"), F.lit("°, ry=0, rz=9°]"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse.pose(s).alias("p")).select("l_orderkey", "l_linenumber", "p.tx", "p.ty", "p.tz", "p.rx")


@catalog.add(r"""
WITH t AS (SELECT o_orderkey, 'Go to scene' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || '_' || CAST(o_orderkey % 3 AS VARCHAR) || ' then <action> ' ||
  CASE WHEN o_orderkey % 4 = 0 THEN 'Answer (x)' ELSE 'Turn_Left | ' || o_orderpriority || ' |move_forward|' END || '</action>' AS s FROM orders),
a AS (SELECT o_orderkey, s, trim(regexp_extract(s, '(?s)<action>(.*?)</action>', 1)) AS body FROM t)
SELECT o_orderkey, regexp_extract(s, 'scene(\d+_\d+)', 1) AS scene, CASE WHEN o_orderkey % 4 <> 0 THEN body END AS action,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'turn_left | move_forward' END AS cleaned, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN 3 ELSE 0 END AS INTEGER) AS n_actions FROM a""")
def action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, "Answer (x)").otherwise(F.concat(F.lit("Turn_Left | "), "o_orderpriority", F.lit(" |move_forward|")))
    s = F.concat(F.lit("Go to scene"), F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("_"), (k % 3).cast("string"), F.lit(" then <action> "), body, F.lit("</action>"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).withColumn("action", parse.action(F.col("s")))
    return rows.select("o_orderkey", parse.scene(F.col("s")).alias("scene"), "action", parse.clean_action(F.col("action")).alias("cleaned"), F.when(F.col("action").isNotNull(), parse.action_count(F.col("action"))).otherwise(0).alias("n_actions"))


@catalog.add(r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think><action>go|turn(left)</action>' WHEN 1 THEN '<action>go</action>' ELSE 'no <action>x y(</action> z' END AS s FROM conversations)
SELECT conv_id, turn, turn % 3 = 0 AS free_think, true AS eval_mode, turn % 3 = 1 AS no_think,
  turn % 3 <> 2 AS list_ok, CAST(CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n_actions FROM t""")
def response_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 3
    s = F.when(turn == 0, F.concat(F.lit("<think>"), "text", F.lit("</think><action>go|turn(left)</action>"))).when(turn == 1, "<action>go</action>").otherwise("no <action>x y(</action> z")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))
    oks = [parse.formats.get(n)(F.col("s"))["ok"].alias(n) for n in ("free_think", "eval_mode", "no_think")]
    acts = parse.action_list(parse.formats.get("eval_mode")(F.col("s"))["actions"])
    return rows.select("conv_id", "turn", *oks, acts["ok"].alias("list_ok"), F.size(acts["actions"]).alias("n_actions"))


@catalog.add(r"""
SELECT page_id, 'A' AS first, CAST(2 AS INTEGER) AS n_options, url AS option_a FROM (SELECT page_id, rtrim(url, '.,;: ') AS url FROM pages)""")
def mcq_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("Which?\nA. "), "url", F.lit(".\nB. other;\n"))
    rows = table(spark, sf_dir, "pages").select("page_id", parse.mcq_options(s).alias("o"))
    return rows.select("page_id", F.array_min(F.map_keys("o")).alias("first"), F.size("o").alias("n_options"), F.element_at("o", "A").alias("option_a"))


@catalog.add("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) WHEN 2 THEN CAST(3.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reward FROM events""")
def reward_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    score, other = F.when(n == 0, F.col("value")), F.when(n == 1, F.col("props")).when(n == 2, "[1, 2.5]")
    return table(spark, sf_dir, "events").select("event_id", parse.reward(score, other).alias("reward"))


@catalog.add("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE value >= 0.5 GROUP BY user_id HAVING count(*) >= 3""")
def reward_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("value") >= 0.5)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@catalog.add("""
SELECT doc_id, left(text, 100) AS head FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'src1') ORDER BY doc_id LIMIT 50""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first 50 hits."""
    hit = F.lower("text").contains("worthless") | F.lower("source").contains("src1")
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", parse.cut_text(F.col("text")).alias("head")).orderBy("doc_id").limit(50)


@catalog.add(r"""
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[[:punct:]]', '', 'g') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(t, '(^|[^\pL\pN_])(a|an|the)($|[^\pL\pN_])', '\1 \3', 'g') AS t FROM a) -- again for neighbours that share a separator
SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS norm FROM b""")
def em_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("norm"))


@catalog.add("""
SELECT item_id, CAST(item_id % 3 AS INTEGER) AS n_tags, CASE WHEN item_id % 3 > 0 THEN 'x' || (item_id % 3) END AS answer, CASE WHEN item_id % 3 = 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM benchmark""")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id") % 3
    s = F.concat("text", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.when(n > 0, F.concat(F.lit("<answer> x"), i.cast("string"), F.lit("</answer>"))).otherwise("")), ""))
    rows = table(spark, sf_dir, "benchmark").select("item_id", s.alias("s")).withColumn("answer", parse.answer_tag(F.col("s")))
    score = text.answer_score(F.col("answer"), F.array(F.lit("X2."), F.lit("zzz")), F.col("s"))
    return rows.select("item_id", text.tag_count(F.col("s"), "<answer>").alias("n_tags"), "answer", score.alias("score"))


@catalog.add(r"""
WITH t AS (SELECT o_orderkey, 'sum ' || CAST(o_custkey AS VARCHAR) || ' ' || repeat('w', 20) || ' #### ' || CAST(o_orderkey AS VARCHAR) || ',000.' AS s FROM orders)
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '000' AS strict, CAST(o_orderkey AS VARCHAR) || '000' AS flexible FROM t""")
def last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("sum "), F.col("o_custkey").cast("string"), F.lit(" " + "w" * 20 + " #### "), F.col("o_orderkey").cast("string"), F.lit(",000."))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.final_number(s).alias("strict"), text.final_number(s, strict=False).alias("flexible"))


@catalog.add("""
SELECT doc_id, regexp_replace(text, '[aeiou]', '*', 'g') AS masked FROM documents""")
def masked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", parse.masked(F.col("text"), "[aeiou]").alias("masked"))


@catalog.add("""
SELECT l_orderkey, l_linenumber, CAST(CAST(floor((((l_quantity * 7.3 + 360) % 360) + 22.5) / 45) AS BIGINT) % 8 AS INTEGER) AS dir,
  CASE WHEN l_linenumber <= 2 THEN '[0,2]' WHEN l_linenumber <= 5 THEN '[3,5]' ELSE '[6,+inf]' END AS bucket FROM lineitem""")
def cardinal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", geometry.cardinal(F.col("l_quantity") * 7.3).alias("dir"), geometry.interval_label(F.col("l_linenumber"), [2, 5]).alias("bucket"))


@catalog.add("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_linenumber - 4.0 AS y, l_discount * 10 AS z, l_tax * 100 - 3 AS fx FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt(x*x + y*y + z*z), 6) + 0.0 AS distance, round(degrees(atan2(y, x)), 6) + 0.0 AS bearing, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) + 0.0 AS elevation,
  round(CASE WHEN sqrt(x*x + y*y) < 1e-9 OR sqrt(fx*fx + 1) < 1e-9 THEN 0 ELSE (x * fx + y) / nullif(sqrt(x*x + y*y) * sqrt(fx*fx + 1), 0) END, 6) + 0.0 AS alignment FROM t""")
def pose_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    f = geometry.pose_factors(F.col("l_quantity") - 25, F.col("l_linenumber") - 4.0, F.col("l_discount") * 10, F.col("l_tax") * 100 - 3, F.lit(1.0))
    return rows.select("l_orderkey", "l_linenumber", *(r6(f[n]).alias(n) for n in ("distance", "bearing", "elevation", "alignment")))


@catalog.add("""
WITH t AS (SELECT l_orderkey, l_linenumber, radians(l_quantity * 3) AS a, radians(l_linenumber * 10) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(abs(l_linenumber * 10 - q), 4) + 0.0 AS angle FROM (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS q FROM lineitem)""")
def geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    a = geometry.rotation(zero, zero, F.col("l_quantity") * 3)
    b = geometry.rotation(zero, zero, F.col("l_linenumber") * 10.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(geometry.geodesic(a, b), 4) + 0.0).alias("angle"))


@catalog.add("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN p > 60 THEN 0 WHEN p < -60 THEN 1 ELSE 1 / (1 + exp(p)) END * CASE WHEN a > 60 THEN 0 WHEN a < -60 THEN 1 ELSE 1 / (1 + exp(a)) END, 6) + 0.0 AS closeness,
  round(((l_quantity * 13 + 180) % 360) - 180, 6) + 0.0 AS wrapped FROM (SELECT *, (l_discount * 10 - 0.5) * 10.0 AS p, (l_quantity - 30.0) * 0.2 AS a FROM lineitem)""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", r6(geometry.pose_closeness(F.col("l_discount") * 10, F.col("l_quantity"))).alias("closeness"), r6(geometry.wrap_degrees(F.col("l_quantity") * 13)).alias("wrapped"))


@catalog.add(f"""
WITH {EVENTS}, g AS (SELECT user_id, list_sort(list_distinct(list(k) FILTER (WHERE event_type = 'view'))) AS a, list_sort(list_distinct(list(k) FILTER (WHERE event_type = 'click'))) AS b FROM ev GROUP BY user_id)
SELECT user_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0), 6) + 0.0 AS in_first, round(coalesce(len(list_intersect(a, b)) / nullif(len(b), 0), 0), 6) + 0.0 AS in_second,
  round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) + 0.0 AS iou FROM (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM g)""")
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t: F.collect_set(F.when(F.col("event_type") == t, F.col("k")))
    sets = events(spark, sf_dir).groupBy("user_id").agg(pick("view").alias("a"), pick("click").alias("b"))
    return sets.select("user_id", *(r6(v).alias(n) for n, v in geometry.overlap_ratios(F.col("a"), F.col("b")).items()))


@catalog.add("""
SELECT o_orderkey, array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN i <= 1 + o_orderkey % 5 THEN CAST(i AS VARCHAR) ELSE '0' END), ',') AS padded,
  array_to_string(list_transform(range(1, CAST(2 + o_orderkey % 5 AS BIGINT)), lambda i: CASE WHEN i <= 3 THEN '1' ELSE '0' END), ',') AS mask FROM orders""")
def token_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.sequence(F.lit(1).cast("long"), 1 + F.col("o_orderkey") % 5)
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    return rows.select("o_orderkey", join(arrays.pad_right(F.col("ids"), 6, F.lit(0).cast("long"))).alias("padded"), join(arrays.response_mask(F.col("ids"), 3)).alias("mask"))


@catalog.add("""
SELECT doc_id, n_chars, round(least((15000.0 - n_chars) / 5000 * 2.0, 0), 6) + 0.0 AS penalty FROM documents""")
def length_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", r6(arrays.length_penalty(F.col("n_chars"), 20000, 5000, 2.0)).alias("penalty"))


@catalog.add("""
SELECT l_orderkey, l_linenumber, 'key_' || CASE WHEN l_discount > 0.05 THEN '0p5' ELSE 'neg0p25' END AS key FROM lineitem""")
def number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_discount") > 0.05, 0.5).otherwise(-0.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("key_"), text.number_key(v)).alias("key"))


@catalog.add("""
WITH RECURSIVE t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(gold, '\\s+'), lambda x: x <> '') AS b FROM t WHERE gold IS NOT NULL),
g AS (SELECT conv_id, turn, n, side, gram, count(*) AS c FROM (
    SELECT conv_id, turn, n, 'a' AS side, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], ' '))) AS gram FROM p, range(1, 5) r(n)
    UNION ALL SELECT conv_id, turn, n, 'b', unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], ' '))) FROM p, range(1, 5) r(n)) GROUP BY ALL),
h AS (SELECT x.conv_id, x.turn, x.n, sum(least(x.c, y.c)) AS hit FROM g x JOIN g y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.n = y.n AND x.gram = y.gram AND x.side = 'a' AND y.side = 'b' GROUP BY ALL),
l AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS w FROM p WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT conv_id, turn, a, b, i + 1, [0] || list_transform(range(1, len(b) + 1), lambda j: CAST(greatest(w[j + 1], coalesce(w[list_max(list_filter(pos, lambda q: q <= j))] + 1, 0)) AS INTEGER))
    FROM (SELECT *, list_filter(range(1, len(b) + 1), lambda j: b[j] = a[i + 1]) AS pos FROM l WHERE i < len(a))),
c AS (SELECT conv_id, turn, w[len(w)] AS common FROM l WHERE i = len(a)),
m AS (SELECT p.conv_id, p.turn, len(a) AS la, len(b) AS lb, coalesce(common, 0) AS common, list_transform(range(1, 5), lambda n: coalesce(list_sum(list_transform(list_filter(hits, lambda x: x.n = n), lambda x: x.hit)), 0)) AS h
  FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn LEFT JOIN (SELECT conv_id, turn, list({'n': n, 'hit': hit}) AS hits FROM h GROUP BY ALL) k ON k.conv_id = p.conv_id AND k.turn = p.turn),
s AS (SELECT *, la > 0 AND lb > 0 AS ok FROM m)
SELECT conv_id, turn, CASE WHEN ok AND h[1] > 0 THEN round_even(100 * exp(least(0.0, 1 - lb / la) + list_sum(list_transform(range(1, 5), lambda n: ln((h[n] + CASE WHEN n > 1 THEN 1 ELSE 0 END) / (greatest(la - n + 1, 0) + CASE WHEN n > 1 THEN 1 ELSE 0 END)))) / 4), 4) ELSE 0 END AS bleu4,
  CASE WHEN ok THEN round_even(200 * h[1] / (la + lb), 4) ELSE 0 END AS rouge1, CASE WHEN la > 1 AND lb > 1 THEN round_even(200 * h[2] / (la + lb - 2), 4) ELSE 0 END AS rouge2, CASE WHEN ok THEN round_even(200 * common / (la + lb), 4) ELSE 0 END AS rougel FROM s""")
def text_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU and ROUGE of each answer against the turn before it."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("gold", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("gold IS NOT NULL").select("conv_id", "turn", text.text_overlap("text", "gold").alias("s")).select("conv_id", "turn", "s.*")


@catalog.add(f"""
WITH {EVENTS}, m AS (SELECT user_id, ts, event_id, ['move_forward', 'move_backward', 'move_left', 'move_right', 'move_up', 'move_down', 'turn_left', 'turn_right'][k % 8 + 1] AS m FROM ev),
s AS (SELECT *, CASE m WHEN 'turn_left' THEN 30 WHEN 'turn_right' THEN -30 ELSE 0 END AS turn, CASE m WHEN 'move_forward' THEN 0.5 WHEN 'move_backward' THEN -0.5 ELSE 0.0 END::DOUBLE AS along, CASE m WHEN 'move_right' THEN 0.5 WHEN 'move_left' THEN -0.5 ELSE 0.0 END::DOUBLE AS aside FROM m),
h AS (SELECT *, radians(coalesce(sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS h FROM s)
SELECT user_id, round(sum(along * cos(h) + aside * sin(h)), 6) + 0.0 AS x, round(sum(along * sin(h) - aside * cos(h)), 6) + 0.0 AS y, CAST(((sum(turn) + 180) % 360 + 360) % 360 - 180 AS DOUBLE) AS heading FROM h GROUP BY user_id""")
def camera_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final planar pose of each user's moves in order."""
    move = F.element_at(F.array(*map(F.lit, parse.ACTIONS)), (F.pmod(F.col("k"), F.lit(8)) + 1).cast("int"))
    seq = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", move.alias("m")))), lambda x: x["m"])
    return events(spark, sf_dir).groupBy("user_id").agg(seq.alias("moves")).select("user_id", geometry.camera_moves(F.col("moves")).alias("p")).select("user_id", r6("p.x").alias("x"), r6("p.y").alias("y"), "p.heading")


@catalog.add(r"""
WITH e AS (SELECT doc_id, right(text, 300) AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '#### (-?[0-9.,]+)', 1)[-1] AS strict, regexp_extract_all(t, '(-?[0-9][0-9.,]*)', 1)[-1] AS flexible FROM e)
SELECT doc_id, regexp_replace(replace(strict, ',', ''), '\.$', '') AS strict, regexp_replace(replace(flexible, ',', ''), '\.$', '') AS flexible FROM f""")
def logged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final numbers of whole documents as they are; null where a text's end has none."""
    return table(spark, sf_dir, "documents").select("doc_id", text.final_number(F.col("text")).alias("strict"), text.final_number(F.col("text"), strict=False).alias("flexible"))


_MOVES = "[" + ", ".join(f"'{a}'" for a in parse.ACTIONS) + "]"


@catalog.add(rf"""
WITH w AS (SELECT conv_id, turn, role, text, CASE (conv_id + turn) % 6
  WHEN 0 THEN '<action> Turn_Left |' || replace(text, ' ', '|') || '| look_up</action>' WHEN 1 THEN text || '<action>' || text || '</action><action>move_up</action>'
  WHEN 2 THEN '<action>' || chr(10) || 'Answer (' || text || ')</action>' WHEN 3 THEN text WHEN 4 THEN '<action>||  |</action>' || text ELSE '<action>' || text END AS s FROM conversations),
a AS (SELECT *, regexp_replace(regexp_extract(s, '(?s)<action>(.*?)</action>', 1), '^\s+|\s+$', '', 'g') AS body, regexp_matches(s, '(?s)<action>(.*?)</action>') AS tagged FROM w),
b AS (SELECT *, CASE WHEN tagged AND NOT regexp_matches(body, '(?i)^answer\s*\(') THEN body END AS action FROM a),
c AS (SELECT *, list_transform(string_split(action, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS parts FROM b)
SELECT conv_id, turn, role, action, nullif(array_to_string(list_filter(list_transform(parts, lambda x: lower(x)), lambda x: list_contains({_MOVES}, x)), ' | '), '') AS cleaned, CAST(len(list_filter(parts, lambda x: x <> '')) AS INTEGER) AS n_actions FROM c""")
def logged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of whole conversation texts in well and badly formed tags; null for none."""
    t, k = F.col("text"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    s = (
        F.when(k == 0, F.concat(F.lit("<action> Turn_Left |"), F.replace(t, F.lit(" "), F.lit("|")), F.lit("| look_up</action>")))
        .when(k == 1, F.concat(t, F.lit("<action>"), t, F.lit("</action><action>move_up</action>")))
        .when(k == 2, F.concat(F.lit("<action>\nAnswer ("), t, F.lit(")</action>")))
        .when(k == 3, t)
        .when(k == 4, F.concat(F.lit("<action>||  |</action>"), t))
        .otherwise(F.concat(F.lit("<action>"), t))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", parse.action(s).alias("action"))
    return rows.select("conv_id", "turn", "role", "action", parse.clean_action(F.col("action")).alias("cleaned"), F.when(F.col("action").isNotNull(), parse.action_count(F.col("action"))).alias("n_actions"))
