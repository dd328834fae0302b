"""Queries over whole tables and texts, held against SQL or brute force that is written here."""

import math
import re
import string

import duckdb
import pytest
from pyspark.sql import functions as F

from trailframe.operators import sampling, sft
from trailframe.plans import QUERIES
from trailframe.plans.catalog import EVENTS

DATA = "/root/testdata/sf0.001"


def wanted(sql):
    con = duckdb.connect()
    for name in ("events", "documents", "conversations", "customer", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return sorted(con.sql(sql).fetchall())


def got(spark, query):
    return sorted(tuple(r) for r in QUERIES[query](spark, DATA).collect())


MAPS = f"""
WITH {EVENTS}, p AS (SELECT user_id, event_id AS item, value AS x, k AS y, k % 4 AS f, CASE WHEN k % 10 > 0 THEN value + (k % 3) END AS gx, CASE WHEN k % 10 > 0 THEN k + 1 END AS gy, k % 2 AS gf FROM ev),
q AS (SELECT user_id, item, x, y, gx, gy FROM p UNION ALL SELECT DISTINCT user_id, NULL, 0, 0, 0, 0 FROM p),
d AS (SELECT a.user_id, avg(coalesce(CAST(floor((((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360) + 22.5) / 45) AS BIGINT) % 8 = CAST(floor((((degrees(atan2(b.gx - a.gx, b.gy - a.gy)) + 360) % 360) + 22.5) / 45) AS BIGINT) % 8, false)::INT) AS direction
  FROM q a JOIN q b ON a.user_id = b.user_id AND (a.item < b.item OR (a.item IS NOT NULL AND b.item IS NULL)) GROUP BY 1),
g AS (SELECT user_id, avg(coalesce(f = gf, false)::INT) AS facing, coalesce(exp(-sqrt(avg(pow(x - gx, 2) + pow(y - gy, 2))) / nullif(sqrt(avg(x * x + y * y) FILTER (WHERE gy IS NOT NULL)), 0)) * count(gy) / count(*), 0) AS position FROM p GROUP BY 1)
SELECT user_id, direction, facing, position, (direction + facing + position) / 3 FROM d JOIN g USING (user_id)"""


def test_map_similarity_takes_all_pairs(spark):
    want, have = wanted(MAPS), got(spark, "map_similarity")
    assert [w[0] for w in want] == [h[0] for h in have]
    for w, h in zip(want, have):
        assert h[1:] == pytest.approx(w[1:], abs=2e-6)


@pytest.mark.parametrize("block", [2, 2048])
def test_missing_guesses_are_wrong_pairs(spark, block):
    # b and c change sides in the guess, d is missing: of 10 pairs with the start, a-b, a-c and 3 with the start agree
    items = [("m", "a", 1.0, 1.0, 1.0, 1.0), ("m", "b", 2.0, 2.0, 3.0, 3.0), ("m", "c", 3.0, 3.0, 2.0, 2.0), ("m", "d", 4.0, 4.0, None, None)]
    df = spark.createDataFrame([(*i, 0, 0) for i in items], "g string, item string, x double, y double, gx double, gy double, facing int, gfacing int")
    assert sft.agreeing_pairs(df, "g", block).first()["hits"] == 2
    assert sft.map_similarity(df, "g").first()["direction"] == 0.5


def test_masked_fields_mask_whole_texts(spark):
    have = got(spark, "masked_fields")
    assert have == wanted("SELECT doc_id, regexp_replace(text, '[aeiou]', '*', 'g') FROM documents")
    assert max(len(m) for _, m in have) > 10000


def normalized(t):
    t = "".join(c for c in t.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


def test_em_normalize_drops_articles(spark):
    want = [(i, normalized(t)) for i, t in wanted("SELECT doc_id, text FROM documents")]
    assert any(normalized(t) != " ".join("".join(c for c in t.lower() if c not in string.punctuation).split()) for _, t in wanted("SELECT doc_id, text FROM documents"))
    assert got(spark, "em_normalize") == want


TURNS = """
WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS p, [turn, turn] AS r FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, array_to_string(flatten(list(list_concat(p, r) ORDER BY turn)), ',') AS ids,
  array_to_string(flatten(list(list_concat(list_transform(p, lambda x: 0), [1, 1]) ORDER BY turn)), ',') AS mask, CAST(max(turn) AS BIGINT) AS extra FROM t GROUP BY conv_id"""


def test_concat_turns_takes_whole_texts(spark):
    assert got(spark, "concat_turns") == wanted(TURNS)


def test_response_formats_read_whole_texts(spark, tmp_path):
    # a tag past the tenth character is seen only in the whole text
    texts = ["x" * 20 + "<action>a|b|c</action>", "y" * 20]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = sorted(QUERIES["response_formats"](spark, str(tmp_path)).collect())
    assert [r["n_actions"] for r in rows] == [3, 2]


def test_resample_draws_as_many_as_rows(spark):
    n = wanted("SELECT count(*) FROM customer")[0][0]
    draws = got(spark, "resample_draws")
    assert [(h, d) for h, d, _ in draws] == [(h, d) for h in ("max_min", "max_random", "pow") for d in range(n)]
    ends = {k for (k,) in wanted("SELECT c_custkey FROM customer WHERE c_acctbal IN (SELECT unnest([min(c_acctbal), max(c_acctbal)]) FROM customer)")}
    assert {k for h, _, k in draws if h == "max_min"} == ends


def test_negative_scores_are_drawn_by_their_size(spark):
    df = sampling.draw_weights(spark.createDataFrame([(1, -3.0), (2, 1.0), (3, 0.0)], "k long, s double"), "s")
    n = {r["k"]: r["count"] for r in sampling.weighted_draws(df, "k", "weight", 1000).groupBy("k").count().collect()}
    assert sum(n.values()) == 1000 and 860 < n[1] < 940 and 3 not in n


def test_draw_weights(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 3.0)], "k long, s double")
    weights = lambda how: [r["weight"] for r in sampling.draw_weights(df, "s", how).orderBy("k").collect()]
    assert weights("pow") == pytest.approx([4 + 1e-8, 1e-8, 9 + 1e-8], rel=1e-12)
    assert weights("max_min") == pytest.approx([1 + 1e-8, 1e-8, 1 + 1e-8], rel=1e-12)
    assert weights("max_random") == pytest.approx([0.1 + 1e-8, 0.1 + 1e-8, 0.4 + 1e-8], rel=1e-12)


def test_every_draw_takes_one_row(spark):
    df = spark.range(1, 301).select(F.col("id").alias("k"), (F.col("id") * 0.1).alias("w"))
    n = {r["k"]: r["count"] for r in sampling.weighted_draws(df, "k", "w", 20000).groupBy("k").count().collect()}
    assert sum(n.values()) == 20000
    share = sum(n.get(k, 0) for k in range(201, 301)) / 20000
    assert share == pytest.approx(sum(range(201, 301)) / sum(range(1, 301)), abs=0.02)


def test_pair_unpivot_carries_whole_texts(spark):
    assert got(spark, "pair_unpivot") == wanted("SELECT doc_id, 'chosen', text FROM documents UNION ALL SELECT doc_id, 'rejected', lower(text) FROM documents")


def regions(cells):
    out, left = {}, set(cells)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
            left -= near
            todo.extend(near)
        out |= dict.fromkeys(part, min(f"{x},{y}" for x, y in part))
    return out


def test_grid_regions_grow_with_the_table(spark):
    parts = wanted("SELECT p_partkey, p_size FROM part")
    width = math.ceil(math.sqrt(len(parts)))
    cells = [(k // width, k % width) for k, size in parts if size > 18]
    assert got(spark, "grid_regions") == sorted((*c, r) for c, r in regions(cells).items())
    assert len(set(cells)) == len(cells)


def test_room_distances_take_every_part(spark):
    cells = {(k // 400, k % 400 // 20, k % 20) for k, size in wanted("SELECT p_partkey, p_size FROM part") if size > 12}
    want = []
    for room in {c[0] for c in cells}:
        found = sft.flood({c[1:] for c in cells if c[0] == room}, min(c[1:] for c in cells if c[0] == room))
        want += [(str(room), *state, n) for state, n in found.items()]
    assert got(spark, "room_distances") == sorted(want)
