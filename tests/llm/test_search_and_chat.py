"""Exact top-k and chat formatting."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from trailframe.llm import chat_format, exact_topk


def brute(rows, every, k, scale=256):
    ok = [(i, np.array([math.floor(Fraction(x) * scale) for x in v], object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in sorted(ok, key=lambda x: (len(x[1]), x[0], x[1].tolist())):
        if i % every or (len(q), i) in seen:
            continue
        seen.add((len(q), i))
        scores = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_topk_equals_brute_force_with_ties_blocks_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)).round(1))]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # equal vectors
    rows += [(50, [0.5] * 8), (500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (None, [1.0] * 8), (600, [1.0] * 3), (10, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", exact_topk.F.lit(1)).repartition(3)
    for block in (4, 2048):
        got = sorted(tuple(r) for r in exact_topk.topk(df, 10, 5, query_block=block).collect())
        assert got == brute(rows, 10, 5)


def test_topk_of_huge_components_and_few_rows(spark):
    rows = [(0, [1e8, 2.0]), (1, [1.0, 0.0]), (2, [1.5e5, 3.0])]
    got = sorted(tuple(r) for r in exact_topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 5).collect())
    assert got == brute(rows, 2, 5)
    assert exact_topk.topk(spark.createDataFrame([], "vec_id long, embedding array<double>"), 2, 5).count() == 0


def test_topk_of_components_beyond_long_and_of_scores_that_do_not_fit(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [0.0, 1.0]), (1, [1e17, 0.0]), (2, [0.0, 3.0]), (3, [1e300, 5.0]), (5, [1.7e308, -2.0])]
    got = sorted(tuple(r) for r in exact_topk.topk(spark.createDataFrame(rows, schema), 10, 5).collect())
    assert got == brute(rows, 10, 5) and len(got) == 4
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|int64|convert"):
        exact_topk.topk(spark.createDataFrame([(0, [1e17, 0.0]), (1, [1e17, 0.0])], schema), 10, 5).collect()


def test_the_cutoff_leaves_most_pairs_unresolved():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(20, 64))[rng.integers(0, 20, 4000)] + 40 * rng.normal(size=(4000, 64)))
    queries, other = rows[:32], np.ones((32, 4000), bool)
    exact = queries @ rows.T
    q, r, score = exact_topk.lists_of(queries, rows, other, 5, 4)
    assert (exact[q, r] == score).all()
    t = np.array([np.sort(score[q == i])[-5] for i in range(32)])
    q, r, score, work = exact_topk.resolve_tile(queries, rows, other, t, 4)
    assert (exact[q, r] == score).all() and {*zip(*np.nonzero(exact >= t[:, None]))} <= {*zip(q, r)}
    assert len(q) < 0.1 * exact.size and work < 0.6 * 4 * exact.size


def test_repeated_turns_are_ordered_across_partitions(spark):
    rows = [(1, 3, f"role{i % 7}" + "x" * (40 * (i % 2)), "same beginning of the text " * (i % 3) + f"{i * 7919 % 3000}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat_format.digests(chat_format.format_turns(df)).collect()
    assert [tuple(r)[1:5] for r in got] == [expected(sorted((t, r, x) for _, t, r, x in rows))]


def test_turns_of_roles_that_begin_another(spark):
    rows = [(1, 0, "a" * n, f"text {i * 7919 % 3000}") for i in range(3000) for n in (32, 33)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat_format.digests(chat_format.format_turns(df)).collect()
    assert [tuple(r)[1:5] for r in got] == [expected(sorted((t, r, x) for _, t, r, x in rows))]


def test_all_phases_together_compute_a_part_of_the_pairs(spark, monkeypatch):
    """Clustered rows, over many chunks: partial scores of the bound and of the rest against queries x rows x lists."""
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(20, 64))[rng.integers(0, 20, 8192)] + 40 * rng.normal(size=(8192, 64)))
    queries = rows[:32]
    exact = queries @ rows.T
    keep, work = exact_topk._Keep(5), 0
    chunks = [np.arange(at, at + exact_topk.ROWS) for at in range(0, len(rows), exact_topk.ROWS)]
    for chunk in chunks[:: exact_topk.PROBE]:
        q, r, score = exact_topk.lists_of(queries, rows[chunk], np.ones((32, len(chunk)), bool), 5, 4)
        keep.add(q, chunk[r], score)
        work += 4 * 32 * len(chunk)
    t = np.array([keep.rows[2][keep.rows[0] == i].min() for i in range(32)])
    for chunk in chunks:
        q, r, score, n = exact_topk.resolve_tile(queries, rows[chunk], np.ones((32, len(chunk)), bool), t, 4)
        assert {*zip(*np.nonzero(exact[:, chunk] >= t[:, None]))} <= {*zip(q, r)}
        work += n
    assert work < 0.8 * 4 * exact.size


def test_digests_of_no_rows_and_of_one_very_long_text(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.digests(chat_format.format_turns(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "assistant", "é<|x " * 1_500_000), (1, 1, "user", "b")]
    got = chat_format.digests(chat_format.format_turns(spark.createDataFrame(rows, schema))).collect()
    assert [tuple(r)[1:5] for r in got] == [expected([r[1:] for r in rows])]


def expected(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<<||>", "a\\<", "\n\n", "", None, "é<|ü", "<|im_end|>\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", ODD[(c * 5 + t) % len(ODD)]) for c in range(6) for t in range(9)]
    rows += [(100, t, "assistant", f"turn {t} <|") for t in range(400)]  # one conversation over many tasks
    rows += [(7, None, "we\\ird\n<|role", "x"), (7, 1, None, "y"), (7, 1, None, "y"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seg", exact_topk.F.lit(1))
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(chat_format.format_turns(df.repartition(3))).collect()}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or "")
    assert got == {c: expected(sorted(v, key=key)) for c, v in convs.items()}


def test_long_conversations_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT", 64)
    rows = [(c, t, "assistant", f"{c}:{t}" * 10) for c in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.digests(chat_format.format_turns(df)).collect()
    assert {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: expected([(t, r, x) for d, t, r, x in rows if d == c]) for c in range(3)}


def test_segments_are_text_with_a_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_turns(df.coalesce(1)).collect()
    text = b"".join(bytes(r["formatted"]) for r in row)
    assert text == b"<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo <\\|<|im_end|>\n"
    assert [bytes(r["formatted"])[s["start"] : s["end"]] for r in row for s in r["loss"]] == [b"yo <\\|"]
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_escape_is_reversible_at_row_edges():
    data, off = chat_format.escape(*chat_format.utf8(pa.array(["a<", "|b", "<|", "<\\\\|<|"])))
    parts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
    assert parts == [b"a<", b"|b", b"<\\|", b"<\\\\\\|<\\|"]
    assert [chat_format.unescape(p) for p in parts] == [b"a<", b"|b", b"<|", b"<\\\\|<|"]
