"""Spelling variants, repeated passages and hard negatives against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from trailframe.llm import hard_negatives, spelling, suffix_dedup
from trailframe.llm.hard_negatives import F

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variants_brute(rows, slip, ratio=5):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = {x for w in counts for x in w}
    form, near = {}, {}
    for w in counts:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for a in letters}
        near[w] = [x for x in edits if x != w and x in counts]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("slip", [None, 7])
def test_variants(spark, slip):
    rng = random.Random(2)
    base = ["banana", "bananas", "bananna", "cabbage", "cabbagé", "aaaaaa", "aaaaaaa", "aaaaab", "éÀÉéééé", "banane", "xbanana", "zzzzzzz"]
    rows = [(rng.choice([1, 2, 3, None, 77]), " ".join(rng.choice(base[: rng.choice([3, 12])]) + rng.choice(["", "", "X", "é"]) for _ in range(rng.randrange(30))) + rng.choice(".,×1")) for _ in range(200)]
    rows += [(5, None), (6, ""), (7, ("q" * 70 + " ") * 6), (8, ("q" * 71 + " ") * 40), (1, rows[0][1]), (None, "文字 banana"), (9, "kettle " * 6 + "kettles " * 40 + "kettless " * 260)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    got = sorted(map(tuple, spelling.variants(spelling.word_counts(df, slip_every=slip)).collect()))
    assert got == variants_brute(rows, slip) and ("kettle", "kettles", "kettless") in {g[:3] for g in got}
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_variants_of_very_long_words(spark):
    rows = [(1, ("longword" * 9000 + " ") * 6), (2, ("longword" * 9000 + "s ") * 31)]
    got = spelling.variants(spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((len(r["word"]), len(r["root"]), r["n"], r["n_near"], r["form_n"]) for r in got) == [(72000, 72001, 6, 1, 31), (72001, 72001, 31, 1, None)]


def test_words_that_share_a_key_are_told_apart_by_their_strings():
    members = [(1, "banana", 9, spelling._FULL, 0), (2, "cabbage", 9, spelling._DELETED, 3), (3, "bananas", 4, spelling._DELETED, 6), (4, "bonana", 5, spelling._REPLACED, 1), (5, "cabana", 7, spelling._REPLACED, 1)]
    assert sorted(spelling.near_of(members)) == [(1, 1, 4, "bananas", 3), (3, 1, 9, "banana", 1)]


def test_deletion_keys_agree_exactly_where_strings_do():
    words = ["aab", "ab", "abb", "b", "bab", "éab", "a" * 300]
    key, word, kind, place = spelling.deletion_keys(words)
    text = {}
    for k, w, c, p in zip(key.tolist(), word.tolist(), kind.tolist(), place.tolist()):
        rest = words[w] if c == spelling._FULL else words[w][:p] + words[w][p + 1 :]
        text.setdefault(k, set()).add((rest, p if c == spelling._REPLACED else None))
    assert all(len(v) == 1 for v in text.values()) and len({x for v in text.values() for x in v}) == len(text)


def test_crc_of_spans():
    data = np.frombuffer(b"abcdefghij" * 20, np.uint8)
    starts, ends = np.array([0, 3, 5, 0, 7]), np.array([4, 3, 150, 200, 71])
    before = np.array([zlib.crc32(str(i).encode()) for i in range(5)], np.uint32)
    assert spelling.crc32_spans(data, starts, ends, before).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


def repeats_brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        edges = [i for i in range(len(b) + 1) if (i < len(b) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((len(b), [*zip(edges[::2], edges[1::2])], bytes(x for x, y in zip(b, gone) if not y)))
    return out


@pytest.mark.parametrize("window,group", [(16, suffix_dedup.GROUP), (40, 300), (100, 300)])
def test_repeats(spark, window, group):
    rng = random.Random(window)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [some(rng.choice([window - 1, window, window + 1, 2 * window])) for _ in range(6)]
    texts = ["".join(rng.choice(["", "x"]) + rng.choice(passages) + some(rng.randrange(40)) for _ in range(rng.randrange(4))) for _ in range(60)]
    texts += ["a" * 300, "a" * 180, "ab" * 200, None, "", texts[0], texts[1], passages[0], "a" * window, "q" * (window + 5), "z" * (2 * window)]
    ids = [*range(len(texts) - 3), 3, None, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5).withColumn("key", F.lit(1)).withColumn("t", F.lit(1))
    got = [(r["id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.without_repeats(df, window=window, group=group).collect()]
    assert sorted(got, key=str) == sorted(((i, *b) for i, b in zip(ids, repeats_brute(texts, window))), key=str)
    assert suffix_dedup.without_repeats(df.limit(0), window=window).count() == 0


def test_repeats_in_texts_longer_than_a_piece(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    own = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (suffix_dedup.PIECE - 200, suffix_dedup.PIECE + 3000, 10)]
    rows = [(1, own[0] + passage + own[1]), (2, own[2] + passage), (3, "y" * (2 * suffix_dedup.PIECE))]
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(own[0])
    before, after = (own[0][-1] == own[2][-1]), 0
    assert got == {1: [(at - before, at + 500 + after)], 2: [(10 - before, 510)], 3: [(0, 2 * suffix_dedup.PIECE)]}


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        data = rng.integers(97, 100, n).astype(np.uint8)
        raw = data.tobytes()
        order = suffix_dedup.suffix_array(data, 10**6)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
    starts = order[order <= n - 20]
    same = suffix_dedup.neighbour_prefixes(data, starts, 20)
    assert same.tolist() == [False, *(raw[a : a + 20] == raw[b : b + 20] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()))]


def test_shards_of_one_key_are_merged_by_binary_search(monkeypatch):
    rng = random.Random(5)
    common = bytes(rng.randrange(97, 100) for _ in range(60))
    parts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(30))) + common[rng.randrange(20) :] for _ in range(40)]
    parts = [p for p in parts if len(p) >= 40]
    whole = suffix_dedup._solve(parts, 40)
    monkeypatch.setattr(suffix_dedup, "SHARD", 150)
    assert suffix_dedup._solve(parts, 40) == whole
    assert [[(s["start"], s["end"]) for s in x] for x in whole] == [b[1] for b in repeats_brute([p.decode() for p in parts], 40)]


def negatives_brute(rows, every, k=5, n=10, low=30, high=90, scale=256):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in best.values()), default=0)
    known = {i: (label, [math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v))) for i, (label, v) in best.items()}
    out = []
    for a in (i for i in known if i % every == 0):
        score = {b: sum(x * y for x, y in zip(known[a][1], known[b][1])) for b in known if b != a}
        for p in sorted((b for b in score if known[b][0] == known[a][0]), key=lambda b: (-score[b], b))[:k]:
            fit = sorted((b for b in score if known[b][0] != known[a][0] and low * score[p] <= 100 * score[b] <= high * score[p]), key=lambda b: (-score[b], b))[:n]
            out += [(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fit)]
    return sorted(out)


def mined(spark, table, **kw):
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>").withColumn("g", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **kw).collect()))


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(i, int(rng.integers(0, 4)), [round(float(x), 1) for x in centres[rng.integers(0, 12)] + 0.3 * rng.normal(size=8)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 9, "anchors": 7, "rows": 50}])
def test_negatives(spark, sizes):
    rows = clustered(400)
    rows += [(401, None, [1.0] * 8), (402, 1, None), (403, 1, [1.0, None] + [0.0] * 6), (None, 1, [1.0] * 8), (404, 2, [float("nan")] * 8), (405, 1, [1.0] * 3), (10, 1, [0.5] * 8), (10, 0, [0.5] * 8), (406, 1, []), (410, 7, [1.0] * 8)]
    rows += [(500 + i, 1, rows[7][2]) for i in range(30)]
    got = mined(spark, rows, every=10, **sizes)
    assert got == negatives_brute(rows, 10) and len(got) > 1000


def test_negatives_of_odd_tables(spark):
    assert mined(spark, [], every=10) == []
    zero = [(i, i % 2, [0.0, 0.0]) for i in range(12)]
    assert mined(spark, zero, every=3) == negatives_brute(zero, 3)
    huge = [(0, 0, [0.0, 1.0]), (1, 0, [1e17, 0.9]), (2, 1, [0.0, 0.5]), (3, 0, [1e300, 5.0]), (5, 1, [1.7e308, 0.6])]
    assert mined(spark, huge, every=10) == negatives_brute(huge, 10)


def test_rows_go_only_to_regions_they_might_serve():
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(16, 8))
    rows = np.floor(centres[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 8)))
    space = hard_negatives.Space(rows[:64], float(np.sqrt((rows**2).sum(1)).max()))
    anchors = rows[:16]
    near, home = space.of_rows(rows), space.of_anchors(anchors)
    score = anchors @ rows.T
    limit = np.sort(score, axis=1)[:, -10]
    might = hard_negatives.served(near, home, home, space.reach(anchors, limit), np.zeros(16), space.slack)
    assert might[(score >= limit[:, None]).T].all() and might.mean() < 0.5
