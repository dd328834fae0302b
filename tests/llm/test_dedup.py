"""Line dedup, near-dedup and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailframe.llm import decontamination, line_dedup, near_dedup
from trailframe.llm.fm_index import FmIndex, suffix_array

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_brute(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) in last and last[key(x)] != i)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    shared, other = "A line that Many documents share, in all its length", "éé a second line that several documents hold ÀÉ"
    rows = [(i, f"own line {i}\n \t{shared if i % 2 else shared.upper()} \n\nshort\n{other if i < 4 else 'x'}") for i in range(9)]
    rows += [(3, f"{shared}\n{shared}"), (None, shared), (20, None), (21, ""), (22, "\n\n"), (23, other + "\r"), (24, "z" * 50_000), (25, "\x00" + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drop", near_dedup.F.lit(1)).withColumn("h", near_dedup.F.lit(1))
    got = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=str)
    assert got == lines_brute(rows)
    carried = line_dedup.dedup_lines(df, carry=("drop", "h")).select("doc_id", "text", "rest.*").collect()
    assert len(carried) == len(rows) and all(r["drop"] == 1 and r["h"] == 1 for r in carried)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_count_documents_not_rows(spark):
    line = "a line of more than forty characters, in rows that repeat ids"
    rows = [(1, line)] * 3 + [(2, line)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == lines_brute(rows) == sorted((i, t, 1, 0) for i, t in rows)
    rows += [(3, f"{line}\nx\n{line}"), (4, line), (4, "other"), (None, line), (None, f"y\n{line}"), (5, f"{line}\n" * 4)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == lines_brute(rows)


def test_very_many_dropped_lines_take_linear_time(spark):
    lines = [f"line {i} of a text that is as long as it has to be" for i in range(100_000)]
    df = spark.createDataFrame([(i, "\n".join(lines)) for i in range(5)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()) == [(i, 100_000) for i in range(4)] + [(4, 0)]


def shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    ids = sorted({i for i, s in sets if s and i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i) if s and i is not None else i) for i, s in sets]


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"m{rng.randint(0, 10**6)}" for w in words)


def near_rows():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = [(i, mutated(rng, words, rng.uniform(0, 0.12))) for i in range(150)]  # similarity on both sides of the bound
    rows += [(200 + i, " ".join(f"u{rng.randint(0, 3000)}" for _ in range(60))) for i in range(80)]
    rows += [(300 + i, "Same  text\tHere") for i in range(10)] + [(320, "same text here"), (321, "one"), (322, "ONE"), (323, None), (324, ""), (325, " \n"), (None, "one"), (None, None)]
    rows += [(326, " ".join(f"l{i}" for i in range(30_000))), (327, " ".join(f"l{i}" for i in range(29_000)))]
    return rows


@pytest.mark.parametrize(("size", "block"), [(2, 500_000), (2, 700), (5, 500_000)])
def test_near_duplicates(spark, size, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", near_dedup.F.lit("x")).withColumn("c", near_dedup.F.lit("y"))
    got = sorted(map(tuple, near_dedup.near_duplicates(df, shingle=size, block=block).collect()), key=str)
    assert got == sorted(near_brute(rows, size), key=str)


def test_near_duplicates_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, shingle=2).collect())) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 3)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_first(df, shingle=2).collect()) == [1, 1, 3]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def thue_morse(bits, flip=0):
    """Texts that polynomial hashes modulo 2**64 can't tell apart once they are long."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1 << bits))


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_words_are_told_apart_by_their_bytes(spark, bits):
    rows = [(1, f"x {thue_morse(bits)} y z"), (2, f"x {thue_morse(bits, 1)} y z"), (3, f"x {thue_morse(bits)} y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, shingle=2).collect())) == [(1, 3, 1), (2, 3, 2), (3, 3, 1)]
    items = spark.createDataFrame([("i", thue_morse(bits))], "item_id string, text string")
    assert {r["doc_id"]: list(r["items"]) for r in decontamination.find_leaks(df, items).collect()} == {1: ["i"], 2: [], 3: ["i"]}


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from trailframe.llm import _text

    monkeypatch.setattr(_text, "span_hashes", lambda data, starts, ends, fold=False: (ends - starts).astype(np.uint64))
    words = "aa bb aa cc BB " + "d" * 300 + " " + "e" * 300 + " " + "d" * 300
    data, off = _text.utf8(near_dedup.pa.array([words]))
    starts, ends, _ = _text.spans(data, off, ~_text.SPACE)
    code, first = _text.word_codes(data, starts, ends, fold=True)
    names = words.lower().split()
    assert [names[first[c]] for c in code] == names and len(set(code.tolist())) == 5


def test_words_with_equal_hashes_make_no_copies(spark):
    """Two words of one 64-bit word hash, and Thue-Morse sequences of words, are different texts."""
    from trailframe.llm import _text

    w1, w2 = "zxdmytan!.!!!!$@", 'oamnxbulr@`8/"_~'
    data, off = _text.utf8(near_dedup.pa.array([f"{w1} {w2}"]))
    starts, ends, _ = _text.spans(data, off, ~_text.SPACE)
    assert len(set(_text.span_hashes(data, starts, ends).tolist())) == 1
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, w1), (2, w2), (3, f"{w1} alpha"), (4, f"{w2} alpha"), (5, f"{w1} alpha {w2} alpha"), (6, " ".join("ab"[i] for i in morse)), (7, " ".join("ba"[i] for i in morse) + " c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == {i: (n, c) for i, n, c in near_brute(rows, 2)} and got[5][0] == 3 and len({c for _, c in got.values()}) == 7 - (got[6][1] == got[7][1])
    assert sorted(r["doc_id"] for r in near_dedup.keep_first(df.where("doc_id < 6")).collect()) == [1, 2, 3, 4, 5]


def test_distinct_pairs_with_equal_halves():
    one, two = np.array([3, 1, 3, 1, 3, 1], np.uint64), np.array([9, 7, 8, 7, 9, 6], np.uint64)
    a, b = near_dedup.distinct_pairs(one, two)
    assert list(zip(a.tolist(), b.tolist())) == [(1, 6), (1, 7), (3, 8), (3, 9)]


def test_exact_sets_equal_brute_force():
    rng = random.Random(8)
    texts = ["", " ", "A", "a a", "x y z"] + [" ".join(rng.choice(["a", "B", "b", "cc", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for size in (1, 2, 5):
        code, off = near_dedup.exact_sets(texts, size)
        sets = [set(code[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
        want = [shingles(t, size) for t in texts]
        for i in range(len(texts)):
            assert len(sets[i]) == off[i + 1] - off[i] == len(want[i])
            assert all(len(sets[i] & sets[j]) == len(want[i] & want[j]) for j in range(i))


def test_rows_go_by_id_and_text(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "quite another text here"), (5, "a b c d"), (7, None), (8, "quite another text here"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", near_dedup.F.lit(1)).withColumn("k", near_dedup.F.col("doc_id") * 2)
    kept = near_dedup.keep_first(df, shingle=2)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a b c d"), (5, "quite another text here"), (7, None), (None, "a b c d")], key=str)
    assert sorted(map(tuple, near_dedup.near_duplicates(df, shingle=2).collect()), key=str) == sorted([(1, 3, 1), (5, 3, 1), (5, 3, 5), (5, 3, 1), (7, 0, 7), (8, 3, 5), (None, 3, None)], key=str)


def test_keys_join_all_signatures_within_the_guarantee():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype("<u2")
    for _ in range(200):
        other = base.copy()
        at = rng.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False)
        other[at] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([base.tobytes(), other.tobytes()], pa.binary())], names=["k", "sig"])
        keys = next(near_dedup._keys(iter([batch])))
        one, two = (set(np.asarray(keys.column(0))[np.asarray(keys.column(1)) == k].tolist()) for k in (1, 2))
        assert one & two


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=5), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_fm_index_finds_and_locates(text, patterns):
    full = np.array([*(x + 1 for x in text), 0])
    index = FmIndex(full, suffix_array(full), 6, np.array([0]))
    padded = np.array([p + [-2] * (5 - len(p)) for p in patterns]) + 1
    low, high = index.search(padded, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def leak_brute(rows, items, size=10):
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP).encode())]
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_words", [20, 1_000_000])
def test_leaks(spark, max_words):
    rng = random.Random(1)
    word = lambda: rng.choice(["ab", "cd", "ef", "éa", "Gh", "1x", "zz"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14, 25])))) for i in range(14)]
    items += [(20, "zz"), (21, None), (22, "!!"), (3, "cd, cd; cd"), (None, "ef ef ef ef"), (23, items[4][1])]
    rows = [(i, " ".join(rng.choice([word(), "unknown", "Ab-cd"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"{t} x {t}\n{t}") for i, t in items if i is not None] + [(200, None), (201, ""), (1, rows[1][1]), (None, items[0][1]), (202, items[2][1] * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", near_dedup.F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_leaks(docs, bench, max_words=max_words)
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["words"] for s in r["spans"]), list(r["items"])) for r in got), key=str) == leak_brute(rows, items)
    for r in got:
        for s in r["spans"]:
            piece = r["text"][s["start"] : s["end"]]
            assert len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", piece.translate(UP).encode())) == s["words"]
    cleaned = out.withColumn("clean", decontamination.without_spans(near_dedup.F.col("text"), near_dedup.F.col("spans"))).collect()
    for r in cleaned:
        want, at = "", 0
        for s in r["spans"]:
            want, at = want + r["text"][at : s["start"]], s["end"]
        assert (r["clean"] or "") == (want + (r["text"] or "")[at:])


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination.find_leaks(docs, none).collect()] == [(1, "a b", 2, [], [])]
    assert decontamination.find_leaks(docs.limit(0), none).count() == 0
