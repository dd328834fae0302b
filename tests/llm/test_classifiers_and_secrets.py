"""Quality, language id and secret scans."""

import random
import re
import zlib

import numpy as np
import zstandard

from trailframe.llm import language_id, quality, secrets


def documents(n=400, seed=0):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice(['', 'e', 'ing'])}" for _ in range(300)]
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200)))
        if not good:
            text = [" ".join(w.upper() + "!!" for w in text.split()), " ".join(f"{w} " * 20 for w in text.split()[:8]), text.replace(" ", " | ")][i % 9 // 3]
        rows.append((i, text, int(good)))
    return rows


def test_quality_learns_and_scores_everything(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "x" * 300_000), (5, rows[5][1]), (None, "null id")], "doc_id long, text string").withColumn("x", quality.F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (8, 1), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).join(labels.groupBy("doc_id").agg(quality.F.max("quality").alias("y")), "doc_id", "left").withColumn("held", quality.held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["y"]) for r in got if r["held"] and r["y"] is not None]
    assert len(held) > 50 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def isotonic(value, weight):
    """Levels by the max-min formula, from the definition."""
    n, total = len(value), lambda a, b: (value[a:b] * weight[a:b]).sum() / weight[a:b].sum()
    return np.array([max(min(total(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])


def test_quality_scores_equal_plain_numpy(spark):
    rows = documents(240, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    x = np.array([quality.statistics(*quality.utf8(quality.pa.array([t])))[0] for _, t, _ in rows])
    y = np.array([y for _, _, y in rows], float)
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows])
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", quality.F.pmod(quality.F.xxhash64(docs.doc_id.cast("string")), quality.F.lit(5)).alias("f")).collect()}
    fold = np.array([folds[i] for i, _, _ in rows])
    deviation = x[train].std(0)
    rng = np.random.Generator(np.random.PCG64(quality.SEED))
    frequency, phase = rng.normal(0, 1 / quality.WIDTH, (x.shape[1], quality.FEATURES - 1)), rng.uniform(0, 2 * np.pi, quality.FEATURES - 1)
    z = np.clip((x - x[train].mean(0)) / np.where(deviation > 1e-9, deviation, 1), -8, 8)
    z = np.hstack([np.sqrt(2 / (quality.FEATURES - 1)) * np.cos(z @ frequency + phase), np.ones((len(z), 1))])
    ridge = lambda use: np.linalg.lstsq(np.vstack([z[use], np.sqrt(quality.RIDGE) * np.eye(quality.FEATURES)]), np.concatenate([y[use], np.zeros(quality.FEATURES)]), rcond=None)[0]
    place = lambda raw: (raw + 0.5) / 2 * quality.SCORE_BINS
    other = np.zeros(len(z))
    for f in range(5):
        other[fold == f] = z[fold == f] @ ridge(train & (fold != f))
    own = np.clip(place(other[train]), 0, quality.SCORE_BINS - 1).astype(int)
    bins, at = np.unique(own, return_inverse=True)
    weight = np.bincount(at).astype(float)
    level = isotonic(np.bincount(at, weights=y[train]) / weight, weight)
    knots, levels = [], []
    for v in np.unique(level.round(12)):
        inside = bins[np.abs(level - v) < 1e-9]
        knots += [inside[0] + 0.25, inside[-1] + 0.75]
        levels += [v, v]
    want = np.clip(np.interp(place(z @ ridge(train)), knots, levels), 0, 1)
    assert np.abs(np.array([got[i] for i, _, _ in rows]) - want).max() < 1e-6


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_keep_scored_keeps_columns(spark):
    rows = documents(120)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.learn_quality(quality.document_statistics(docs, "doc_id", "text"), labels)
    kept = quality.keep_scored(docs, model, 0.5)
    assert kept.columns == docs.columns and 60 < kept.count() < 100


def test_pool_violators():
    level, size = quality.pool_violators(np.array([0.0, 0.4, 0.2, 0.9, 0.9]), np.array([1, 1, 1, 1, 1.0]))
    assert level.round(6).tolist() == [0.0, 0.3, 0.9] and size.tolist() == [1, 2, 2]


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ["tha", "ing", "er", "the"], "bb": ["ção", "ên", "os", "de"], "cc": ["sch", "ung", "ße", "ver"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60)), lang) for i, lang in enumerate(rng.choice(sorted(parts)) for _ in range(300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, rows[0][1] * 200, None)], "doc_id long, text string, lang string").withColumn("score", quality.F.lit(1))
    train = docs.where("doc_id % 2 = 0")
    contents = language_id.learn(language_id.sample_texts(train, quality.F.col("text"), quality.F.col("lang")))
    got = {r["doc_id"]: r for r in language_id.identify(docs, contents).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 2]) > 0.95
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903]["lang_pred"] == rows[0][2] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), contents).count() == 0


def test_language_judgement_equals_plain_compression():
    rng = random.Random(6)
    parts = {"aa": ["tha", "ing", "er", "the"], "bb": ["ção", "ên", "os", "de"], "cc": ["sch", "ung", "ße", "ver"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    contents = {k: language_id.distinct_words(text(k, 3000)) for k in parts}
    judge = language_id.Compressors(contents)
    for sample in [text(k, n) for k in parts for n in (1, 5, 60, 4000)] + ["x", "É", text("aa", 30) + text("cc", 30)]:
        words = b" ".join(dict.fromkeys(re.findall(rb"[a-z\x80-\xff]+", sample.lower().encode())))
        sizes = {}
        for k in sorted(parts):
            one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=language_id._parameters())
            sizes[k] = sum(len(one.compress(words[i : i + language_id.PIECE])) for i in range(0, len(words), language_id.PIECE))
        best = min(sorted(parts), key=sizes.get)
        lang, score, margin = judge.judge(sample)
        assert lang == best
        assert abs(score - 1 / sum(np.exp(-(v - sizes[best]) / (1 + 0.01 * len(words))) for v in sizes.values())) < 1e-9
        assert abs(margin - (sorted(sizes.values())[1] - sizes[best]) / (1 + len(words))) < 1e-9


def test_more_languages_than_are_learned(spark):
    rows = [(f"text {i} of {lang}", lang) for lang, n in (("a", 3), ("b", 5), ("c", 3), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows * 2, "t string, l string")
    sample = language_id.sample_texts(df, quality.F.col("t"), quality.F.col("l"), languages=2)
    assert {k: sorted(v) for k, v in sample.items()} == {k: sorted(t for t, l in rows if l == k) for k in ("a", "b")}


KEY = "AKIA" + "ABCD1234" * 2
BLOB = "wJalrXUtnFEMI" + "K7MDENGbPxRfiCYEXAMPLEKEY" * 2
TEXTS = [
    "password = hunter2hunter", "token:token:abcdefgh", "Secret=short", 'api_key: "x=y/z+w.v"', "passwd  ==abc", "é password: ünicode", KEY, KEY + "x", "AKIAabc", "f" * 24 + "g" + "0" * 23,
    "\x01\x02 token=\x03abcdef token=abcdef1 \x01", None, "", "PASSWORD:'abcdef'" * 50, "token=abcdef\ntoken=ghijkl", "ſecret=abcdefgh", "apikey=1234567 api-key=1234567",
]


def spans_brute(x):
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x or ""):
        if len(m[1]) >= 6 and m[0].isascii():
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", x or "") if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans(spark):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (0, TEXTS[3]), (None, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", quality.F.lit(1)).withColumn("kind", quality.F.lit(1))
    got = secrets.scan_secrets(df).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    have = sorted([(r["doc_id"], [tuple(s) for s in r["spans"] if s["kind"] < 3]) for r in got], key=key)
    assert have == sorted([(i, spans_brute(t)) for i, t in rows], key=key)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def kinds(spark, text):
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return [secrets.KINDS[s["kind"]] for s in row["spans"]]


def test_weak_parts_need_their_complements(spark):
    gap = " word" * 100
    assert kinds(spark, BLOB) == []
    assert kinds(spark, f"{KEY} then {BLOB}") == ["access", "secret"]
    assert kinds(spark, f"{KEY}{gap}{BLOB}") == ["access"]
    assert kinds(spark, "client_id = robot7") == []
    assert kinds(spark, f"client_id = robot7 key {BLOB} at https://host.example/v1") == ["ident", "secret", "endpoint"]
    assert kinds(spark, f"{KEY} at https://host.example/v1") == ["access"]
    assert kinds(spark, f"see https://host.example/v1 {gap} client_id = robot7 password = hunter2hunter") == ["ident", "assign"]
    # one value is one part
    value = "Ab3" * 21
    assert kinds(spark, f"client_id={value}") == []
    assert kinds(spark, f"key_id: {'Z' * 45}") == []
    assert kinds(spark, f"https://host.example/{value} client_id = robot7") == []
    assert kinds(spark, f"token={KEY} https://host.example/v1") == ["assign", "access"]
    assert kinds(spark, f"token={KEY} https://host.example/v1 password = hunter2hunter") == ["assign", "access", "endpoint", "assign"]


def links_brute(spans, scope):
    """spans: (kind, start, end). By the definition: every pair of a document's parts."""
    over = lambda a, b: a != b and a[1] < b[2] and b[1] < a[2]
    gap = lambda a, b: max(b[1] - a[2], a[1] - b[2])
    base = [s for s in spans if s[0] < 3]
    weak = [s for s in spans if s[0] > 2 and not any(over(s, b) for b in base)]
    kept = []
    for s in sorted(weak, key=lambda s: (s[1], s[0])):
        if not any(over(s, w) for w in kept):
            kept.append(s)
    weak = kept
    identifiers = [s for s in base + weak if s[0] in (1, 3)]
    hidden = [s for s in base + weak if s[0] == 4 or s[0] in (0, 2) and not any(over(s, b) for b in base if b[0] == 1)]
    near = lambda s, parts: any(0 <= gap(s, p) <= scope for p in parts if p != s)
    need = {3: [hidden], 4: [identifiers], 5: [identifiers, hidden]}
    return sorted(base + [s for s in weak if all(near(s, parts) for parts in need[s[0]])])


def test_a_span_that_only_overlaps_a_dropped_one_stays(spark):
    spans = [(3, 0, 10), (4, 5, 20), (5, 15, 30), (1, 40, 60), (0, 70, 80)]  # ident, secret, endpoint in a chain
    parts = spark.createDataFrame([(1, 1, *s) for s in spans], "k long, h long, kind int, start long, end long")
    got = sorted((r["kind"], r["start"], r["end"]) for r in secrets.link_parts(parts, 100).collect())
    assert got == links_brute(spans, 100) == [(0, 70, 80), (1, 40, 60), (3, 0, 10), (5, 15, 30)]


def test_links_equal_the_definition(spark):
    rng = random.Random(9)
    docs = {}
    for k in range(300):
        spans, at = [], dict.fromkeys(range(6), 0)
        for _ in range(rng.randint(0, 9)):
            kind = rng.randrange(6)
            start = at[kind] + rng.randint(0, 25)
            at[kind] = start + rng.randint(1, 12)  # spans of one kind never overlap
            spans.append((kind, start, at[kind]))
        docs[k] = spans
    parts = spark.createDataFrame([(k, k, *s) for k, spans in docs.items() for s in spans], "k long, h long, kind int, start long, end long")
    got = {k: [] for k in docs}
    for r in secrets.link_parts(parts, 8).collect():
        got[r["k"]].append((r["kind"], r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: links_brute(v, 8) for k, v in docs.items()}


def test_secrets_in_a_very_long_text(spark):
    text = f"{KEY} {'word ' * 200_000}" * 3
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["kind"], s["end"]) for s in got] == spans_brute(text)
