"""The corpus pipeline, stage by stage, against brute force on its own input."""

import pytest

import corpus_pipeline
from tests.llm.test_dedup import leak_brute, lines_brute, near_brute
from trailframe.llm._text import read
from trailframe.storage import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(spark, stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    kept = {i for i, _ in rows(stages[1])}
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.3 * (len(labels) - len(good))


def test_line_dedup(stages):
    want = [(i, t) for i, t, _, dropped in lines_brute(rows(stages[1])) if not dropped or t.strip(" \t\n\x0b\x0c\r")]
    assert rows(stages[2]) == sorted(want)


def test_near_dedup(stages):
    before = rows(stages[2])
    assert rows(stages[3]) == [r for r, (i, _, c) in zip(before, near_brute(before, 5)) if i == c]


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    hit = {i for i, _, n, _ in leak_brute(rows(stages[3]), items) if n}
    assert rows(stages[4]) == [(i, t) for i, t in rows(stages[3]) if i not in hit]


def test_bpe(stages):
    from tokenizers import Tokenizer

    from trailframe.llm.bpe import default_model

    library = Tokenizer.from_file(default_model())
    got = {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows(stages[4])}


def test_run(spark, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == [i for i, _ in rows(stages[4])]


EXTRA = ["k", "t", "u", "row", "rest", "gone", "own", "spans", "items", "drop", "n_dropped", "component", "x", "score"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated ids and rows, clashing names; a folder with labels and items."""
    line = "a line of more than forty characters that six documents share"
    rows = [(i, f"own words of document {i} stand here\n{line}\nand some more of {i}") for i in range(6)]
    rows += [(10, None), (11, ""), (12, " \n"), (None, None), (None, "a text without an id"), (13, "word " * 400_000), (13, "another text of the same id")]
    rows += [(14, "b c d e f g h i j k l m")] * 2 + [(15, "b c d e f g h i j k l m"), (16, "x one two three four five six seven eight nine ten y"), (3, line)]
    docs = spark.createDataFrame([(i, t, "en", "web", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA:
        docs = docs.withColumn(name, docs.doc_id + 1)
    sf = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([("i", "One two three four five six seven eight nine ten"), (None, None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    return docs, rows, sf


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, name):
    docs, rows, sf = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    if name == "bpe":
        assert out.count() == len(rows)
    else:
        assert out.columns == docs.columns
        assert all(r[x] == (None if r["doc_id"] is None else r["doc_id"] + 1) for r in out.collect() for x in EXTRA)
    if name == "quality":  # all labels say good
        assert pairs(out) == sorted(rows, key=str)
    if name == "line_dedup":
        want = [(i, t) for i, t, _, dropped in lines_brute(rows) if not dropped or t.strip(" \t\n\x0b\x0c\r")]
        assert pairs(out) == sorted(want, key=str)
    if name == "near_dedup":
        assert pairs(out) == sorted([r for r in rows if r[0] != 15], key=str)
    if name == "decontamination":
        assert pairs(out) == sorted([r for r in rows if r[0] != 16], key=str)
    empty = stage(spark, docs.limit(0), sf)
    assert empty.count() == 0 and empty.columns == out.columns


def test_run_on_an_empty_table(spark, odd, tmp_path):
    docs, _, sf = odd
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
