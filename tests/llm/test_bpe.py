"""BPE and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trailframe.llm import bpe, token_files
from trailframe.llm._text import utf8
from trailframe.storage import shared_dir

ALPHABET = "aabbAB zZ'’éÉèßΣσİıñÑ 01²½Ⅷ\t\n  ́\u0085\x1c<|endoftext|>!?.,-_漢字カナ한국😀​﻿"
SPECIAL = ["", "   ", "<|endoftext|>x<|startoftext|>", "aaaaaaaaaaaaa", "it's WE'LL they'd", "é ΑΣ ΣΣ", "a" * 3000, "\n\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_model())


def texts(n=1500):
    rng = random.Random(3)
    return SPECIAL + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["numpy", "library"])
def test_ids_and_text_equal_the_library(library, kind):
    own = bpe.encoder(bpe.model_bytes(), kind)
    own.clear()
    all_texts = texts()
    for part in (all_texts[:700], all_texts[700:]):  # the second batch meets a filled cache
        ids, off = own.encode(*utf8(pa.array(part)))
        data, at = own.model.text_of(ids.astype(np.int64), off)
        for i, t in enumerate(part):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[off[i] : off[i + 1]].tolist() == want, t
            assert data[at[i] : at[i + 1]].tobytes().decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["numpy", "library"])
def test_ids_equal_the_library_over_all_code_points(library, kind):
    own = bpe.encoder(bpe.model_bytes(), kind)
    part = [f"a{chr(c)}b" for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    own.clear()
    want = library.encode_batch(part, add_special_tokens=False)
    for i in range(0, len(part), 100_000):
        ids, off = own.encode(*utf8(pa.array(part[i : i + 100_000])))
        assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(off[:-1], off[1:], want[i : i + 100_000]))


@pytest.mark.parametrize("kind", ["numpy", "library"])
def test_chunks_that_hash_alike_keep_their_own_ids(library, monkeypatch, kind):
    from tests.llm.test_dedup import thue_morse

    own = bpe.encoder(bpe.model_bytes(), kind)
    own.clear()
    part = [thue_morse(b, f) for b in (7, 8, 11) for f in (0, 1)] + ["ab", "cd", "ef", "ab", "\u0378x", "z" * 20_000]
    want = [library.encode(t, add_special_tokens=False).ids for t in part]
    for hashed in (bpe.span_hashes, lambda data, starts, ends, fold=False: (ends - starts).astype(np.uint64)):
        monkeypatch.setattr("trailframe.llm._text.span_hashes", hashed)
        monkeypatch.setattr(bpe, "span_hashes", hashed)
        own.clear()
        for texts_ in (part, part[::-1]):
            ids, off = own.encode(*utf8(pa.array(texts_)))
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == (want if texts_ is part else want[::-1])
    own.clear()


def test_cache_starts_anew_within_its_bound(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 300)
    own = bpe.ChunkEncoder(bpe.WordBpe(bpe.model_bytes()))
    for t in ("one two three four", "three four five six seven", "one seven"):
        ids, _ = own.encode(*utf8(pa.array([t])))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    own = bpe.ChunkEncoder(bpe.WordBpe(bpe.model_bytes()))
    rng = random.Random(0)
    most = 0
    for _ in range(12):
        text = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(80)) for _ in range(200))
        own.encode(*utf8(pa.array([text])))
        most = max(most, own.bytes())
    assert 50_000 < most <= 200_000 + 5 * 200 * 240


def test_rows_nulls_and_clashing_names(spark, library):
    rows = [(1, "Hello world", 5), (1, "Hello world", 6), (2, None, 7), (None, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumnRenamed("ids", "k")
    got = bpe.encode_decode(df).collect()
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got] == [(1, 2, "hello</w> world</w>")] * 2 + [(2, 0, ""), (None, 0, "")]
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ranks = rng.choice([0, 3, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1], 1000)
    off = np.array([0, 0, 1, 5, 5, 400, 1000])
    data, at = token_files.code_ranks(ranks, off)
    docs = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    got, counts = token_files.unpack_block(token_files.pack_block(docs, np.diff(off)))
    assert got.tolist() == ranks.tolist() and counts.tolist() == np.diff(off).tolist()


@pytest.mark.parametrize("block", [3, 1 << 19])
def test_file_set(spark, library, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rows = [(5, "b a b"), (1, None), (3, "the the <|endoftext|>"), (5, "zz top"), (None, "x"), (2, "é" * 50)]
    path = shared_dir(spark, "t")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 5, 5]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in rows)
    assert sorted(zlib.crc32(bytes(r["ids"])) for r in got) == want
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)
    assert next(r["n"] for r in ranks if r["id"] == 2) == len(rows)


def test_file_set_of_clashing_names_repeated_rows_and_a_very_long_text(spark, library):
    long = "word, " * 200_000
    rows = [(2, long, 1, 1), *[(1, "same text", 1, 1)] * 40, (1, "other", 1, 1), (3, None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, tie int").withColumn("counts", token_files.F.lit(1)).withColumn("p", token_files.F.lit(1)).repartition(3)
    path = shared_dir(spark, "t")
    token_files.write_tokens(df, path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1] * 41 + [2, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert bytes(got[41]["ids"]) == np.array(library.encode(long, add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert not any("ids-" in str(f) for f in __import__("pathlib").Path(path).parent.iterdir())


def test_empty_file_set(spark):
    path = shared_dir(spark, "t")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.read_tokens(spark, path).count() == 0
