"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of snippets of its
documents. A text (lower case, letters only, each word once) is compressed in
pieces against every dictionary; the smallest total wins, and the margin to the
second smallest tells how sure that is.

The dictionaries come from a bounded sample: per language about SAMPLE_DOCS
distinct texts chosen by their hash, SNIPPET characters from the middle
of each; of the MAX_LANGUAGES languages with the most distinct texts, if there
are more. Half of the sample judges the other half, and snippets whose own
language doesn't win are left out, since labels can be wrong. Everything else
covers all documents.

Defined cases: null texts and texts without a letter are `und` with score 0;
without any learned language every text is `und`; null languages aren't learned;
languages tie in name order; texts are never cut; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import read, slices

SAMPLE_DOCS = 800
SNIPPET = 400
MAX_LANGUAGES = 500
#: Bytes of a dictionary at most, and the size to which longer ones are cut if some language has less.
DICTIONARY, EVEN = 128 << 10, 16 << 10
PIECE = 4096
#: Least margin, as a share of the letters, below which `rejected` is set.
MARGIN = 0.01
UNKNOWN = "und"
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def distinct_words(text: str) -> bytes:
    return b" ".join(dict.fromkeys(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()))


def _parameters() -> zstandard.ZstdCompressionParameters:
    """Greedy search for matches of four bytes and more: word parts tell languages apart better than long repeats."""
    return zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )


class Compressors:
    def __init__(self, contents: dict[str, bytes]) -> None:
        self.names = sorted(contents)
        self.own = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=_parameters())
            self.own.append(zstandard.ZstdCompressor(dict_data=data, compression_params=_parameters()))

    def sizes(self, words: bytes) -> np.ndarray:
        pieces = [words[i : i + PIECE] for i in range(0, len(words), PIECE)] or [b""]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.own])

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        words = distinct_words(text)
        sizes = self.sizes(words)
        best = int(sizes.argmin())
        gap = (sizes - sizes[best]) / (1 + 0.01 * len(words))
        rest = np.delete(sizes, best)
        margin = (rest.min() - sizes[best]) / (1 + len(words)) if len(rest) else 1.0
        return self.names[best], float(1 / np.exp(-gap).sum()), float(margin)


def _contents(sample: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionary contents of nearly even size, so that a larger one has no advantage."""
    words = {k: b" ".join(distinct_words(s) for s in v) for k, v in sample.items() if v}
    size = min(DICTIONARY, max(EVEN, min(map(len, words.values()), default=0)))
    return {k: w[-size:] for k, w in words.items()}


def learn(sample: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionary contents, from those snippets that the other half's dictionaries assign to their own language."""
    sample = {k: v for k, v in sample.items() if v}
    halves = [{k: v[i::2] for k, v in sample.items()} for i in (0, 1)]
    kept: dict[str, list[str]] = {k: [] for k in sample}
    for mine, other in (halves, halves[::-1]):
        judge = Compressors(_contents(other))
        for name, snippets in mine.items():
            kept[name].extend(s for s in snippets if judge.judge(s)[0] == name)
    return _contents({k: kept[k] or sample[k] for k in sample})


def sample_texts(df: DataFrame, text: Column, lang: Column, docs: int = SAMPLE_DOCS, languages: int = MAX_LANGUAGES) -> dict[str, list[str]]:
    """Snippets by language, of distinct texts; bounded by `docs` for a language and by `languages`, ties in name order."""
    rows = df.select(text.alias("t"), lang.cast("string").alias("l")).where("l IS NOT NULL AND length(t) > 0")
    texts = rows.select("l", F.xxhash64("t").alias("h")).distinct()
    counts = {r["l"]: r["n"] for r in texts.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * docs / n))))
    start = F.greatest(F.lit(1), F.floor((F.char_length("t") - SNIPPET) / 2).cast("int") + 1)
    picked = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.element_at(share, F.col("l")) * (1 << 30))
    picked = picked.select("l", F.xxhash64(F.lit(1), "t").alias("h"), F.substring("t", start, F.lit(SNIPPET)).alias("s")).distinct()
    top = picked.groupBy("l").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "s"))), 1, docs).alias("s")).collect()
    return {r["l"]: [x["s"] for x in r["s"]] for r in top}


def identify(df: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Rows (id, lang_pred, score, margin, rejected), one per input row."""
    shared = df.sparkSession.sparkContext.broadcast(contents)  # MAX_LANGUAGES dictionaries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(shared.value)
        for part in slices(batches, "t"):
            found = [own.judge(t) for t in part.column(1).to_pylist()]
            lang, score, gap = zip(*found)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(gap), pa.array([g < margin for g in gap])], names=["k", "lang_pred", "score", "margin", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, margin double, rejected boolean")
    return out.withColumnRenamed("k", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    contents = learn(sample_texts(docs.where(F.coalesce(~held, F.lit(True))), F.col("text"), F.col("lang")))
    out = identify(docs, contents)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
