"""A corpus pipeline over `documents`: quality, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`; n_chars follows the text.

Defined cases, for every stage: rows are taken as they are, whatever other rows
repeat their doc_id, and a null doc_id is kept like any other; columns beyond
those of `documents` are carried along, whatever their names; texts are never
cut; an empty table gives an empty table. What null and empty texts come to is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import read
from trailframe.llm.bpe import encode_decode
from trailframe.llm.decontamination import find_leaks
from trailframe.llm.line_dedup import dedup_lines
from trailframe.llm.near_dedup import keep_first
from trailframe.llm.quality import THRESHOLD, document_statistics, keep_scored, learn_quality
from trailframe.storage import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have the score of an empty text; without labels every score is 0.5 and all stay.
    """
    stats = cut(spark, document_statistics(docs, "doc_id", "text"), "statistics")
    model = learn_quality(stats, read(spark, sf_dir, "labels"))
    return keep_scored(docs, model, THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; a document that loses all its words goes.

    Null texts become empty; texts without words stay unless lines of theirs went.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_lines(docs, carry=rest)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", "text", "rest.*").withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Texts without words and rows with a null doc_id are copies of nothing and stay; rows that repeat an id and a text stay or go together.
    """
    return keep_first(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; texts without words stay, and without items all do."""
    rest = [c for c in docs.columns if c != "text"]
    found = find_leaks(docs.select(F.struct(*rest).alias("row"), "text"), read(spark, sf_dir, "benchmark"), id_col="row")
    return found.where(F.size("spans") == 0).select("row.*", "text").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by a digest of what they decode to; null and empty texts have none."""
    out = encode_decode(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: The quality classifier and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
