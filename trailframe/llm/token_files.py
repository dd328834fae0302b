"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file set is a Parquet table of self-contained blocks, since every store that
Spark reaches can hold it; each row carries one block's bytes. Ids are replaced
by their frequency rank over all documents, so that frequent ids take one byte.
A block's bytes are

    magic 'TKB1' | n_docs u32 | n_docs id counts u32
    | control bytes, four 2-bit byte counts each | rank bytes, little-endian

where each document begins a new control byte
and are decoded by table lookup on the control bytes. `base` is the number of
ids of the same part before the block; `part` numbers the sorted ranges.

Steps: documents are encoded once into the shared folder; the same pass counts
its ids, and each task adds one row of counts (their sums, one row per
vocabulary id at most, reach the driver). Range bounds come from the ids of the
documents alone, one for each part; documents are coded and given their part in
one pass, dealt, sorted and joined to blocks. The totals of the parts give the
global start of each block when the files are read.

Defined cases: null text counts as empty and holds the end id alone; rows that
repeat a doc_id all stay, ordered by a hash of their ids, then by the ids; a
null doc_id comes first; texts are never cut; an empty table gives an empty file set and result;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import binary_slices, pack, read, slices, utf8
from trailframe.llm.bpe import WordBpe, encoder, model_bytes
from trailframe.storage import cut, discard, shared_dir

END_ID = 2
BLOCK_IDS = 1 << 19
MAGIC = b"TKB1"
#: Byte counts of the four ids under each control byte.
_SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def code_ranks(ranks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes, then rank bytes of each document, and their offsets."""
    n = np.diff(offsets)
    groups = -(-n // 4)
    size = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    group_off = np.concatenate([[0], np.cumsum(groups)])
    slot = np.arange(len(ranks)) + np.repeat(4 * group_off[:-1] - offsets[:-1], n)
    code = np.zeros(4 * int(group_off[-1]), np.uint8)
    code[slot] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    data_off = np.concatenate([[0], np.cumsum(size)])[offsets]
    out_off = group_off + data_off
    out = np.empty(int(out_off[-1]), np.uint8)
    out[np.arange(len(control)) + np.repeat(data_off[:-1], groups)] = control
    out[np.arange(len(data)) + np.repeat(group_off[1:], np.diff(data_off))] = data
    return out, out_off


def pack_block(docs: list[bytes], counts: np.ndarray) -> bytes:
    """One block of coded documents."""
    cut_at = (-(-counts // 4)).tolist()
    head = [MAGIC, np.array([len(docs)], "<u4").tobytes(), counts.astype("<u4").tobytes()]
    return b"".join([*head, *(d[:c] for d, c in zip(docs, cut_at)), *(d[c:] for d, c in zip(docs, cut_at))])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and the id counts of the block's documents."""
    raw = np.frombuffer(block, np.uint8)
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs = int(raw[4:8].view("<u4")[0])
    counts = raw[8 : 8 + 4 * docs].view("<u4").astype(np.int64)
    groups = -(-counts // 4)
    control = raw[8 + 4 * docs : 8 + 4 * docs + int(groups.sum())]
    first = 4 * (np.cumsum(groups) - groups)
    slot = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    size = _SIZES[control].reshape(-1)[slot]
    out = np.zeros((len(slot), 4), np.uint8)
    data = raw[8 + 4 * docs + len(control) :]
    out[np.arange(4) < size[:, None]] = data
    return out.reshape(-1).view("<u4").astype(np.int64), counts


def _encoded(df: DataFrame, id_col: str, text_col: str, model: str | None, end_id: int) -> DataFrame:
    """Rows (k, ids, counts): ids and the end id, little-endian, in `_width` bytes each; or a task's counts alone."""
    content = model_bytes(model)
    raw = df.sparkSession.sparkContext.broadcast(content)
    width = _width(content, end_id)
    size = max(WordBpe(content).size, end_id + 1)
    source = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t"))
    names = ["k", "ids", "counts"]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw.value, "library")
        total = np.zeros(size, np.int64)
        schema = None
        for part in slices(batches, "t"):
            ids, offsets = own.encode(*utf8(part.column(1)))
            ids = np.insert(ids, offsets[1:], end_id)
            total += np.bincount(ids, minlength=size)
            offsets = offsets + np.arange(len(offsets))
            packed = pack(ids.astype(f"<u{width}").view(np.uint8), offsets * width, pa.large_binary()).cast(pa.binary())
            schema = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.nulls(part.num_rows, kind)], names=names)
        if schema is not None:
            at = np.flatnonzero(total)
            values = pa.StructArray.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), values).cast(kind)], names=names)

    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, ids binary, counts array<struct<id:bigint,n:bigint>>")


def _width(content: bytes, end_id: int) -> int:
    return 2 if max(WordBpe(content).size - 1, end_id) < 1 << 16 else 4


def _ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data.view(f"<u{width}"), (off - off[0]) // width


def _order(k, tie: int) -> tuple:
    return (k is not None, *(() if k is None else (k,)), tie)


def _bounds(docs: DataFrame, parts: int) -> list[tuple]:
    """The last (k, tie) of each of `parts` ranges but the last one; only these two columns are sorted for them."""
    dealt = docs.select("k", "tie").repartitionByRange(parts, "k", "tie")
    last = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("k", "tie")).alias("m")).collect()  # one row for each part
    return sorted(_order(r["m"]["k"], r["m"]["tie"]) for r in last)[:-1]


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end_id: int = END_ID) -> None:
    """Write the file set of all documents below `path`: blocks/ and ranks/."""
    spark = df.sparkSession
    width = _width(model_bytes(model), end_id)
    written = cut(spark, _encoded(df, id_col, text_col, model, end_id).withColumn("tie", F.xxhash64("ids")), "ids")
    docs = written.where("counts IS NULL")
    ranks = written.where("counts IS NOT NULL").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    rows = ranks.orderBy(F.desc("n"), "id").collect()  # one row for each id of the vocabulary at most
    order = np.array([r["id"] for r in rows], np.int64)
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(rows)], "rank bigint, id bigint, n bigint").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.int64)
    rank_of[order] = np.arange(len(order))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((rank_of, _bounds(docs, parts)))
    kind = docs.schema["k"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, bounds = shared.value
        for part in binary_slices(batches, 2):
            ids, offsets = _ids(part.column(2), width)
            data, at = code_ranks(rank_of[ids], offsets)
            p = [bisect_left(bounds, _order(k, tie)) for k, tie in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), part.column(0), part.column(1), pa.array(np.diff(offsets)), pack(data, at, pa.large_binary()).cast(pa.binary())], names=["p", "k", "tie", "n", "coded"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = seq = 0
        for batch in batches:
            counts = np.asarray(batch.column(1))
            ends = np.cumsum(counts)
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK_IDS, "right")))
                block = pack_block(batch.column(2).slice(start, stop - start).to_pylist(), counts[start:stop])
                keys = pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), batch.column(0).slice(start, stop - start))
                n = int(ends[stop - 1]) - done
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(start, 1), pa.array([seq], pa.int64()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), keys, pa.array([block], pa.binary())], names=["part", "seq", "base", "n_ids", "doc_ids", "block"])
                base, seq, start = base + n, seq + 1, stop

    coded = docs.select("k", "tie", "ids").mapInArrow(code, f"p int, k {kind}, tie bigint, n bigint, coded binary")
    dealt = coded.repartitionById(parts, "p").sortWithinPartitions("p", "k", "tie", "coded").select("k", "n", "coded", "p")
    dealt.mapInArrow(join, f"part int, seq bigint, base bigint, n_ids bigint, doc_ids array<{kind}>, block binary").write.parquet(f"{path}/blocks")
    discard(written)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary of little-endian uint32) of a file set, in any order."""
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each part
    first = dict(zip([r["part"] for r in totals], accumulate([0, *(r["n"] for r in totals)])))
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], np.int64)
    shared = spark.sparkContext.broadcast((first, order))
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, order = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ranks, lengths = unpack_block(batch.column(3)[i].as_py())
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                start = first[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py() + offsets[:-1]
                ids = order[ranks].astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1).flatten(), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pack(ids, offsets * 4, pa.large_binary()).cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "base", "doc_ids", "block").mapInArrow(run, f"doc_id {kind.simpleString()}, start bigint, n_tokens bigint, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
