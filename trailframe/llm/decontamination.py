"""Benchmark decontamination: an FM-index per training shard.

A shard is a few megabytes of documents. Its words are mapped to the benchmark's
vocabulary; only unbroken stretches of known words at least as long as the
shortest window can hold one, so just these are indexed, each closed by a
separator of its own. All windows are searched backward at once, occurrences
are located, and their word spans are merged into removal spans.

The benchmark is read in blocks of at most about MAX_WORDS words (a longer item
is cut into pieces that overlap by a window less one word); a block is what a
task holds and what is broadcast. With several blocks the documents are scanned
once per block; only what was found is written, and the last scan joins it.
Words are found by a hash and then compared by their bytes.

Defined cases: null or empty texts have no words, spans or items, and an item
without words no window; an item of fewer words than a window is one window; an
item with a null id marks words but isn't listed; rows that repeat an item_id
count as one item; rows that repeat a doc_id give a row each; texts are never
cut; empty tables give results without hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import UPPER, ragged_take, read, same_spans, slices, span_hashes, spans, utf8, word_codes
from trailframe.llm.fm_index import FmIndex, suffix_array
from trailframe.storage import cut

WINDOW = 10
MAX_WORDS = 1_000_000
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Windows:
    """Distinct windows of a block of items and the items that hold each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], size: int) -> None:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = UPPER[data]
        starts, ends, rows = spans(data, offsets, WORD)
        code, first = word_codes(data, starts, ends)
        hashes = span_hashes(data, starts[first], ends[first])
        order = np.argsort(hashes, kind="stable")
        self.vocabulary = hashes[order]
        bound = np.stack([starts[first[order]], ends[first[order]]], 1).reshape(-1)
        self.text, self.text_off = ragged_take(data, bound, np.arange(0, len(bound), 2))
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # words of one hash
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        code = place[code]
        count = np.diff(rows)
        windows = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(count)), windows)
        first = rows[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(count[item], size)
        grid = first[:, None] + np.arange(size)
        padded = np.where(np.arange(size) < length[:, None], code[np.minimum(grid, max(len(code) - 1, 0))] if len(code) else 0, -1).astype(np.int32)
        if len(padded):
            self.patterns, owner = np.unique(padded, axis=0, return_inverse=True)
        else:
            self.patterns, owner = padded.reshape(0, size), np.zeros(0, np.int64)
        owner = owner.reshape(-1)
        self.lengths = (self.patterns >= 0).sum(1)
        order = np.argsort(owner, kind="stable")
        self.items, self.item_off = item[order], np.searchsorted(owner[order], np.arange(len(self.patterns) + 1))
        self.ids = ids
        self.shortest = int(self.lengths.min(initial=size))

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 if it isn't there."""
        words = span_hashes(data, starts, ends)
        at = np.searchsorted(self.vocabulary, words)
        out = np.full(len(words), -1)
        for k in range(self.alike):
            place = np.minimum(at + k, len(self.vocabulary) - 1)
            hit = np.flatnonzero((out < 0) & (self.vocabulary[place] == words))
            own = place[hit]
            same = same_spans(data, starts[hit], ends[hit], self.text, self.text_off[own], self.text_off[own + 1])
            out[hit[same]] = own[same]
        return out

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in the words of documents: first word, word count and window of each. data is in lower case."""
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(self.patterns):
            return none, none, none
        words = at = self.places(data, starts, ends)
        known = np.zeros(len(words) + 1, bool)
        known[:-1] = at >= 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        edge = rows[:-1][rows[:-1] < len(words)]
        begin[edge] = known[edge]
        begin = np.flatnonzero(begin)
        if not len(begin):
            return none, none, none
        gap = np.flatnonzero(np.concatenate([~known[1:], [True]]) & known)  # last words before an unknown one
        stop = np.minimum(gap[np.searchsorted(gap, begin)] + 1, np.append(begin[1:], len(words)))
        long = stop - begin >= self.shortest
        begin, stop = begin[long], stop[long]
        if not len(begin):
            return none, none, none
        size = stop - begin + 1  # with the separator
        where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        closing = np.cumsum(size) - 1
        text = at[np.minimum(where, len(words) - 1)] + 1
        text[closing] = 0
        ranked = text + len(closing)
        ranked[closing] = np.arange(len(closing))  # each separator is a symbol of its own to the sort
        index = FmIndex(text, suffix_array(ranked), len(self.vocabulary) + 1, np.cumsum(size) - size)
        low, high = index.search(self.patterns + 1, self.lengths)
        found = np.flatnonzero(low < high)
        times = (high - low)[found]
        window = np.repeat(found, times)
        suffix = np.repeat(low[found] - (np.cumsum(times) - times), times) + np.arange(len(window))
        return where[index.locate(suffix)], self.lengths[window], window


def _merged(first: np.ndarray, length: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of word spans as starts and ends; spans never cross documents."""
    change = np.bincount(first, minlength=total + 1)[: total + 1] - np.bincount(first + length, minlength=total + 1)[: total + 1]
    hit = np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8)
    step = np.diff(hit)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_SPANS = "array<struct<word:bigint,words:bigint,start:bigint,end:bigint>>"


def _pass(df: DataFrame, windows: Windows, size: int, kind: str) -> DataFrame:
    """One block of the benchmark: adds hit words, removal spans and items to what earlier blocks found."""
    shared = df.sparkSession.sparkContext.broadcast(windows)
    span_type = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "t"):
            data, offsets = utf8(part.column(1))
            starts, ends, rows = spans(data, offsets, WORD)
            first, length, window = own.find(UPPER[data], starts, ends, rows)
            row = np.searchsorted(rows, first, "right") - 1
            older = part.column(3).to_pylist()
            for i, known in enumerate(older):  # spans of earlier blocks
                if known:
                    first = np.append(first, [rows[i] + s["word"] for s in known])
                    length = np.append(length, [s["words"] for s in known])
            begin, end = _merged(first, length, len(starts)) if len(first) else (first, first)
            if len(begin):  # cut what runs on from one document to the next
                inner = np.union1d(begin, rows[(rows > 0) & (rows < len(starts))])
                span = np.searchsorted(begin, inner, "right") - 1
                inside = (span >= 0) & (inner < end[span])
                begin, end = inner[inside], end[span[inside]]
                end = np.minimum(end, rows[np.searchsorted(rows, begin, "right")])
            at = np.searchsorted(rows, begin, "right") - 1
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(begin) else np.zeros(len(data) + 1, np.int64)
            base = points[offsets[:-1]][at]
            values = pa.StructArray.from_arrays([pa.array(begin - rows[at]), pa.array(end - begin), pa.array(points[starts[begin]] - base), pa.array(points[ends[end - 1]] - base)], names=["word", "words", "start", "end"])
            list_off = np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32)
            pairs = np.unique(np.stack([row, window], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
            items = [set(x) for x in part.column(4).to_pylist()]
            for r, w in pairs.tolist():
                items[r].update(own.ids[i] for i in own.items[own.item_off[w] : own.item_off[w + 1]] if own.ids[i] is not None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(list_off), values).cast(span_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["k", "t", "n_words", "spans", "items"],
            )

    return df.mapInArrow(run, f"k {kind}, t string, n_words bigint, spans {_SPANS}, items array<string>")


def _pieces(text: str, size: int, max_words: int) -> Iterator[str]:
    """The text, or parts of at most about max_words words that together have the windows of the whole."""
    if len(text) <= max_words:
        yield text
        return
    data, offsets = utf8(pa.array([text], pa.large_string()))
    starts, ends, _ = spans(data, offsets, WORD)
    at, last = 0, max(0, len(starts) - size)
    while True:
        stop = min(at + max_words + size - 1, len(starts))
        yield data[starts[at] : ends[stop - 1]].tobytes().decode() if len(starts) else ""
        if at + max_words > last:
            return
        at += max_words


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, max_words: int) -> Iterator[Windows]:
    """Items in blocks of at most about max_words words; one block at least."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    held = 0
    rows = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[text_col].cast("string").alias("t"))
    for row in rows.toLocalIterator():
        for text in _pieces(row["t"] or "", size, max_words):
            n = len(text) // 2 + 1
            if ids and held + n > max_words:
                yield Windows(ids, texts, size)
                ids, texts, held = [], [], 0
            ids.append(row["i"])
            texts.append(text)
            held += n
    yield Windows(ids, texts, size)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows (id, text, n_words, spans, items), one per input row.

    spans: merged removal spans with first word, word count and code-point start
    and end; items: sorted ids of the items with a window in the document.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    none, no_items = F.array().cast(_SPANS), F.array().cast("array<string>")
    docs = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t"), F.lit(0).cast("long").alias("n_words"))
    fresh = docs.withColumns({"spans": none, "items": no_items})
    blocks = _blocks(benchmark, item_col, item_text_col, size, max_words)
    windows, earlier = next(blocks), None
    for following in blocks:
        found = _pass(fresh, windows, size, kind).where(F.size("spans") > 0).select("k", F.xxhash64("t").alias("u"), "spans", "items")
        found = cut(spark, found.dropDuplicates(["k", "u"]), "leaks")
        earlier = found if earlier is None else earlier.unionByName(found)
        windows = following
    if earlier is not None:
        merged = earlier.groupBy(F.col("k").alias("fk"), F.col("u").alias("fu")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        met = docs.withColumn("u", F.xxhash64("t")).join(merged, (F.col("u") == F.col("fu")) & F.col("k").eqNullSafe(F.col("fk")), "left")
        fresh = met.select("k", "t", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", no_items).alias("items"))
    out = _pass(fresh, windows, size, kind)
    return out.select(F.col("k").alias(id_col), F.col("t").alias(text_col), "n_words", "spans", "items")


def without_spans(text, spans):
    """The text with its removal spans cut out."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.zip_with(edges, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT item_id, {_WORDS} FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS k FROM b),
dk AS (SELECT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: {{'i': i, 'k': array_to_string(w[i:i + size - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
h AS (SELECT dk.doc_id, dk.x.i AS i, dk.size, item_id FROM dk JOIN bw ON dk.size = bw.size AND dk.x.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
