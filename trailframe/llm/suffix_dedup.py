"""Repeated passages of a corpus by suffix arrays of shards.

A passage is a string of `window` bytes; it is repeated if it starts at two
places of the corpus at least. What is found is exact. Four steps:

1. **Candidates.** Each passage is keyed by the least hash of the `gram`-byte
   strings in it, so equal passages have equal keys wherever they stand. The
   starts of a text are cut into runs of one key; only keys that two texts, or
   two places of a text, share go on, as fragments of the text: the run's starts
   and the `window` bytes after the last.
2. **Shards.** Fragments of one key meet in one shard, equal ones as one row that
   knows its number. A shard (at most SHARD bytes) gets a suffix array by
   Larsson-Sadakane refinement: sorted by the first bytes, then only groups of
   suffixes that are still equal are sorted again, by the rank of the suffix h
   further on, h doubling until it covers a passage. Common prefixes of
   neighbours follow Kasai: along a diagonal (a suffix and its neighbour both one
   byte further on) the common prefix is one byte shorter, so only the first pair
   of a diagonal is compared. Passages whose neighbour shares `window` bytes are
   repeated.
3. **Merging.** A key of more than SHARD bytes fills several shards, whose
   distinct passages are looked up in each other's suffix arrays by binary
   search. A key of more than GROUP bytes isn't put together at all: its
   fragments are keyed anew by longer grams (LADDER, up to the passage itself),
   which leaves together only what shares that much, and equal fragments are one
   row again before they are moved.
4. **Marks** go back from fragments to texts. Texts that are equal as a whole are
   one text with a number of copies; one with several is all repeated.

Texts move once (to meet their runs), those with candidates a second time. A
task holds one group of keys or one text; every step is written to the shared
folder, so lost executors cost a step at most.

Defined cases: passages never cross rows; a null text is empty; texts shorter
than `window` have no passages; a row that repeats another's text, whatever its
id, is a copy of it; null ids are kept as they are; texts are never cut; an
empty table gives an empty result; other columns are ignored, whatever their
names. Texts count as equal by 120 bits of their SHA-256, fragments by 128 bits
of BLAKE2.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import binary_slices, lanes, pack, read
from trailframe.storage import cut, discard

WINDOW = 400
#: Bytes of text that are hashed at once; a run ends where such a piece ends.
PIECE = 1 << 20
SHARD = 1 << 20
GROUP = 1 << 23
#: Lengths of the grams that key a passage, as parts of its length; the last is the passage itself.
LADDER = (0.16, 0.64, 0.96, 1.0)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = 21  # of a position in a shard
_RUN = "array<struct<key: bigint, s: int, e: int>>"
_SPANS = "array<struct<start: bigint, end: bigint>>"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` (8 at least) bytes from each place on."""

    def blend(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return h

    h, have = blend(lanes(data)[: len(data) - 7] * _MUL), 8
    while have < size:
        step = min(have, size - have)
        h = blend(h[:-step] * _MUL + h[step:])
        have += step
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, by running minima from both ends of blocks."""
    blocks = np.concatenate([h, np.full(-len(h) % width, _TOP)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: len(h) - width + 1], before[width - 1 : len(h)])


def key_runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive passages with one key, not across rows: row, first start and end of starts in it, key, and the places of the key's gram in them (2 for many)."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64), none
    h = gram_hashes(data, gram)
    width = window - gram + 1
    key = sliding_min(h, width)
    edge = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= window
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - window + 1, -1)
    valid = np.cumsum(edge, dtype=np.int32)[: len(key)] > 0
    first = valid.copy()
    first[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
    first[offsets[:-1][long]] = True
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[row + 1] - window + 1)
    low = np.uint64(min(int(_TOP), 20 * (int(_TOP) // width)))
    at = np.flatnonzero(h < low)
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end - 1 + width)
    runs = np.zeros(len(start) + 1, np.int64)
    np.cumsum(hi - lo, out=runs[1:])
    index = np.arange(runs[-1]) + np.repeat(lo - runs[:-1], hi - lo)
    hit = np.concatenate([[0], np.cumsum(h[at[index]] == np.repeat(key[start], hi - lo))])
    places = hit[runs[1:]] - hit[runs[:-1]]
    places[key[start] >= low] = 2
    return row, start - offsets[row], end - offsets[row], key[start], places


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in buffers of bounded size; a longer row comes in overlapping pieces: first row, place in it, bytes, offsets."""
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        size = offsets[row + 1] - offsets[row]
        if stop == row + 1 and size > PIECE + window:
            for at in range(0, int(size) - window + 1, PIECE):
                part = data[offsets[row] + at : min(offsets[row] + at + PIECE + window - 1, offsets[row + 1])]
                yield row, at, part, np.array([0, len(part)])
        else:
            yield row, 0, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes (fewer than 2**21), sorted by their first `depth` bytes at least."""
    n = len(data)
    code = np.zeros(256, np.uint64)
    used = np.unique(data)
    code[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
    bits = int(len(used)).bit_length()
    h = (64 - _BITS) // bits
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = code[data]
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key <<= np.uint64(bits)
        key |= padded[j : j + n]
    low, shift = np.uint64((1 << _BITS) - 1), np.uint64(_BITS)
    key <<= shift
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    rank = np.zeros(n, np.int64)
    slots = np.arange(n)
    key >>= shift
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        rank[order[slots]] = slots[np.repeat(first, np.diff(np.append(first, len(slots))))]
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = slots[~alone]
        if h >= depth or not len(slots):
            return order
        at = order[slots]
        then = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << shift | then.astype(np.uint64)) << shift | at.astype(np.uint64)
        key.sort()
        order[slots] = (key & low).astype(np.int64)
        key >>= shift
        h *= 2


def common_prefix(one: np.ndarray, p: np.ndarray, two: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at p of `one` and at q of `two` share, `most` at most (which must lie in both)."""
    a, b = lanes(one), lanes(two)
    out = most.copy()
    live, at = np.arange(len(p)), 0
    while len(live):
        odd = a[p[live] + at] ^ b[q[live] + at]
        differs = odd != 0
        bits = odd[differs]
        out[live[differs]] = at + (np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        at += 8
        live = live[~differs]
        live = live[most[live] > at]
    return np.minimum(out, most)


def neighbour_prefixes(data: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """For successive suffixes of `order` (starts of passages): whether each shares `window` bytes with the one before.

    Kasai's rule along diagonals: (i, j) shares a byte less than (i - 1, j - 1), if both are neighbours.
    """
    before = np.full(len(data) + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (at[1:] == at[:-1] + 1) & (before[at[1:]] == before[at[:-1]] + 1)
    first = np.flatnonzero(~goes_on)
    length = np.diff(np.append(first, len(at)))
    shared = common_prefix(data, at[first], data, before[at[first]], length - 1 + window)
    prefix = np.zeros(len(data) + 1, np.int64)
    prefix[at] = np.repeat(shared, length) - (np.arange(len(at)) - np.repeat(first, length))
    out = prefix[order] >= window
    out[:1] = False
    return out


def found_in(one: np.ndarray, starts: np.ndarray, two: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """The place in `order` (sorted passages of `two`) of a passage equal to each of `one` at `starts`, or -1: binary search."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    out = np.full(len(starts), -1, np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        p, q = starts[live], order[mid]
        same = common_prefix(one, p, two, q, np.full(len(live), window))
        equal = same == window
        out[live[equal]] = mid[equal]
        step = np.minimum(same, window - 1)
        less = one[p + step] < two[q + step]
        hi[live[less]] = mid[less]
        lo[live[~less]] = mid[~less] + 1
        live = live[~equal]
        live = live[lo[live] < hi[live]]
    return out


class _Shard:
    """Fragments of whole keys, or a part of one large key's fragments, with their passages in sorted order."""

    def __init__(self, fragments: list[bytes], window: int) -> None:
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in fragments])])
        self.data, self.window = np.frombuffer(b"".join(fragments), np.uint8), window
        last = np.repeat(self.offsets[1:] - window, np.diff(self.offsets))
        order = suffix_array(self.data, window)
        self.order = order[order <= last[order]]
        same = neighbour_prefixes(self.data, self.order, window)
        self.group = np.cumsum(~same) - 1
        self.repeated = np.bincount(self.group) > 1

    def merge(self, other: _Shard) -> None:
        """Mark the passages that both have."""
        heads = np.flatnonzero(np.diff(self.group, prepend=-1))
        at = found_in(self.data, self.order[heads], other.data, other.order, self.window)
        hit = at >= 0
        self.repeated[self.group[heads[hit]]] = True
        other.repeated[other.group[at[hit]]] = True

    def spans(self) -> list[list[dict]]:
        """For each fragment the bytes that repeated passages cover."""
        starts = np.sort(self.order[self.repeated[self.group]])
        out: list[list[dict]] = [[] for _ in range(len(self.offsets) - 1)]
        if not len(starts):
            return out
        row = np.searchsorted(self.offsets, starts, "right") - 1
        first = np.flatnonzero((np.diff(starts, prepend=-self.window - 1) > self.window) | (np.diff(row, prepend=-1) != 0))
        last = np.append(first[1:], len(starts)) - 1
        for i, s, e in zip(row[first].tolist(), starts[first].tolist(), starts[last].tolist()):
            base = int(self.offsets[i])
            out[i].append({"start": s - base, "end": e + self.window - base})
        return out


def _solve(fragments: list[bytes], window: int) -> list[list[dict]]:
    """Spans of repeated passages among the fragments of some keys, in shards of at most SHARD bytes."""
    cuts, size = [0], 0
    for i, x in enumerate(fragments):
        if size and size + len(x) > SHARD:
            cuts.append(i)
            size = 0
        size += len(x)
    shards = [_Shard(fragments[a:b], window) for a, b in zip(cuts, [*cuts[1:], len(fragments)])]
    for i, shard in enumerate(shards):
        for other in shards[:i]:
            shard.merge(other)
    return [x for shard in shards for x in shard.spans()]



def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary or string column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _runs_of(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts: (id, a, b, t binary). Rows (key, id, a, b, s, e, places, first) of their runs; `first` marks one row of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in binary_slices(batches, 3, PIECE):
            data, offsets = _bytes(part.column(3))
            found = [(row + base, s + at, e + at, key, n) for base, at, piece, off in _pieces(data, offsets, window) for row, s, e, key, n in [key_runs(piece, off, window, gram)]]
            if not found:
                continue
            row, s, e, key, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((key, row))
            same = np.zeros(len(row), bool)
            same[1:] = (np.diff(row[order]) == 0) & (key[order][1:] == key[order][:-1])
            group = np.cumsum(~same) - 1
            places = np.zeros(len(row), np.int64)
            places[order] = np.bincount(group, weights=n[order])[group].astype(np.int64) if len(row) else 0
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *(part.column(i).take(at) for i in range(3)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.minimum(places, 2).astype(np.int32)), pa.array(np.diff(row, prepend=-1) != 0)],
                names=["key", "id", "a", "b", "s", "e", "places", "first"],
            )

    return texts.mapInArrow(run, "key bigint, id bigint, a bigint, b bigint, s int, e int, places int, first boolean")


def _fragments(df: DataFrame, window: int) -> DataFrame:
    """df: (a, b, t, runs). Rows (key, f, g, a, b, s, t): the text's part that holds a run's passages, named by its bytes (f, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in binary_slices(batches, 2, PIECE):
            data, offsets = _bytes(part.column(2))
            runs = part.column(3)
            row = np.repeat(np.arange(part.num_rows), np.asarray(runs.value_lengths()))
            key, s, e = (np.asarray(runs.flatten().field(i)) for i in range(3))
            for at in range(0, len(row), 4096):
                piece = slice(at, at + 4096)
                lo, hi = offsets[row[piece]] + s[piece], offsets[row[piece]] + e[piece] + window - 1
                own = [data[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist())]
                name = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in own), np.int64).reshape(-1, 2)
                index = pa.array(row[piece])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[piece]), pa.array(name[:, 0]), pa.array(name[:, 1]), part.column(0).take(index), part.column(1).take(index), pa.array(s[piece]), pa.array(own, pa.binary())],
                    names=["key", "f", "g", "a", "b", "s", "t"],
                )

    return df.mapInArrow(run, "key bigint, f bigint, g bigint, a bigint, b bigint, s int, t binary")


def _sharded(df: DataFrame, window: int) -> DataFrame:
    """df: (key, f, g, t), whole keys in a partition, sorted by key. Rows (key, f, g, spans), without fragments that have none."""

    def solve(names: list[tuple], fragments: list[bytes]) -> pa.RecordBatch:
        found = _solve(fragments, window)
        rows = [(*name, spans) for name, spans in zip(names, found) if spans]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "f", "g", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple] = []
        fragments: list[bytes] = []
        size, whole, whole_size = 0, 0, 0  # the first `whole` fragments are those of keys that ended
        for batch in batches:
            for key, f, g, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if names and names[-1][0] != key:
                    if size > SHARD and whole:
                        yield solve(names[:whole], fragments[:whole])
                        del names[:whole], fragments[:whole]
                        size -= whole_size
                    whole, whole_size = len(names), size
                names.append((key, f, g))
                fragments.append(t)
                size += len(t)
        if whole and size > SHARD:
            yield solve(names[:whole], fragments[:whole])
            del names[:whole], fragments[:whole]
        if names:
            yield solve(names, fragments)

    return df.mapInArrow(run, f"key bigint, f bigint, g bigint, spans {_SPANS}")


def _repeats(texts: DataFrame, window: int, group: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """texts: (id, a, b, t binary), (a, b) naming t. Rows (a, b, t, id, copies, spans) of the texts that have passages, and the tables they are read from.

    spans: sorted parts that repeated passages cover; they can touch or overlap.
    """
    spark, made = texts.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(spark, df, name))
        return made[-1]

    gram = max(8, round(LADDER[level] * window)) if level < len(LADDER) - 1 else window
    runs = keep(_runs_of(texts, window, gram), "runs")
    by_key = runs.groupBy("key").agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("a", "b")), F.max("places").alias("n"))
    shared = by_key.where("loa <> hia OR lob <> hib OR n > 1").select("key", F.lit(True).alias("shared"))
    marked = runs.join(shared, "key", "left")
    own = F.collect_set(F.when(F.col("shared"), F.struct("key", "s", "e"))).alias("runs")
    known = marked.groupBy("a", "b").agg(F.count_if("first").alias("copies"), F.min("id").alias("one"), own)
    dealt = keep(texts.join(known, ["a", "b"]), "dealt")
    some = dealt.where((F.size("runs") > 0) & F.col("id").eqNullSafe(F.col("one")))
    pieces = keep(_fragments(some.select("a", "b", "t", "runs"), window), "fragments")
    distinct = keep(pieces.groupBy("key", "f", "g").agg(F.count_distinct("a", "b", "s").alias("n"), F.first("t").alias("t")), "distinct")
    size = distinct.groupBy("key").agg(F.sum(F.length("t")).alias("size"))
    large = size.where(F.col("size") > group).select("key") if level < len(LADDER) - 1 else size.where("false").select("key")
    large = keep(large, "large")
    cold = distinct.join(large, "key", "left_anti").select("key", "f", "g", "t")
    found = _sharded(cold.repartition("key").sortWithinPartitions("key"), window)
    if not large.isEmpty():
        hot = distinct.join(large, "key", "left_semi")
        again, more = _repeats(hot.select(F.col("key").alias("id"), F.col("f").alias("a"), F.col("g").alias("b"), "t"), window, group, level + 1)
        made += more
        found = found.union(again.where(F.size("spans") > 0).select(F.col("id").alias("key"), F.col("a").alias("f"), F.col("b").alias("g"), "spans"))
    found = keep(found, "spans")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("t").cast("long").alias("end")))
    many = distinct.where("n > 1").select("key", "f", "g", whole.alias("spans"))
    parts = found.join(distinct.where("n > 1").select("key", "f", "g"), ["key", "f", "g"], "left_anti").union(many)
    shifted = pieces.drop("t").join(parts, ["key", "f", "g"]).select("a", "b", F.transform("spans", lambda x: F.struct((x["start"] + F.col("s")).alias("start"), (x["end"] + F.col("s")).alias("end"))).alias("spans"))
    by_text = shifted.groupBy("a", "b").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))
    by_text = keep(by_text, "marks")
    kept = [dealt, by_text]
    for df in made:
        if all(df is not x for x in kept):
            discard(df)
    out = dealt.join(by_text, ["a", "b"], "left")
    spans = F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    return out.select("a", "b", "t", "id", "copies", spans.alias("spans")), kept


def _removed(df: DataFrame) -> DataFrame:
    """df: (id, t, spans). Rows (id, n_bytes, spans, kept): maximal spans and the bytes outside of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in binary_slices(batches, 1, 4 * PIECE):
            data, offsets = _bytes(part.column(1))
            spans = part.column(2)
            row = np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths()))
            s, e = (offsets[row] + np.asarray(spans.flatten().field(i)) for i in range(2))
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, s, 1)
            np.add.at(depth, e, -1)
            gone = np.cumsum(depth, dtype=np.int32)[:-1] > 0
            start, end = gone.copy(), gone.copy()
            start[1:] &= ~gone[:-1]
            end[:-1] &= ~gone[1:]
            edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            start[edge] |= gone[edge]
            end[edge - 1] |= gone[edge - 1]
            start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
            row = np.searchsorted(offsets, start, "right") - 1
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            merged = pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(end - offsets[row])], ["start", "end"])
            cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(cuts, merged), pack(data[~gone], left, pa.large_binary()).cast(pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return df.mapInArrow(run, f"id bigint, n_bytes bigint, spans {_SPANS}, kept binary")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Rows (id, n_bytes, spans, kept), one per input row: the maximal byte spans that repeated passages cover, and the rest of the text."""
    if window < 16:
        raise ValueError("a passage has 16 bytes at least")
    spark: SparkSession = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    rows = df.select(df[id_col].cast("long").alias("id"), text.alias("t"))
    long = rows.where(F.length("t") >= window)
    part = lambda at: F.conv(F.substring(F.sha2("t", 256), at, 15), 16, 10).cast("long")
    named = long.select("id", part(1).alias("a"), part(16).alias("b"), "t")
    out, _ = _repeats(named, window, group)
    done = cut(spark, _removed(out.where(F.size("spans") > 0).select("id", "t", "spans")), "removed")
    clean = out.where(F.size("spans") == 0).select("id", "t").union(rows.where(F.length("t") < window))
    return done.union(clean.select("id", F.length("t").cast("long"), F.array().cast(_SPANS), "t"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents"))
    removed: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400),
h AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 800)) AS k FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
f AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -401) + 400 THEN 1 ELSE 0 END AS first FROM r),
g AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
s AS (SELECT doc_id, g, min(i) AS s, max(i) + 400 AS e FROM g GROUP BY doc_id, g),
p AS (SELECT s.doc_id, g, s, e, substring(x, 2 * coalesce(lag(e) OVER (PARTITION BY s.doc_id ORDER BY g), 0) + 1, 2 * (s - coalesce(lag(e) OVER (PARTITION BY s.doc_id ORDER BY g), 0))) AS before FROM s JOIN d ON d.doc_id = s.doc_id),
k AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, string_agg(before, '' ORDER BY g) AS kept, max(e) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
