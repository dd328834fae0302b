"""Spelling variants: words that differ by one code point, by rolling-hash deletions.

1. **Counts.** Runs of letters are found, folded and counted in numpy, a slice of
   texts at a time; only a slice's distinct words leave a task.
2. **Deletion keys.** A word's code points are summed with the powers of a base,
   so a prefix sum and the rest of the sum, divided by the base, give the hash of
   the word without any one of them. A word has a key for itself, one for each
   deletion (one of several that give the same string), and one for each
   deletion and its place: words that differ by a replacement share the latter,
   a word and its deletion the former.
3. **Radix partitions.** Keys are dealt by their high bits and sorted; a key that
   only one word has goes no further, so what follows grows with the near words.
4. **Verification.** The words of the shared keys are joined, and the strings
   themselves, not the hashes, decide. All words of a verified key are near each
   other (a replacement), or all near one (a deletion), so each gets a count and
   the best of the others; pairs are never made, and a key is as large as the
   alphabet (times the length, for deletions) at most.
5. **Forms and roots.** A word's best near word is its form if it is `ratio` times
   as frequent; chains of forms, which grow by that factor with each step, are
   followed by pointer doubling.

Defined cases: a null text has no words; a null id counts as an empty one;
repeated rows count each; texts and words are never cut; an empty table gives an
empty result; other columns are ignored, whatever their names; ties of frequency
go to the word that is smaller by code points.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import UPPER, binary_slices, mask_spans, mix, pack, ragged_take, read, slices, utf8, word_codes
from trailframe.storage import cut

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FULL, _DELETED, _REPLACED = 0, 1, 2
#: A key's partition is its this many high bits.
RADIX_BITS = 16


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span after what `before` is the CRC-32 of, a byte of all spans a round."""
    out = ~before.astype(np.uint32)
    size = ends - starts
    short = np.flatnonzero(size <= 64)
    order = short[np.argsort(-size[short], kind="stable")]
    alive = np.searchsorted(-size[order], -np.arange(1, 65), "right")
    for j, n in enumerate(alive.tolist()):
        if not n:
            break
        at = order[:n]
        state = out[at]
        out[at] = _CRC[(state ^ data[starts[at] + j]) & 255] ^ (state >> 8)
    out = ~out
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 all that begin with C3): starts, ends, rows, code points."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    low = data | 0x20
    starts, ends, runs = mask_spans((low >= 0x61) & (low <= 0x7A) & (data < 0x80) | lead | tail, offsets)
    tails = np.concatenate([[0], np.cumsum(tail)])
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(runs)), ends - starts - (tails[ends] - tails[starts])


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip_every: int | None = None) -> DataFrame:
    """Rows (word, n) of the words with `min_chars` code points and `min_count` occurrences at least.

    slip_every: an occurrence loses the code point h % length if this divides h, the CRC-32 of `<id>:<word>`; that plants
    misspellings the same way on any machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            data, offsets = utf8(part.column(1))
            data = UPPER[data]
            starts, ends, row, chars = letter_runs(data, offsets)
            use = chars >= min_chars
            starts, ends, row, chars = starts[use], ends[use], row[use], chars[use]
            words: list[str] = []
            if slip_every:
                before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column(0).to_pylist()], np.uint32)
                h = crc32_spans(data, starts, ends, before[row])
                slip = h % slip_every == 0
                for i in np.flatnonzero(slip).tolist():
                    word, at = data[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(chars[i])
                    words.append(word[:at] + word[at + 1 :])
                words = [w for w in words if len(w) >= min_chars]
                starts, ends = starts[~slip], ends[~slip]
            code, first = word_codes(data, starts, ends)
            flat, cuts = ragged_take(data, np.stack([starts[first], ends[first]], 1).reshape(-1), 2 * np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([pack(flat, cuts, pa.large_string()).cast(pa.string()), pa.array(np.bincount(code, minlength=len(first)))], names=["word", "n"])
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.ones(len(words), np.int64))], names=["word", "n"])

    rows = df.select(df[id_col].cast("long").alias("i"), df[text_col].cast("string").alias("t"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, word, kind and place of each word itself, of its distinct deletions, and of its deletions by place."""
    size = np.array([len(w) for w in words], np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - start[word]
    power = np.full(int(size.max()), _BASE & ((1 << 64) - 1), np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + _STEP) * power[place])])
    total = sums[start + size] - sums[start]
    prefix = sums[:-1] - sums[start][word]
    suffix = (sums[start + size][word] - sums[1:]) * _INVERSE
    named = lambda h, n: mix(h * _STEP + n.astype(np.uint64))
    gone = named(prefix + suffix, size[word] - 1)
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    placed = mix(gone + (place.astype(np.uint64) + np.uint64(1)) * _STEP)
    kinds = np.repeat([_FULL, _DELETED, _REPLACED], [len(words), first.sum(), len(points)])
    return np.concatenate([named(total, size), gone[first], placed]), np.concatenate([np.arange(len(words)), word[first], word]), kinds, np.concatenate([np.zeros(len(words), np.int64), place[first], place])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in binary_slices(batches, 1, 1 << 18):
        key, word, kind, place = deletion_keys(part.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(word)), pa.array(kind.astype(np.int8)), pa.array(place.astype(np.int32))], names=["key", "id", "kind", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, kind, place) sorted by key those of the keys that several words have."""
    held = None
    names = ["key", "id", "kind", "place"]
    for batch in batches:
        own = [np.asarray(batch.column(i)) for i in range(4)]
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own)]
        key = own[0]
        if not len(key):
            continue
        open_ = int(np.searchsorted(key, key[-1], "left"))
        held = [x[open_:] for x in own]
        if open_:
            yield _several([x[:open_] for x in own], names)
    if held is not None:
        yield _several(held, names)


def _several(own: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    key, ids = own[:2]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mixed = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    use = np.repeat(mixed, np.diff(np.append(first, len(key))))
    return pa.RecordBatch.from_arrays([pa.array(x[use]) for x in own], names=names)


def near_of(members: list[tuple]) -> Iterator[tuple]:
    """members: (id, word, n, kind, place) of one key. (id, near words, n and word and id of the best) for those that have any by their strings."""
    groups: dict[tuple, list[tuple]] = defaultdict(list)
    for i, word, n, kind, place in members:
        rest = word if kind == _FULL else word[:place] + word[place + 1 :]
        groups[(place if kind == _REPLACED else -1, rest)].append((-n, word, i, kind))
    for (place, _), own in groups.items():
        if place >= 0 and len(own) > 1:
            best, second = sorted(own)[:2]
            for x in own:
                top = second if x is best else best
                yield x[2], len(own) - 1, -top[0], top[1], top[2]
        elif place < 0:
            full = [x for x in own if x[3] == _FULL]
            longer = [x for x in own if x[3] == _DELETED]
            if full and longer:
                best = min(longer)
                yield full[0][2], len(longer), -best[0], best[1], best[2]
                for x in longer:
                    yield x[2], 1, -full[0][0], full[0][1], full[0][2]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, word, n, kind, place), sorted by key, to (id, near, n, word, form): see `near_of`."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "near", "n", "word", "form"])

    key, members, rows = None, [], []
    for batch in batches:
        for k, *member in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if k != key:
                rows += near_of(members)
                key, members = k, []
            members.append(tuple(member))
        yield out(rows)
        rows = []
    yield out([*near_of(members)])


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: (word, n), a word once. Rows (word, form, root, n, n_near, form_n)."""
    spark = words.sparkSession
    known = cut(spark, words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    keys = known.select("id", "word").mapInArrow(_keys, "key bigint, id bigint, kind tinyint, place int")
    dealt = keys.repartition(F.shiftright("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    shared = dealt.mapInArrow(_shared, "key bigint, id bigint, kind tinyint, place int")
    met = shared.join(known, "id").select("key", "id", "word", "n", "kind", "place").repartition("key").sortWithinPartitions("key")
    found = met.mapInArrow(_verified, "id bigint, near bigint, n bigint, word string, form bigint")
    best = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "word", "form")).alias("best"))
    named = best.select("id", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.word").alias("form"), F.col("best.form").alias("form_id"))
    near = cut(spark, known.join(named, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n", "form_id"))), "near")
    roots = cut(spark, near.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root")), "roots")
    while True:  # twice as far in each round
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = cut(spark, roots.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = after.select("id", "root")
        if after.where("moved").isEmpty():
            break
    ends = roots.join(known.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    return near.join(ends, "id", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents"), slip_every=199))


SQL = """
WITH RECURSIVE b AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM b WHERE k = 8),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
q AS (SELECT w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM o GROUP BY id, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda j: CAST('0x' || substring(x, 2 * j + 1, 2) AS BIGINT))), lambda c, y: xor(c // 256, crc[1 + xor(c, y) % 256]))) AS h FROM q, crc),
u AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM u WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
r AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, c.word AS other FROM r a JOIN r c ON a.rest = c.rest AND a.i = c.i AND a.word <> c.word UNION SELECT word, rest FROM r WHERE rest IN (SELECT word FROM v) UNION SELECT rest, word FROM r WHERE rest IN (SELECT word FROM v)),
t AS (SELECT p.word, other, v.n AS form_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, other) AS best FROM p JOIN v ON v.word = other),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN other END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN t ON t.word = v.word AND best = 1),
e AS (SELECT word, word AS root FROM f UNION ALL SELECT e.word, f.form FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word JOIN f AS last ON last.word = e.root AND last.form IS NULL
"""
