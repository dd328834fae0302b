"""MinHash near-dedup by a multi-index Hamming join.

Each distinct shingle set gets a signature of CHUNKS * WIDTH symbols of b = 16
bits. The signature is split into chunks; by pigeonhole, two signatures that
differ in at most 2 * CHUNKS - 1 symbols have a chunk with at most one error, so
the keys that leave out one symbol of a chunk bring together all such pairs.
(Beyond the guarantee a pair is still found if any chunk has at most one error:
at a similarity of 0.8 it is missed with a probability of 0.345 ** 14 < 4e-7.)

Pairs are never enumerated. The signatures of a key are linked to the least one
of them, found with map-side partials, so a key that very many share is never in
one task; the links' components are the candidate groups, and each group is
verified on its whole texts: texts of one group meet in cells of bounded size, a
group over the bound is cut into blocks and all pairs of blocks. Within a cell
words and shingles are numbered by their bytes, not by hashes, and an inverted
index gives the exact intersections of one document with all others at once;
only documents outside the largest component are looked up, and each cell
returns a spanning forest. Documents of equal sets collapse to one class before
all this: a class is named by BLAKE2 (128 bits) of its sorted distinct shingles,
a shingle by 128 bits made of its words' BLAKE2 names, and n_shingles counts
these; classes are numbered, not hashed, for the component search.

Defined cases: null or empty texts and texts without words have no shingles and
link to nothing; a text of fewer words than a shingle is one shingle; a row
that repeats a doc_id is labelled by its own set, and counts with its doc_id in
its component; rows with a null id link to nothing (component null, kept); texts
are never cut; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import SPACE, UPPER, mix, ragged_take, read, slices, spans, utf8, word_codes
from trailframe.operators.components import components
from trailframe.storage import cut

CHUNKS, WIDTH = 14, 6
SYMBOLS = CHUNKS * WIDTH
#: Shingles in one block of a candidate group, on average; a cell holds two blocks.
BLOCK_SHINGLES = 125_000
_RNG = np.random.Generator(np.random.PCG64(11))
_MUL = (_RNG.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)[:, None]
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, ragged: two independent 64-bit halves of each, and the rows' offsets.

    Words are named by 128 bits of BLAKE2, a half of a shingle by the same half of its words' names.
    """
    starts, ends, rows = spans(data, offsets, ~SPACE)
    code, first = word_codes(data, starts, ends, fold=True)
    low = UPPER[data]
    names = b"".join(blake2b(low[s:e], digest_size=16).digest() for s, e in zip(starts[first].tolist(), ends[first].tolist()))
    words = np.frombuffer(names, np.uint64).reshape(-1, 2)[code]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        n = max(1, hi - lo - size + 1) if hi > lo else 0
        halves = [np.full(n, np.uint64(min(hi - lo, size))) for _ in range(2)]
        for k in range(min(size, hi - lo)):
            halves = [mix(h * _STEP + words[lo + k : lo + k + n, i]) for i, h in enumerate(halves)]
        out.append(distinct_pairs(*halves))
    length = np.array([len(a) for a, _ in out], np.int64)
    one, two = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64) for i in range(2))
    return one, two, np.concatenate([[0], np.cumsum(length)])


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.ones(len(a), bool)
    new[1:] = ~same
    return a[new], b[new]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of each of SYMBOLS min-hashes of a set that isn't empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (short[at : at + 4096] * _MUL + _ADD).min(1), out=low)
    return low.astype("<u2")


def exact_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ragged; a shingle's number stands for its words' bytes, not for a hash."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends, rows = spans(data, offsets, ~SPACE)
    code, first_of = word_codes(data, starts, ends, fold=True)
    count = np.diff(rows)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), n)
    first = rows[:-1][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    acc = np.zeros(len(owner), np.int64)
    for j in range(size):
        inside = j < count[owner]
        word = np.where(inside, code[np.minimum(first + j, max(len(code) - 1, 0))] + 1, 0) if len(code) else acc
        acc = pd.factorize(acc * (len(first_of) + 1) + word)[0].astype(np.int64)
    total = int(acc.max(initial=0)) + 1
    owner *= total
    owner += acc
    del acc, first, code
    pairs = np.unique(owner)
    return pairs % total, np.searchsorted(pairs // total, np.arange(len(texts) + 1))


def _signed(df: DataFrame, size: int) -> DataFrame:
    """df: (k, u, t). Rows (k, u, n, a, b, sig): the set's size, its digest in two parts and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            one, two, off = shingle_sets(*utf8(part.column(2)), size)
            n = np.diff(off)
            rows = [slice(i, j) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            name = np.frombuffer(b"".join(blake2b(one[r].tobytes() + two[r].tobytes(), digest_size=16).digest() for r in rows), np.int64).reshape(-1, 2)
            marks = [signature(one[r]).tobytes() if r.stop > r.start else None for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(marks, pa.binary())], names=["k", "u", "n", "a", "b", "sig"])

    return df.mapInArrow(run, "k bigint, u bigint, n bigint, a bigint, b bigint, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each signature its keys: a chunk without one of its symbols."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
            for j in range(WIDTH):
                acc = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(j), sig.shape[:2])
                for i in range(WIDTH):
                    if i != j:
                        acc = mix(acc * _STEP + sig[:, :, i])
                out[:, :, j] = acc
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), SYMBOLS))], names=["key", "node"])


def forest(ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the graph that links sets with 100 * intersection >= percent * union."""
    n = len(ids)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(hashes, return_inverse=True)
    live = np.ones(n, bool)
    while True:  # a set with too many shingles of its own has no partner
        use = live[owner]
        df = np.bincount(code[use], minlength=int(code.max(initial=-1)) + 1)
        shared = np.bincount(owner[use], weights=df[code[use]] > 1, minlength=n)
        keep = live & (100 * shared >= percent * size)
        if keep.sum() == live.sum():
            break
        live = keep
    use = live[owner] & (df[code] > 1)
    own_code, own_doc = code[use], owner[use]
    order = np.argsort(own_code, kind="stable")
    posting = own_doc[order]
    first = np.searchsorted(own_code[order], np.arange(len(df) + 1))
    runs = np.searchsorted(own_doc, np.arange(n + 1))
    comp = np.arange(n)
    edges: list[tuple[int, int]] = []
    todo = np.flatnonzero(live)
    if len(todo):
        centre = int(todo[np.argmax(np.bincount(own_doc, weights=df[own_code], minlength=n)[todo])])
        todo = np.concatenate([[centre], todo[todo != centre]])
    done = np.zeros(n, bool)
    count = np.ones(n, np.int64)
    again = True
    while again:  # until every document outside the largest component has been looked up
        again = False
        for p in todo.tolist():
            if not done[p] and (comp[p] != count.argmax() or count[comp[p]] == 1):
                done[p] = again = True
                _link(p, own_code, runs, posting, first, size, comp, count, edges, percent)
    return edges


def _link(p, own_code, runs, posting, first, size, comp, count, edges, percent) -> None:
    docs, _ = ragged_take(posting, first, own_code[runs[p] : runs[p + 1]])
    both = np.bincount(docs, minlength=len(size))
    hit = np.flatnonzero((100 * both >= percent * (size[p] + size - both)) & (comp != comp[p]) & (both > 0))
    while len(hit):
        q = int(hit[0])
        edges.append((p, q))
        old, new = comp[q], comp[p]
        moved = comp == old
        comp[moved] = new
        count[new] += count[old]
        count[old] = 0
        hit = hit[comp[hit] != new]


def _verified(df: DataFrame, size: int, percent: int) -> DataFrame:
    """df: (c, i, j, node, t) of cells, sorted by cell and node. Rows (a, b): forest edges."""

    def solve(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        sets = exact_sets(texts, size)
        texts.clear()
        found = forest(np.array(ids), *sets, percent)
        return pa.RecordBatch.from_arrays([pa.array([ids[p] for p, _ in found], pa.int64()), pa.array([ids[q] for _, q in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, texts = None, [], []
        for batch in batches:
            for c, i, j, node, text in zip(*(batch.column(x).to_pylist() for x in range(5))):
                if (c, i, j) != cell:
                    if len(ids) > 1:
                        yield solve(ids, texts)
                    cell, ids, texts = (c, i, j), [], []
                if ids and ids[-1] == node:  # a row that repeats an id and its text
                    continue
                ids.append(node)
                texts.append(text)
        if len(ids) > 1:
            yield solve(ids, texts)

    return df.mapInArrow(run, "a bigint, b bigint")


def _cells(groups: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """The cells in which each member of a group is verified: (node, rep, ru, c, cells).

    A group has as many blocks as its shingles fill; members are dealt to them by hash.
    """
    placed = groups.join(classes.select("node", "n", "rep", "ru"), "node")
    blocks = placed.groupBy("c").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    i = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return placed.join(blocks, "c").select("node", "rep", "ru", "c", F.transform(others, lambda o: F.struct(F.least(i, o).alias("i"), F.greatest(i, o).alias("j"))).alias("cells"))


def _labelled(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, block: int) -> DataFrame:
    """Rows (k, u, n, component), one per input row; u is the text's hash."""
    spark: SparkSession = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")).select("k", F.xxhash64("t").alias("u"), "t")
    signed = cut(spark, _signed(docs, shingle), "signed")
    own = signed.where("k IS NOT NULL AND n > 0")
    least = own.groupBy("a", "b").agg(F.min(F.struct("k", "u", "n", "sig")).alias("m"))
    classes = cut(spark, least.select("a", "b", F.monotonically_increasing_id().alias("node"), F.col("m.k").alias("rep"), F.col("m.u").alias("ru"), "m.n", "m.sig"), "classes")
    keyed = classes.select("node", "sig").mapInArrow(_keys, "key bigint, node bigint")
    hubs = cut(spark, keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs")
    links = keyed.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = components(links).select("node", F.col("root").alias("c"))
    members = docs.join(_cells(groups, classes, block), (F.col("k") == F.col("rep")) & (F.col("u") == F.col("ru")))
    cells = members.select("c", F.explode("cells").alias("cell"), "node", "t").select("c", "cell.i", "cell.j", "node", "t")
    found = components(_verified(cells.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "node"), shingle, percent))
    first = found.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    component = cut(spark, found.join(first, "root").select("node", "component"), "component")
    out = signed.join(classes.select("a", "b", "node", "rep"), ["a", "b"], "left").join(component, "node", "left")
    linked = F.when((F.col("n") > 0) & F.col("k").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("k"))
    return out.select("k", "u", "n", linked.alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per input row."""
    out = _labelled(df, id_col, text_col, shingle, percent, block)
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The input rows whose document is its component's smallest id, with all their columns; a row goes by its id and text, whatever other rows have its id."""
    labels = _labelled(df, id_col, text_col, shingle, percent, block)
    gone = labels.where(~F.col("component").eqNullSafe(F.col("k"))).select(F.struct("k", "u").alias("gone")).distinct()
    row = F.struct(df[id_col].cast("long").alias("k"), F.xxhash64(df[text_col].cast("string")).alias("u"))
    marked = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), row.alias("own"))
    return marked.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.node = doc_id
"""
