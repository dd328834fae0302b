"""Quality classifier: random Fourier features of document statistics, ridge and isotonic calibration.

1. Statistics of each whole text: shares of byte classes, word lengths, repeats,
   lines; one short row per document.
2. Standardisation by mean and deviation of the training rows.
3. Random Fourier features approximate a Gaussian kernel.
4. Each partition sums its part of the normal equations, by fold; the sums are
   added by matrix cell in Spark, and FOLDS matrices of fixed size reach the driver.
5. Each training row is scored by the ridge weights of the other folds, and its
   score put into one of SCORE_BINS fixed bins; pooled adjacent violators over
   the bins give the isotonic map, with interpolation between its steps. The
   weights in use come from all folds.

All labelled training rows are used, in sums, so nothing is sampled.

Defined cases: null and empty texts have the statistics of an empty text and
get a score like any other; rows with a null label teach nothing; a document
with several labels teaches each; without training rows every score is 0.5;
texts are never cut; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import SPACE, read, slices, span_hashes, spans, utf8
from trailframe.storage import cut, discard

FEATURES = 192
WIDTH = 3.0
RIDGE = 1.0
SCORE_BINS = 4096
SEED = 17
#: Folds of the training rows, by a hash of their document's id, for calibration.
FOLDS = 5
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte classes as columns: lower, upper, digit, space, newline, period and comma, bar, stress, brackets, symbols, high bytes."""
    groups = [range(97, 123), range(65, 91), range(48, 58), [32, 9], [10], b".,;:'-", b"|", b"!?", b"()[]{}<>", b"*#%&$@^~_=+/\\`\"", range(128, 192), range(192, 256)]
    out = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        out[list(g), k] = 1
    return out


_CLASS = _classes()
STATISTICS = _CLASS.shape[1] + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    n = len(offsets) - 1
    starts, ends, rows = spans(data, offsets, ~SPACE)
    hashes = span_hashes(data, starts, ends, fold=True)
    size = (ends - starts).astype(float)
    first, last = data[starts], data[ends - 1]
    capital = (first >= 65) & (first <= 90)
    closing = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | (last >= 48) & (last <= 57))
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    out = np.zeros((n, STATISTICS))
    k = _CLASS.shape[1]
    for i in range(n):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        count = np.bincount(data[lo:hi], minlength=256) @ _CLASS
        out[i, :k] = np.sqrt(count / max(1, hi - lo))
        a, b = int(rows[i]), int(rows[i + 1])
        words = max(1, b - a)
        own = size[a:b]
        _, times = np.unique(hashes[a:b], return_counts=True)
        mean = own.sum() / words
        lines = count[4] + 1
        out[i, k:] = [
            np.log1p(hi - lo),
            np.log1p(b - a),
            mean,
            np.sqrt(max(0.0, (own * own).sum() / words - mean * mean)),
            np.log1p(own.max(initial=0)),
            len(times) / words,
            np.log1p(len(times)) / np.log1p(words),
            times.max(initial=0) / words,
            again[a + 1 : b].sum() / words,
            capital[a:b].sum() / words,
            closing[a:b].sum() / words,
            np.log1p((hi - lo) / lines),
            np.log1p(lines),
        ]
    return out


def document_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (k, x array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            x = statistics(*utf8(part.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["k", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t")).mapInArrow(run, f"k {kind}, x array<double>")


class Model:
    """A fitted classifier; of fixed size whatever it was fitted on."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.mean, self.deviation = mean, deviation
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.frequency = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES - 1))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights = np.zeros(FEATURES)
        self.low, self.high = 0.0, 1.0
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.sqrt(2 / (FEATURES - 1)) * np.cos(z @ self.frequency + self.phase), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def bin(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp((self.raw(x) - self.low) / (self.high - self.low) * SCORE_BINS, self.knots, self.levels)


def pool_violators(value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: level of each block and the number of entries in it."""
    level: list[float] = []
    mass: list[float] = []
    size: list[int] = []
    for v, w in zip(value, weight):
        level.append(v)
        mass.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            v1, w1, n1 = level.pop(), mass.pop(), size.pop()
            level[-1] = (level[-1] * mass[-1] + v1 * w1) / (mass[-1] + w1)
            mass[-1] += w1
            size[-1] += n1
    return np.array(level), np.array(size)


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def fit(train: DataFrame) -> Model:
    """train: (x array<double>, y double, f int below FOLDS), read four times."""
    spark: SparkSession = train.sparkSession
    cells = [F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s")) for i in range(STATISTICS)]
    got = train.agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(cells))).first()
    if not got["n"]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    spread = np.array([got[f"c{i}"]["s"] for i in range(STATISTICS)])
    model = Model(np.array([got[f"c{i}"]["m"] for i in range(STATISTICS)]), np.where(spread > 1e-9, spread, 1.0))
    shared = spark.sparkContext.broadcast(model)
    upper = np.triu_indices(FEATURES + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = np.concatenate([shared.value.expand(_rows(part, 0)), np.asarray(part.column(1))[:, None]], 1)
                fold = np.asarray(part.column(2))
                for f in np.unique(fold).tolist():
                    total[f] += z[fold == f].T @ z[fold == f]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), f)), pa.array(np.arange(len(upper[0]))), pa.array(total[f][upper])], names=["f", "cell", "v"])

    summed = train.select("x", "y", "f").mapInArrow(equations, "f bigint, cell bigint, v double").groupBy("f", "cell").agg(F.sum("v").alias("v")).collect()
    full = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1))
    fold, at = (np.array([r[c] for r in summed]) for c in ("f", "cell"))
    full[fold, upper[0][at], upper[1][at]] = [r["v"] for r in summed]
    full = np.triu(full) + np.triu(full, 1).transpose(0, 2, 1)

    def ridge(equations: np.ndarray) -> np.ndarray:
        return np.linalg.solve(equations[:FEATURES, :FEATURES] + RIDGE * np.eye(FEATURES), equations[:FEATURES, FEATURES])

    model.weights = ridge(full.sum(0))
    model.low, model.high = -0.5, 1.5
    fitted = spark.sparkContext.broadcast((model, np.array([ridge(full.sum(0) - own) for own in full])))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, others = fitted.value
        n, s = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = model.bin((model.expand(_rows(part, 0)) * others[np.asarray(part.column(2))]).sum(1))
                n += np.bincount(own, minlength=SCORE_BINS)
                s += np.bincount(own, weights=np.asarray(part.column(1)), minlength=SCORE_BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], names=["bin", "n", "s"])

    counts = train.select("x", "y", "f").mapInArrow(bins, "bin bigint, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()
    bin_, n, s = (np.array([r[c] for r in counts], float) for c in ("bin", "n", "s"))
    level, size = pool_violators(s / n, n)
    end = np.cumsum(size)
    left, right = bin_[end - size], bin_[end - 1]
    model.knots = np.stack([left + 0.25, right + 0.75], 1).reshape(-1)
    model.levels = np.repeat(level, 2)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Rows (k, score) of rows (k, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(shared.value.score(_rows(batch, 1)), 0, 1))], names=["k", "score"])

    return stats.select("k", "x").mapInArrow(run, f"k {stats.schema['k'].dataType.simpleString()}, score double")


def keep_scored(df: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores the threshold or more, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            good = shared.value.score(statistics(*utf8(part.column(part.schema.get_field_index(text_col))))) >= threshold
            yield part.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn_quality(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on the statistics (k, x) of documents whose labels aren't held out."""
    known = labels.select(labels[label_id].alias("j"), labels[label_col].cast("double").alias("y")).where(~held_out("j") & F.col("y").isNotNull())
    fold = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(FOLDS)).cast("int").alias("f")
    train = cut(stats.sparkSession, stats.join(known, F.col("k") == F.col("j")).select("x", "y", fold), "train")
    model = fit(train)
    discard(train)
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (id, score), one per input row; learns from labels whose id isn't held out."""
    stats = cut(df.sparkSession, document_statistics(df, id_col, text_col), "statistics")
    model = learn_quality(stats, labels, label_id, label_col)
    return score(stats, model).withColumnRenamed("k", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
