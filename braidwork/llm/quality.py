"""Quality classifier: random Fourier features, ridge regression by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import Shared, bounded_batches, lean, store, text_or_empty, sampled
from braidwork.llm.textbytes import Rolling, bytes_of, parts, words

#: Labelled rows the fit reads (expected number; chosen by a hash of doc_id).
TRAIN_ROWS = 40_000
FEATURES, RIDGE, SEED = 384, 1e-3, 8
#: Calibration works on the counts and positives of this many equal bins of the ridge score.
BINS, LOW, HIGH = 2000, -0.5, 1.5
THRESHOLD = 0.3
STATISTICS = 24


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between one start and the next."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def repeats(keys: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the weight of keys seen before in it, and the weight of its heaviest key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o, w = keys[order], owner[order], weight[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    again = np.bincount(o, weights=w * ~new, minlength=n)
    at = np.flatnonzero(new)
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, o[at], np.add.reduceat(w, at))
    return again, heaviest


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """STATISTICS numbers of each text, all defined for empty ones: sizes, kinds of characters, words and their repetition, lines."""
    n, size = len(starts) - 1, np.diff(starts).astype(float)
    part = lambda a, b: a / np.maximum(b, 1.0)
    kind = lambda chars: per_text(np.isin(data, np.frombuffer(chars, dtype=np.uint8)), starts)
    upper, lower = per_text((data >= 65) & (data <= 90), starts), per_text((data >= 97) & (data <= 122), starts)
    digit, high = per_text((data >= 48) & (data <= 57), starts), per_text(data >= 128, starts)
    begin, end, first = words(data, starts)
    count = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (end - begin).astype(float)
    rolling = Rolling(data)
    keys = rolling.of(begin, end)
    again, heaviest = repeats(keys, owner, np.ones(len(keys)), n)
    same = np.zeros(len(keys))
    same[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    tail = np.isin(data[np.maximum(end - 1, 0)], np.frombuffer(b"!*#%$&|@~^", dtype=np.uint8)) if len(end) else np.zeros(0)
    shouted = ((data[begin] >= 65) & (data[begin] <= 90) & (length > 1) & (data[np.minimum(begin + 1, len(data) - 1)] <= 90)) if len(begin) else np.zeros(0)
    breaks = data == 10
    line_begin = np.unique(np.concatenate([starts[:-1], np.flatnonzero(breaks) + 1]).clip(max=len(data)))
    line_begin = line_begin[line_begin < len(data)]
    line_end = np.append(line_begin[1:], len(data))
    line_owner = np.searchsorted(starts, line_begin, side="right") - 1
    line_size = (line_end - line_begin).astype(float)
    line_keys = rolling.of(line_begin, line_end)
    line_again, line_most = repeats(line_keys, line_owner, line_size, n)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    pairs = np.zeros(len(keys), dtype=np.uint64)
    pairs[1:] = keys[1:] * np.uint64(3) + keys[:-1]
    pair_again, _ = repeats(pairs, owner, np.ones(len(keys)), n)
    by_word = lambda v: np.bincount(owner, weights=v, minlength=n)
    letters = upper + lower + high
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), part(size, count), part(size, lines),
        part(upper, letters), part(digit, size), part(high, size), part(kind(b" \n\t\r"), size), part(kind(b".,;:'\"()-"), size),
        part(kind(b"!?"), size), part(kind(b"*#$%&@^~"), size), part(kind(b"|<>{}[]=_/\\"), size), part(letters, size),
        part(again, count), part(heaviest, count), part(by_word(same), count), part(pair_again, count),
        part(by_word(tail), count), part(by_word(shouted), count), part(line_again, size), part(line_most, size),
        np.sqrt(np.maximum(part(by_word(length**2), count) - part(by_word(length), count) ** 2, 0)), part(by_word(length >= 12), count),
    ])


def described(docs: DataFrame) -> DataFrame:
    """Stored rows (doc_id, stats): the statistics of every whole text, made in one pass."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            for piece in parts(batch, 1):
                values = statistics(*bytes_of(piece.column(1)))
                flat = pa.array(np.ascontiguousarray(values, dtype=np.float32).ravel())
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * STATISTICS)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "stats"])

    return store(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(measure), f"doc_id {id_type}, stats array<float>"), "quality-statistics")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


class QualityModel:
    """Standardised statistics -> random Fourier features -> ridge score -> isotonic steps."""

    def __init__(self, mean, spread):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = np.asarray(mean), np.maximum(np.asarray(spread), 1e-6)
        #: Half the directions for a narrow and half for a wide Gaussian kernel.
        width = np.where(np.arange(FEATURES) % 2, 0.5, 0.15)
        self.directions = rng.normal(size=(len(self.mean), FEATURES)) * width
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = None
        self.levels = np.linspace(0, 1, BINS)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z / 10, np.ones((len(z), 1))])

    def bins(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[self.bins(stats)]


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rising levels for all bins by pooling adjacent violators; bins without rows lie on the line between their neighbours."""
    at = np.flatnonzero(count)
    blocks: list[list[float]] = []
    for i in at:
        blocks.append([positive[i], count[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + c, blocks[-1][2] + k]
    #: One pseudo-row of each kind keeps levels off 0 and 1.
    levels = np.concatenate([np.full(k, (p + 0.5) / (c + 1)) for p, c, k in blocks])
    return np.interp(np.arange(len(count)), at, np.maximum.accumulate(levels))


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """A model from labelled rows that are not held out; None without any.

    About `train_rows` labelled rows, chosen by hash, are read. Each partition sums its normal equations;
    the sums, one row of the matrix a record, meet on the executors, and only the matrix reaches the driver.
    """
    learn = labels.where("quality IS NOT NULL AND pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) != 0").select("doc_id", "quality").distinct()
    rows = learn.count()
    if not rows:
        return None
    chosen = sampled(learn, rows, train_rows, SEED, "doc_id")
    train = store(stats.join(chosen, "doc_id").select("stats", F.col("quality").cast("double").alias("y")), "quality-training")
    spark = stats.sparkSession

    def moments(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            one = np.vstack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x**2).sum(axis=0)])
            total = one if total is None else total + one
        if total is not None:
            yield from summed_rows(total)

    def summed_rows(rows):
        flat = pa.array(np.ascontiguousarray(rows).ravel())
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.ListArray.from_arrays(ends, flat)], names=["i", "row"])

    def summed(partials: DataFrame) -> np.ndarray:
        places = partials.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        found = places.toPandas()
        if found.empty:
            return np.zeros((0, 0))
        out = np.zeros((found["i"].max() + 1, found["j"].max() + 1))
        out[found["i"], found["j"]] = found["v"]
        return out

    schema = "i int, row array<double>"
    first = summed(train.select("stats").mapInArrow(lean(moments), schema))
    if not first.size:
        return None
    mean = first[1] / first[0]
    model = QualityModel(mean, np.sqrt(np.maximum(first[2] / first[0] - mean**2, 0)))
    shared = Shared(spark, model)

    def normal(batches):
        total = None
        for batch in batches:
            x = shared.value.features(matrix(batch.column(0)))
            xy = np.hstack([x.T @ x, (x.T @ np.asarray(batch.column(1)))[:, None]])
            total = xy if total is None else total + xy
        if total is not None:
            yield from summed_rows(total)

    # Few partitions: each sends a whole matrix, and the training rows are bounded.
    equations = summed(train.coalesce(8).mapInArrow(lean(normal), schema))
    a, b = equations[:, :-1], equations[:, -1]
    model.weights = np.linalg.solve(a + RIDGE * a[-1, -1] / FEATURES * np.eye(len(a)), b)
    fitted = Shared(spark, model)

    def histogram(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            at, y = fitted.value.bins(matrix(batch.column(0))), np.asarray(batch.column(1))
            total += np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])
        yield from summed_rows(total)

    held = summed(train.coalesce(8).mapInArrow(lean(histogram), schema))
    model.levels = isotonic(held[0], held[1])
    return model


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the calibrated probability of quality 1 given only the statistics of the whole text; empty and
    null texts have statistics too. Without a labelled row to learn from every score is 0.5. Repeated rows get
    equal scores, null ids count as the empty string in the split, labels of unknown documents or without
    quality are ignored, and an empty table gives no row.
    """
    stats = described(docs)
    shared = Shared(docs.sparkSession, fit(stats, labels, train_rows))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                values = np.full(len(x), 0.5) if shared.value is None else shared.value.scores(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    found = stats.mapInArrow(lean(scored), f"doc_id {id_type}, score double")
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
