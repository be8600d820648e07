"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations on the driver, projection by tasks.

Vectors are put on an integer grid first, so counts, sums and deviations are exact at any size and in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from braidwork.llm.common import Shared, bounded_batches, discard, lean, store

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no long on the grid; vectors that hold one take no part.
LARGEST = float(1 << 56)
COMPONENTS = 16
SWEEPS = 60


def on_grid(column: str) -> Column:
    """floor(64 * c) + 1000000 of each entry; null for a vector that is null or holds a null, non-finite or huge entry."""
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(F.col(column).isNotNull() & sound, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)))


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the largest entry of each is positive) of a symmetric matrix.

    Sweeps over all pairs (p, q) rotate until each off-diagonal entry is below the rounding error of its two
    diagonal entries, which keeps small eigenvalues accurate to their own size and not to the largest one's.
    """
    a, n = matrix.astype(float), len(matrix)
    v, eps = np.eye(n), np.finfo(float).eps
    least = eps * eps * abs(np.trace(a))
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if abs(off) <= max(least, eps * np.sqrt(max(a[p, p], 0) * max(a[q, q], 0))):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for x in (a, a.T, v.T):  # rows, columns, eigenvectors
                    x[p], x[q] = c * x[p] - s * x[q], s * x[p] + c * x[q]
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0) if n else v


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def summed(rows: DataFrame, cells: int, per_partition) -> np.ndarray:
    """The sum over partitions of what per_partition makes of a partition's batches: `cells` doubles, sent cell by cell."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        found = per_partition(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(found)], names=["cell", "value"])

    parts = rows.mapInArrow(lean(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(cells)
    for row in parts.toLocalIterator():
        total[row["cell"]] = row["value"]
    return total


def products(rows: DataFrame, width: int, of_batch) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows that of_batch makes of each batch (`width` columns), and of their outer products."""
    upper = np.triu_indices(width)

    def per_partition(batches):
        sums, scatter = np.zeros(width), None
        for batch in batches:
            d = of_batch(batch)
            sums += d.sum(axis=0)
            scatter = d.T @ d if scatter is None else scatter + d.T @ d
        return None if scatter is None else np.concatenate([sums, scatter[upper]])

    total = summed(rows, width + len(upper[0]), per_partition)
    scatter = np.zeros((width, width))
    scatter[upper] = total[width:]
    return total[:width], scatter + np.triu(scatter, 1).T


@dataclass
class Whitening:
    """n distinct grid vectors; their exact mean is whole + rest / n. Rows of `projection` that belong to no variance are null in results."""

    column: str
    width: int
    n: int
    whole: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def kept(self) -> int:
        return min(COMPONENTS, self.width)

    @property
    def explained(self) -> list[float | None]:
        return [float(max(e, 0.0) / self.trace) if self.trace > 0 else None for e in self.values[: self.kept]]

    @property
    def varying(self) -> np.ndarray:
        """Components with more variance than rounding leaves."""
        return self.values[: self.kept] > max(self.values.max(initial=0), 0) * self.width * np.finfo(float).eps

    @property
    def projection(self) -> np.ndarray:
        scale = np.where(self.varying, np.sqrt(np.where(self.varying, self.values[: self.kept], 1)), 1)
        return np.where(self.varying, self.vectors[:, : self.kept] / scale, 0)

    def apply(self, df: DataFrame) -> DataFrame:
        """df's rows whose vector takes part, with `deviation` (long: squared distance from the mean, times n squared; null
        where it is too large for a long) and `whitened` (array of double; null for a component without variance)."""
        bounded_batches(df.sparkSession)
        rows = df.drop("deviation", "whitened").withColumn("_x", on_grid(self.column)).where(F.col("_x").isNotNull() & (F.size("_x") == self.width))
        out = StructType([*rows.drop("_x").schema.fields, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
        shared = Shared(df.sparkSession, (self.width, self.n, self.whole, self.rest, self.projection, self.varying))

        def run(batches):
            width, n, whole, rest, projection, varying = shared.value
            for batch in batches:
                x = matrix_of(batch.column(batch.num_columns - 1), width)
                made = centred(x, n, whole, rest) @ projection
                holes = np.tile(~varying, len(x))
                ends = np.arange(len(x) + 1, dtype=np.int32) * len(varying)
                whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel(), mask=holes))
                columns = [*batch.columns[:-1], deviations(x, n, whole, rest), whitened]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

        return rows.mapInArrow(lean(run), out)


def centred(x: np.ndarray, n: int, whole: list[int], rest: list[int]) -> np.ndarray:
    return (x - np.array(whole, dtype=np.int64)) - np.array([r / n for r in rest], dtype=float)


def deviations(x: np.ndarray, n: int, whole: list[int], rest: list[int]) -> pa.Array:
    """Per row, the sum of (n * x - S) squared, in integers."""
    off = x - np.array(whole, dtype=np.int64)
    rough = (np.abs(off).astype(float) + 1) * n
    small = (rough**2).sum(axis=1) < 2.0**62
    num = np.where(small[:, None], off, 0) * np.int64(n if n < 1 << 62 else 0) - np.array(rest, dtype=np.int64)
    out = (np.where(small[:, None], num, 0) ** 2).sum(axis=1)
    exact = [None if small[i] else sum((n * int(c) - r) ** 2 for c, r in zip(off[i], rest, strict=True)) for i in range(len(x))] if not small.all() else None
    if exact is None:
        return pa.array(out)
    return pa.array([int(out[i]) if small[i] else (v if v < 1 << 63 else None) for i, v in enumerate(exact)], type=pa.int64())


def fit(embeddings: DataFrame, column: str = "embedding") -> Whitening:
    """Whitening of the distinct grid vectors of `embeddings`, each counted once.

    Vectors that are null or hold null, NaN, infinite or huge (2^56 and more) entries take no part, nor do those of
    another length than most have (of lengths equally frequent, the largest). An empty table, or one of empty
    vectors, gives a model of width 0. Copies meet in the partial aggregation before the shuffle. Three passes over
    the distinct vectors give sums, centred scatter and the covariance of the whitened result; what reaches the
    driver is the square of the width (some thousands of numbers), however many rows there are.
    """
    grid = embeddings.select(on_grid(column).alias("x")).where("x IS NOT NULL")
    lengths = grid.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    if not width:
        return Whitening(column, 0, 0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0)
    distinct = store(grid.where(F.size("x") == width).distinct(), "whitening-fit")

    def sums(batches):
        high, low, rows = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            x = matrix_of(batch.column(0), width)
            high += (x >> 31).sum(axis=0)
            low += (x & ((1 << 31) - 1)).sum(axis=0)
            rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array(np.full(width, rows))], names=["i", "high", "low", "rows"])

    def decimal(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(20,0)")).alias(name)

    total = [0] * width
    for row in distinct.mapInArrow(lean(sums), "i long, high long, low long, rows long").groupBy("i").agg(decimal("high"), decimal("low"), F.sum("rows").alias("rows")).collect():
        total[row["i"]], n = (int(row["high"]) << 31) + int(row["low"]), row["rows"]
    whole, rest = [s // n for s in total], [s % n for s in total]
    _, scatter = products(distinct, width, lambda batch: centred(matrix_of(batch.column(0), width), n, whole, rest))
    values, vectors = jacobi(scatter / n)
    model = Whitening(column, width, n, whole, rest, values, vectors, float(np.trace(scatter / n)))
    projection, varying = model.projection, model.varying
    if varying.any():
        shared = Shared(embeddings.sparkSession, projection[:, varying])
        mean, second = products(distinct, int(varying.sum()), lambda batch: centred(matrix_of(batch.column(0), width), n, whole, rest) @ shared.value)
        covariance = second / n - np.outer(mean / n, mean / n)
        model.identity_error = float(np.abs(covariance - np.eye(len(mean))).max())
    discard(distinct)
    return model


def components(embeddings: DataFrame, model: Whitening, id_column: str = "vec_id") -> DataFrame:
    """A row for each vector that takes part and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = model.apply(embeddings.select(id_column, model.column))
    number = lambda x: F.lit(x).cast("double")
    explained = F.array(*map(number, model.explained)) if model.kept else F.array().cast("array<double>")
    long = rows.select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        id_column,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        number(model.identity_error).alias("identity_error"),
    )
