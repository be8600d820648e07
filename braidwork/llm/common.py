"""Helpers shared by the training-data operators: shared storage, source keys, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.plans.storage import discard as discard
from braidwork.plans.storage import store as store  # shared with the core

#: ASCII white space of every word and normalisation rule here: space and the control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def source_key(name: str = "source") -> Column:
    """A non-null string for a nullable source; sorts by code point with null last."""
    return F.when(F.col(name).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(name).cast("string")))


def cells_for(rows: int) -> int:
    """Hash cells of a prefix sum: a few thousand rows a cell at any size, never fewer than 256 cells."""
    return max(256, -(-rows // 4096))


def prefix_sums(df: DataFrame, key: str, weight: str, order: list[str], rows: int, seed: int = 17) -> DataFrame:
    """Add `before` (sum of weight ahead of the row within its key) and `total` (sum of its key).

    Rows of a key are ordered by a seeded hash of `order`, then by `order`. The hash splits each key into
    cells, so that no task sorts a whole key however hot it is; a second, small table carries the sums of
    the cells ahead. Rows alike in `order` are interchangeable.
    """
    cells = cells_for(rows)
    h = F.xxhash64(F.lit(seed), *order)
    placed = df.withColumn("_h", h).withColumn("_cell", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(cells)))
    sums = placed.groupBy(key, "_cell").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(key).orderBy("_cell")
    base = sums.select(
        key,
        "_cell",
        F.coalesce(F.sum("_sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(Window.partitionBy(key)).alias("total"),
    )
    inside = Window.partitionBy(key, "_cell").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        local.join(base, [key, "_cell"])
        .withColumn("before", F.col("_base") + F.col("_local"))
        .drop("_h", "_cell", "_base", "_local")
    )


def positions(df: DataFrame, order: list[str], name: str, tag: str) -> DataFrame:
    """A stored table of df's rows with `name`, their place (from 0) by the columns of order, which tell all rows apart.

    Rows are range-partitioned by all of order, so no value of its first columns makes a large task, and numbered where
    they lie; a table of one row for each partition carries the numbers on. `_chunk` is the partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    local = F.col("_id").bitwiseAND((1 << 33) - 1)
    stored = store(ranged.withColumns({"_chunk": F.shiftright("_id", 33), "_local": local}).drop("_id"), tag)
    counts = stored.groupBy("_chunk").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_chunk", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return stored.join(F.broadcast(bases), "_chunk").withColumn(name, F.col("_base") + F.col("_local")).drop("_base", "_local")


def threshold(fraction: float) -> int:
    """The largest signed 64-bit hash of so large a part of all, fine enough for any table."""
    return max(-(1 << 63), min((1 << 63) - 1, int(min(1.0, fraction) * (1 << 64)) - (1 << 63) - 1))


def sampled(df: DataFrame, rows: int, expected: int, seed: int, *columns: str) -> DataFrame:
    """About `expected` of df's `rows` rows (all, if there are no more), chosen by a hash of these columns."""
    if expected >= rows:
        return df
    return df.where(F.xxhash64(F.lit(seed), *columns) <= F.lit(threshold(expected / rows)))


#: Bytes of an Arrow batch between the JVM and Python workers.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 64 MB, unless the session has a bound of its own: texts can be long, and a batch is held several times."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, "67108864b") in ("67108864", "67108864b", "64m"):
        spark.conf.set(setting, str(BATCH_BYTES))


#: Ids up to which a semi join broadcasts them (some 30 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def only(df: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of df whose column (null too) is among the distinct keys of `ids`, a stored table that is counted first."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keys = ids.select(F.col(key).alias("_key"))
    return df.join(F.broadcast(keys) if few else keys, F.col(column).eqNullSafe(F.col("_key")), "left_semi")


def worker_state() -> dict:
    """A dictionary that outlives single tasks of a reused Python worker."""
    import sys

    if not hasattr(sys, "_braidwork_state"):
        sys._braidwork_state = {}
    return sys._braidwork_state


class Shared:
    """A broadcast object that travels by value: workers needn't have its class on their import path."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        if "made" not in self.__dict__:
            self.made = pickle.loads(self.held.value)
        return self.made

    def __getstate__(self):
        return {"held": self.held}


def lean(function, keep: bool = False):
    """A function over Arrow batches that leaves its worker small: remembered state of other operators goes first (unless `keep`), freed memory at the end."""

    def run(batches):
        import ctypes

        import pyarrow

        if not keep:
            worker_state().clear()
        try:
            yield from function(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
