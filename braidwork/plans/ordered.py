"""Positional functions over one total order, without a single task for large inputs.

Small inputs use a plain window, and so do keyed ones of which no key is large. Beyond WINDOW_BYTES (of the input's rows,
or of its largest key's) rows are range-partitioned by keys and order into chunks and written once; a function is then
computed inside each chunk and completed with what the chunks ahead carry over. That is a table of one row per chunk,
or with keys of two at most: only the keys at a chunk's ends go on in another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.plans.storage import plan_bytes, store

#: Estimated bytes up to which one task may hold a whole sequence; spark.braidwork.singleTaskBytes overrides it.
SINGLE_TASK_BYTES = 256 << 20
#: Bytes of rows, as wide as their types usually are, that one task sorts for a window; spark.braidwork.singleTaskBytes overrides it too.
WINDOW_BYTES = 64 << 20
#: Estimates up to here are believed. Files are many times smaller than their rows, so beyond it rows are counted.
BELIEVED = 4 << 20
#: Bytes of a chunk's rows as a sort holds them, about.
CHUNK_BYTES = 64 << 20
#: Bytes that a sort holds for a row beside its values: length, null bits, and a pointer and a prefix in an array that doubles.
BESIDE = 40

CHUNK = "_chunk"


def single_task_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.braidwork.singleTaskBytes", str(SINGLE_TASK_BYTES)))


#: Estimates from here on are checked by counting: the optimiser multiplies the sizes of what is joined, and knows nothing of local rows.
DOUBTFUL = 1 << 40
#: Chunks at most; beyond, they grow.
CHUNKS = 100_000


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of df's size; if that is doubtful, rows are counted and taken to be as wide as their types usually are."""
    size = plan_bytes(df)
    return size if size < DOUBTFUL else df.count() * df._jdf.schema().defaultSize()


def fits_one_task(df: DataFrame) -> bool:
    return input_bytes(df) <= single_task_bytes(df.sparkSession)


def counted_bytes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """Bytes of df's rows, of those of its most frequent key, and of all in a sort: counted rows as wide as their types usually are, or the optimiser's estimate if it is larger."""
    if keys:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        top = counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("whole")).first()
        whole, most = top["whole"] or 0, top["most"] or 0
    else:
        whole = most = df.count()
    estimate = plan_bytes(df)
    size = max(whole * df._jdf.schema().defaultSize(), estimate if estimate < DOUBTFUL else 0)
    return size, size * most // max(whole, 1), size + whole * BESIDE


class Ordered:
    def __init__(self, df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()):
        conf = df.sparkSession.conf
        most = int(conf.get("spark.braidwork.singleTaskBytes", str(WINDOW_BYTES)))
        self.order, self.keys, self.chunked, self._borders = list(order), list(keys), False, None
        self.parts = self._usual = int(conf.get("spark.sql.shuffle.partitions"))
        self._together = False
        size = largest = held = plan_bytes(df)
        if size > min(most, BELIEVED):
            size, largest, held = counted_bytes(df, self.keys)
        if largest > most:
            places = [*self.keys, *(c for c in self.order if c not in self.keys)]
            self.parts = max(self.parts, min(CHUNKS, held // CHUNK_BYTES))
            ranged = df.repartitionByRange(self.parts, *places).sortWithinPartitions(*places)
            df = store(ranged.withColumn(CHUNK, F.shiftright(F.monotonically_increasing_id(), 33).cast("int")), "ordered")
            self.chunked = True
        self.df = df

    def spread(self, df: DataFrame, *columns: str) -> DataFrame:
        """df dealt out by the columns, to as many tasks as there are chunks if that is more than usual."""
        return df.repartition(self.parts, *columns) if self.parts > self._usual else df.repartition(*columns)

    def by_chunk(self, df: DataFrame) -> DataFrame:
        """df with each chunk in a task of its own; dealt by hash, several would meet in one."""
        return df.repartitionById(self.parts, F.col(CHUNK).cast("int"))

    def _gathered(self) -> None:
        """Rows of a chunk together, for its windows; they stay so."""
        if not self._together:
            self.df, self._together = self.by_chunk(self.df), True

    def _window(self):
        by = [*([CHUNK] if self.chunked else []), *self.keys]
        return (Window.partitionBy(*by) if by else Window).orderBy(*self.order)

    def borders(self) -> DataFrame:
        """Stored rows (chunk, keys) of the keys that are in several chunks; without keys all chunks. `_span` numbers the keys, `_head` marks a key's first chunk."""
        if self._borders is None:
            key = F.struct(*self.keys) if self.keys else F.struct(F.lit(0).alias("_all"))
            ends = self.df.groupBy(CHUNK).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
            both = ends.select(CHUNK, F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_key"))
            of_key = Window.partitionBy("_key")
            several = both.withColumn("_n", F.count("*").over(of_key)).withColumn("_head", F.col(CHUNK) == F.min(CHUNK).over(of_key)).where("_n > 1" if self.keys else "true")
            numbered = several.select(CHUNK, *([f"_key.`{k}`" for k in self.keys]), (F.dense_rank().over(Window.orderBy("_key"))).cast("long").alias("_span"), "_head")  # two rows a chunk
            self._borders = store(numbered, "borders")
        return self._borders

    def at_segments(self, df: DataFrame, few: DataFrame, how: str = "left") -> DataFrame:
        """Join to df's rows what `few` (at most two rows for each chunk) says about their chunk and key."""
        small = few.withColumnsRenamed({CHUNK: "_at_chunk"} | {k: f"_at{i}" for i, k in enumerate(self.keys)})
        same = F.col(CHUNK) == F.col("_at_chunk")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_at{i}"))
        joined = df.join(F.broadcast(small), same, how)
        return joined if how == "left_semi" else joined.drop("_at_chunk", *(f"_at{i}" for i in range(len(self.keys))))

    def _carried(self, name: str, total: Column, over, default: Column | None) -> None:
        """Join to each row what `over` makes of its key's totals in the chunks ahead (or behind)."""
        going_on = self.at_segments(self.df, self.borders().drop("_span", "_head"), "left_semi") if self.keys else self.df
        sums = going_on.groupBy(CHUNK, *self.keys).agg(total.alias("_total"))
        along = (Window.partitionBy(*self.keys) if self.keys else Window).orderBy(CHUNK)
        carried = sums.select(CHUNK, *self.keys, over(F.col("_total"), along).alias(name))
        joined = self.at_segments(self.df, carried)
        self.df = joined if default is None else joined.withColumn(name, F.coalesce(name, default))

    def running(self, name: str, column: Column, how: str = "sum", inclusive: bool = True) -> Ordered:
        """Add the running sum, min, max, count or last (non-null value) of column as `name`."""
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        value = "_value"
        self.df = self.df.withColumn(value, column)
        if not self.chunked:
            self.df = self.df.withColumn(name, agg(value).over(frame)).drop(value)
            return self
        ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        if how == "last":
            total = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*self.order)))
            self._carried("_ahead", total, lambda t, w: F.last(t, ignorenulls=True).over(ahead(w)), None)
            self._gathered()
            done = F.coalesce(agg(value).over(frame), F.col("_ahead"))
        else:
            again = F.sum if how in ("sum", "count") else agg
            self._carried("_ahead", agg(value), lambda t, w: again(t).over(ahead(w)), None)
            self._gathered()
            local = agg(value).over(frame)
            done = {
                "sum": F.when(local.isNull(), F.col("_ahead")).otherwise(local + F.coalesce("_ahead", F.lit(0))),
                "count": local + F.coalesce("_ahead", F.lit(0)),
                "min": F.least(local, F.col("_ahead")),
                "max": F.greatest(local, F.col("_ahead")),
            }[how]
        self.df = self.df.withColumn(name, done).drop(value, "_ahead")
        return self

    def position(self, name: str = "_pos") -> Ordered:
        """Add the position in the order, from 0."""
        self.running(name, F.lit(1), "count", inclusive=False)
        return self

    def neighbour(self, name: str, column: Column, step: int) -> Ordered:
        """Add the value of column in the row before (step -1) or after (step 1), null at the end."""
        self.df = self.df.withColumn("_value", F.struct(column.alias("v")))
        shift = (F.lag if step < 0 else F.lead)("_value").over(self._window())
        if not self.chunked:
            self.df = self.df.withColumn(name, shift["v"]).drop("_value")
            return self
        edge = (F.max_by if step < 0 else F.min_by)("_value", F.struct(*self.order))
        self._carried("_edge", edge, lambda t, w: (F.lag if step < 0 else F.lead)(t).over(w), None)
        self._gathered()
        self.df = self.df.withColumn(name, F.coalesce(shift, F.col("_edge"))["v"]).drop("_value", "_edge")
        return self

    def frame(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.chunked else self.df
