"""Buffers and windows: rows get a `window_id`; a buffer is its non-empty windows, aggregated or collected."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.plans.gates import carried, opened

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


#: Numbers that one row is made into at a time.
SPINE = 10_000


def numbers_to(df: DataFrame, most: str, name: str) -> DataFrame:
    """df's rows once for each of 0 .. `most`: first for blocks of SPINE numbers, which are dealt out, then for the numbers in a block, so no
    array holds more than SPINE of 10^8 numbers."""
    blocks = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"`{most}` div {SPINE}"))).alias("_block"))
    spread = blocks.repartition("_block")
    low = F.col("_block") * SPINE
    numbers = F.sequence(low, F.least(F.col(most), low + (SPINE - 1)))
    return spread.select("*", F.explode(numbers).alias(name)).drop("_block", most)


class OpenWindows:
    """Windows of so many rows and so long, one open at any time. `state`: when it began and how many rows it has; `moved`: its number."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.state, self.moved = size, limit, None, 0

    def step(self, at: int | None) -> int:
        start, n = self.state or (at or 0, 0)
        at = start if at is None else at  # a row without a time joins the window that is open
        gone = max(0, at - start) // self.limit
        if gone:
            start, n = start + gone * self.limit, 0
        mine = self.moved = self.moved + gone
        n += 1
        if n >= self.size:
            self.moved, start, n = mine + 1, at, 0
        self.state = start, n
        return mine


class Windows:
    # By count.

    def window(self: Seq, size: int, skip: int | None = None) -> Seq:
        """Windows of `size` rows, one beginning every `skip` rows; with size > skip a row is in several, with size < skip some are in none."""
        skip = skip or size
        frame = self.ordered().position("_pos").frame()
        last = F.expr(f"_pos div {skip}")
        first = F.greatest(F.lit(0).cast("long"), F.expr(f"(_pos - {size} + {skip}) div {skip}"))
        if size <= skip:
            df = frame.withColumn("window_id", last).where(F.col("_pos") - F.col("window_id") * skip < size)
        else:
            df = frame.withColumn("window_id", F.explode(F.sequence(first, last)))
        return self.with_df(df.drop("_pos"), ["window_id", *self.order])

    def buffer(self: Seq, size: int, skip: int | None = None, *columns: Column) -> Seq:
        return self.window(size, skip).per_window(*columns)

    def per_window(self: Seq, *columns: Column) -> Seq:
        """One row for each window: its number of rows, or these aggregates."""
        df = self.df.groupBy(*self.keys, "window_id").agg(*(columns or [F.count("*").alias("n")]))
        return self.with_df(df, [*self.keys, "window_id"], ts=None)

    def collect_windows(self: Seq, column: Column, name: str = "values") -> Seq:
        places = [c for c in self.order if c != "window_id"]
        items = F.sort_array(F.collect_list(F.struct(*places, column.alias("_v"))))
        return self.per_window(F.transform(items, lambda x: x["_v"]).alias(name))

    # By predicate or change.

    def window_until(self: Seq, predicate: Column, cut_before: bool = False) -> Seq:
        """A window ends with the row where the predicate holds (or a new one begins with it)."""
        hit = F.when(predicate, 1).otherwise(0)
        frame = self.ordered().running("window_id", hit, "sum", inclusive=cut_before).frame()
        df = frame.withColumn("window_id", F.coalesce("window_id", F.lit(0)).cast("long"))
        return self.with_df(df, ["window_id", *self.order])

    def buffer_until(self: Seq, predicate: Column, cut_before: bool = False, columns: list[Column] = ()) -> Seq:
        return self.window_until(predicate, cut_before).per_window(*columns)

    def window_until_counts(self: Seq, predicate: Column, cut_before: bool = False) -> Seq:
        """window_id and n of all windows; with cut_before and a first row that triggers, also the empty window before it."""
        counts = self.window_until(predicate, cut_before).per_window()
        if not cut_before:
            return counts
        missing = counts.df.groupBy(*self.keys).agg(F.min("window_id").alias("_first")).where("_first > 0")
        empty = missing.select(*self.keys, F.lit(0).cast("long").alias("window_id"), F.lit(0).cast("long").alias("n"))
        return self.with_df(counts.df.unionByName(empty), counts.order, ts=None)

    def window_until_changed(self: Seq, key: Column) -> Seq:
        """A window ends where the key differs from the row before."""
        frame = self.ordered().neighbour("_last", key, -1).neighbour("_any", F.lit(1), -1)
        frame.df = frame.df.withColumn("_new", F.when(F.col("_any").isNotNull() & ~key.eqNullSafe(F.col("_last")), 1).otherwise(0))
        df = frame.running("window_id", F.col("_new"), "sum").frame().drop("_last", "_any", "_new")
        return self.with_df(df, ["window_id", *self.order])

    def buffer_until_changed(self: Seq, key: Column, columns: list[Column] = ()) -> Seq:
        return self.window_until_changed(key).per_window(*columns)

    def window_while(self: Seq, predicate: Column) -> Seq:
        """Runs of rows where the predicate holds; other rows part them and are marked by matched = false."""
        miss = F.when(predicate, 0).otherwise(1)
        frame = self.ordered().running("window_id", miss, "sum", inclusive=False).frame()
        df = frame.withColumns({"window_id": F.coalesce("window_id", F.lit(0)).cast("long"), "matched": F.coalesce(predicate, F.lit(False))})
        return self.with_df(df, ["window_id", *self.order])

    def window_while_counts(self: Seq, predicate: Column) -> Seq:
        """window_id and n: separators that lead or follow each other give empty windows, a last one none."""
        return self.window_while(predicate).per_window(F.sum(F.col("matched").cast("long")).alias("n"))

    def buffer_while(self: Seq, predicate: Column, columns: list[Column] = ()) -> Seq:
        runs = self.window_while(predicate)
        return runs.with_df(runs.df.where("matched").drop("matched")).per_window(*columns)

    # By time.

    def window_time(self: Seq, length: float, every: float | None = None, origin: int | None = None) -> Seq:
        """Windows of `length` seconds, one beginning every so many; the first begins at `origin` (microseconds), by default the first row."""
        size, step = round(length * 1e6), round((every or length) * 1e6)
        if origin is None:
            starts = self.df.groupBy(*self.keys).agg(F.min(self.micros()).alias("_t0"))
            df = self.df.join(starts, self.keys) if self.keys else self.df.crossJoin(F.broadcast(starts))  # one row
        else:
            df = self.df.withColumn("_t0", F.lit(origin).cast("long"))
        df = df.withColumn("_d", self.micros() - F.col("_t0"))
        last, first = F.floor(F.col("_d") / step), F.floor((F.col("_d") - size) / step) + 1
        if size <= step:
            df = df.withColumn("window_id", last).where(F.col("_d") - F.col("window_id") * step < size)
        else:
            df = df.withColumn("window_id", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
        return self.with_df(df.drop("_d", "_t0"), ["window_id", *self.order])

    def buffer_time(self: Seq, length: float, every: float | None = None, origin: int | None = None, columns: list[Column] = ()) -> Seq:
        return self.window_time(length, every, origin).per_window(*columns)

    def window_time_counts(self: Seq, length: float, origin: int | None = None) -> Seq:
        """Tumbling windows with their number of rows, empty ones between the first and the last included."""
        counts = self.buffer_time(length, origin=origin).df
        spine = numbers_to(counts.groupBy(*self.keys).agg(F.max("window_id").alias("_m")), "_m", "window_id")
        df = spine.join(counts, [*self.keys, "window_id"], "left").na.fill(0, ["n"])
        return self.with_df(df, [*self.keys, "window_id"], ts=None)

    def window_when(self: Seq, openings: Seq, length: float, on: list[str] | None = None) -> Seq:
        """A window for each opening, open for so many seconds; rows may be in several windows or in none."""
        pairs = openings.join(self, length, 0.0, on)
        return self.with_df(pairs.df, pairs.order, ts=None, keys=())

    def buffer_when(self: Seq, openings: Seq, length: float, on: list[str] | None = None) -> Seq:
        """Each opening with its number of rows."""
        return openings.group_join(self, length, 0.0, on)

    def window_boundary(self: Seq, boundary: Seq) -> Seq:
        """Windows between the boundary's times; rows at a boundary's time belong to the next window."""
        union = self._tagged([boundary, self], None)
        frame = union.ordered().running("window_id", F.when(F.col("s0").isNotNull(), 1).otherwise(0), "sum").frame()
        rows = frame.where("s1 IS NOT NULL").select("window_id", "s1.*")
        return self.with_df(rows, ["window_id", *self.order])

    def buffer_boundary(self: Seq, boundary: Seq, columns: list[Column] = ()) -> Seq:
        return self.window_boundary(boundary).per_window(*columns)

    # By count or time: the next window depends on where the last one ended.

    def window_timeout(self: Seq, size: int, length: float, restart: bool = False) -> Seq:
        """Windows of up to `size` rows and `length` seconds from their first row on.

        restart: windows are open all the time instead. One begins with the sequence's first row, the next when
        one is full or its time is up, so windows without rows are counted by the ids.
        """
        limit = round(length * 1e6)
        if restart:
            df = carried(self, lambda: OpenWindows(size, limit), [self.micros()], "window_id")
        else:
            df = opened(self, self.micros(), limit, size, window="window_id").drop("_opens")
        return self.with_df(df, ["window_id", *self.order])

    def buffer_timeout(self: Seq, size: int, length: float, columns: list[Column] = ()) -> Seq:
        return self.window_timeout(size, length).per_window(*columns)
