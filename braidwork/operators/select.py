"""Filters, distinct, and cuts of a prefix or suffix.

A cut by a predicate needs the place of one row only, a plain aggregate, so it never orders the sequence.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Select:
    def filter(self: Seq, predicate: Column) -> Seq:
        return self.with_df(self.df.where(predicate))

    def filter_when(self: Seq, tests: DataFrame, on: list[str] | str, flag: str) -> Seq:
        """Keep rows whose first test (by column order of `tests`) is true; rows without a test go."""
        return self.with_df(self.df.join(tests.where(F.col(flag)).select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_semi"))

    def distinct(self: Seq, *key: str) -> Seq:
        """The first row of each key."""
        columns = [*self.keys, *(key or [c for c in self.df.columns if c not in self.order])]
        rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*self.order))
        return self.with_df(self.df.withColumn("_r", rank).where("_r = 1").drop("_r"))

    def distinct_until_changed(self: Seq, key: Column) -> Seq:
        frame = self.ordered().neighbour("_last", key, -1).neighbour("_place", F.lit(1), -1).frame()
        return self.with_df(frame.where(F.col("_place").isNull() | ~key.eqNullSafe(F.col("_last"))).drop("_last", "_place"))

    def ignore_elements(self: Seq) -> Seq:
        return self.with_df(self.df.where(F.lit(False)))

    ignore_element = ignore_elements

    # Cuts at one place.

    def joined_by_key(self: Seq, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """left with the columns of right, one row for each key at most; null keys are keys too."""
        same = {k: f"_key{i}" for i, k in enumerate(self.keys)}
        match = [left[k].eqNullSafe(F.col(n)) for k, n in same.items()]
        return left.join(right.withColumnsRenamed(same), match, how).drop(*same.values())

    def _cut(self: Seq, where: Column, keep) -> Seq:
        """keep(place, found): which rows stay, given the place of the first row where the predicate holds (null: none)."""
        places = self.df.where(where)
        if self.keys:
            found = places.groupBy(*self.keys).agg(F.min(self.place()).alias("_cut"))
            joined = self.joined_by_key(self.df, found, "left")
        else:
            joined = self.df.crossJoin(F.broadcast(places.agg(F.min(self.place()).alias("_cut"))))  # one row
        return self.with_df(joined.where(keep(self.place(), F.col("_cut"))).drop("_cut"))

    def take_while(self: Seq, predicate: Column) -> Seq:
        return self._cut(~F.coalesce(predicate, F.lit(False)), lambda place, cut: cut.isNull() | (place < cut))

    def take_until(self: Seq, predicate: Column) -> Seq:
        """Up to the first row where the predicate holds, that row included."""
        return self._cut(predicate, lambda place, cut: cut.isNull() | (place <= cut))

    def skip_while(self: Seq, predicate: Column) -> Seq:
        return self._cut(~F.coalesce(predicate, F.lit(False)), lambda place, cut: cut.isNotNull() & (place >= cut))

    def skip_until(self: Seq, predicate: Column) -> Seq:
        return self._cut(predicate, lambda place, cut: cut.isNotNull() & (place >= cut))

    def _other_time(self: Seq, other: Seq):
        return self.df.crossJoin(F.broadcast(other.df.agg(F.min(other.ts).alias("_at"))))  # one row

    def take_until_other(self: Seq, other: Seq) -> Seq:
        df = self._other_time(other).where(F.col("_at").isNull() | (F.col(self.ts) < F.col("_at")))
        return self.with_df(df.drop("_at"))

    def skip_until_other(self: Seq, other: Seq) -> Seq:
        return self.with_df(self._other_time(other).where(F.col(self.ts) >= F.col("_at")).drop("_at"))

    # Counted cuts.

    def _ranked(self: Seq, descending: bool):
        order = [F.col(c).desc() if descending else F.col(c) for c in self.order]
        return F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))

    def take(self: Seq, n: int) -> Seq:
        if self.keys:
            return self.with_df(self.df.withColumn("_r", self._ranked(False)).where(F.col("_r") <= n).drop("_r"))
        return self.with_df(self.df.orderBy(*self.order).limit(n))

    limit_request = take

    def take_for(self: Seq, duration: float) -> Seq:
        """Rows within so many seconds of the first one."""
        return self._within(duration, True)

    def skip_for(self: Seq, duration: float) -> Seq:
        return self._within(duration, False)

    def _within(self: Seq, duration: float, inside: bool) -> Seq:
        starts = self.df.groupBy(*self.keys).agg(F.min(self.micros()).alias("_t0"))
        joined = self.df.join(starts, self.keys) if self.keys else self.df.crossJoin(F.broadcast(starts))  # one row
        end = F.col("_t0") + round(duration * 1_000_000)
        return self.with_df(joined.where(self.micros() < end if inside else self.micros() >= end).drop("_t0"))

    def take_last(self: Seq, n: int) -> Seq:
        if self.keys:
            return self.with_df(self.df.withColumn("_r", self._ranked(True)).where(F.col("_r") <= n).drop("_r"))
        return self.with_df(self.df.orderBy(*[F.col(c).desc() for c in self.order]).limit(n))

    def skip(self: Seq, n: int) -> Seq:
        return self if n == 0 else self.with_df(self.ordered().position().frame().where(F.col("_pos") >= n).drop("_pos"))

    def skip_last(self: Seq, n: int) -> Seq:
        if n == 0:
            return self
        if self.keys:
            return self.with_df(self.df.withColumn("_r", self._ranked(True)).where(F.col("_r") > n).drop("_r"))
        # All rows before the place of the n-th last row, found by a top-n and not by ordering all.
        tail = self.df.select(*self.order).orderBy(*[F.col(c).desc() for c in self.order]).limit(n)
        edge = tail.agg(F.when(F.count("*") == n, F.min(self.place())).alias("_edge"))
        return self.with_df(self.df.crossJoin(F.broadcast(edge)).where(self.place() < F.col("_edge")).drop("_edge"))  # one row

    # Single rows.

    def next(self: Seq) -> Seq:
        return self.take(1)

    def element_at(self: Seq, n: int, default: dict | None = None) -> Seq:
        """Row n (from 0); too few rows are an error, or give the default."""
        got = self.df.orderBy(*self.order).offset(n).limit(1)
        message = F.concat(F.lit("source had "), self._rows(), F.lit(f" elements, expected at least {n + 1}"))
        return self._or_else(got, default, message)

    def last(self: Seq, default: dict | None = None) -> Seq:
        return self._or_else(self.take_last(1).df, default, F.lit("the sequence is empty"))

    def _rows(self: Seq) -> Column:
        return F.col("_rows").cast("string")

    def _or_else(self: Seq, got: DataFrame, default: dict | None, message: Column) -> Seq:
        counted = self.df.agg(F.count("*").alias("_rows"))
        if default is not None:
            fallback = self.spark.createDataFrame([default], self.df.schema.simpleString().removeprefix("struct<").removesuffix(">"))
            missing = got.agg(F.count("*").alias("_n")).where("_n = 0")
            return self.with_df(got.unionByName(fallback.crossJoin(missing).drop("_n"), allowMissingColumns=True))
        # One row that holds the count, next to the row that was got (if any); reading it checks the count.
        checked = counted.join(got.withColumn("_one", F.lit(True)), F.lit(True), "left")
        failed = F.when(F.col("_one").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return self.with_df(checked.where(failed).drop("_rows", "_one"))

    def single(self: Seq, default: dict | None = None) -> Seq:
        """The only row: none is an error (or gives the default), more than one is an error."""
        return self._only(self._or_else(self.df.limit(2), default, F.lit("the sequence is empty")))

    def single_optional(self: Seq, name: str = "value") -> Seq:
        """Always one row: a struct of the only row, or null."""
        rows = self.single_or_empty()
        return self.with_df(rows.df.agg(F.first(F.struct(*self.df.columns)).alias(name)), [name], ts=None, keys=())

    def single_or_empty(self: Seq) -> Seq:
        return self._only(self.with_df(self.df.limit(2)))

    def _only(self: Seq, rows: Seq) -> Seq:
        n = F.count("*").over(Window.partitionBy(F.lit(0)))
        good = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one element")).cast("boolean")).otherwise(F.lit(True))
        return self.with_df(rows.df.withColumn("_n", n).where(good).drop("_n"))

    def default_if_empty(self: Seq, row: dict) -> Seq:
        schema = self.df.schema.simpleString().removeprefix("struct<").removesuffix(">")
        return self.switch_if_empty(self.with_df(self.spark.createDataFrame([row], schema)))

    def switch_if_empty(self: Seq, other: Seq) -> Seq:
        empty = self.df.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
        return self.with_df(self.df.unionByName(other.df.crossJoin(F.broadcast(empty)).drop("_n")))
