"""How sequences end: a completion or an error at a time, carried beside the rows as a table of one row."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq

#: The time of an end ahead of all rows: a source without rows and without a declared end completes at once.
AT_ONCE = -(1 << 62)


class Ends:
    """A sequence's `end` is a table (end_us, error) of one row, or of none if it never ends; None if nothing was declared, which is
    a completion behind the last row. Operators on one sequence keep it."""

    def ending(self: Seq, at_us: int | None = None, error: str | None = None) -> Seq:
        """This sequence ends at that time (microseconds; None: behind its last row), with an error or well. Rows behind the end don't exist."""
        df = self.df if at_us is None else self.df.where(self.micros() <= at_us)
        known = self.with_df(df)
        last = known._last_us().select(F.col("end_us") if at_us is None else F.lit(at_us).cast("long").alias("end_us"), F.lit(error).cast("string").alias("error"))
        return known.with_df(df, end=last)

    def never_ending(self: Seq) -> Seq:
        return self.with_df(self.df, end=self.spark.createDataFrame([], "end_us long, error string"))

    def ending_at_error(self: Seq, error: Column) -> Seq:
        """Rows up to the first one with an error, which is the sequence's end; without one it completes."""
        marked = self.with_df(self.df.withColumn("_error", error))
        first = marked.df.where("_error IS NOT NULL").agg(F.min(F.struct(marked.place().alias("at"), marked.micros().alias("us"), "_error")).alias("_first"))
        whole = self._last_us().crossJoin(F.broadcast(first))  # one row each
        end = whole.select(F.coalesce("_first.us", "end_us").alias("end_us"), F.col("_first._error").alias("error"))
        return self.with_df(self.take_while(error.isNull()).df, end=end)

    def _last_us(self: Seq) -> DataFrame:
        return self.df.agg(F.coalesce(F.max(self.micros()), F.lit(AT_ONCE)).alias("end_us"))

    def end_signal(self: Seq) -> DataFrame:
        """(end_us, error): how the sequence ends."""
        return self.end if self.end is not None else self._last_us().withColumn("error", F.lit(None).cast("string"))

    def raising(self: Seq) -> Seq:
        """The same rows; an action that reads them all fails if the sequence ends in an error."""
        failed = self.end_signal().where("error IS NOT NULL").where(F.raise_error(F.col("error")).cast("boolean"))
        nothing = failed.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema])
        return self.with_df(self.df.unionByName(nothing))

    def first_with_signal(self: Seq, *others: Seq) -> Seq:
        """The sequence whose first row or end is earliest by event time (ties: rows ahead of ends, then the first named); an empty
        source that completes wins with no rows, a failing one with its error as the result's end. If all never end there are no rows."""
        sources = [self, *others]
        frames = signals = None
        for i, s in enumerate(sources):
            rows = s.df.withColumn("_s", F.lit(i))
            frames = rows if frames is None else frames.unionByName(rows, allowMissingColumns=True)
            row = s.df.agg(F.min(s.micros()).alias("us")).where("us IS NOT NULL").select("us", F.lit(0).alias("late"), F.lit(i).alias("_s"))
            end = s.end_signal().select(F.col("end_us").alias("us"), F.lit(1).alias("late"), F.lit(i).alias("_s"))
            ended = row.unionByName(end)
            signals = ended if signals is None else signals.unionByName(ended)
        winner = signals.groupBy().agg(F.min(F.struct("us", "late", "_s"))["_s"].alias("_w"))
        ends = reduce(DataFrame.unionByName, [s.end_signal().withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
        of_winner = lambda df: df.join(F.broadcast(winner), F.col("_w") == F.col("_s")).drop("_w", "_s")  # noqa: E731  one row
        return self.with_df(of_winner(frames), end=of_winner(ends))

    or_ = first = first_with_signal

    def concat_ended(self: Seq, *others: Seq) -> Seq:
        """This sequence, then the others, up to the end of the first that fails, which is the result's; behind one that never ends nothing comes."""
        sources = [self, *others]
        ends = reduce(DataFrame.unionByName, [s.end_signal().withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
        numbers = self.spark.range(len(sources)).select(F.col("id").cast("int").alias("_s"))
        stops = numbers.join(ends.where("error IS NULL").select("_s"), "_s", "left_anti").agg(F.coalesce(F.min("_s"), F.lit(len(sources) - 1)).alias("_stop"))  # failed or endless
        stacked = self._stacked(sources)
        kept = stacked.crossJoin(F.broadcast(stops)).where("source_ord <= _stop").drop("_stop")  # one row
        end = ends.join(F.broadcast(stops), F.col("_s") == F.col("_stop")).select("end_us", "error")
        return self.with_df(kept, ["source_ord", *self.order], end=end)

    def gathered_end(self: Seq, *others: Seq) -> DataFrame:
        """The end of all of them together, delayed behind the last: their errors in the order of the sources, joined by `; `."""
        sources = [self, *others]
        ends = reduce(DataFrame.unionByName, [s.end_signal().withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
        errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("_s", "error")))), lambda x: x["error"])  # one of each source
        whole = ends.agg(F.max("end_us").alias("end_us"), errors.alias("errors"), F.count("*").alias("n")).where(F.col("n") == len(sources))
        return whole.select("end_us", F.when(F.size("errors") > 0, F.array_join("errors", "; ")).alias("error"))

    def concat_ended_delay_error(self: Seq, *others: Seq) -> Seq:
        """This sequence, then the others, also behind one that fails; all errors are gathered at the end."""
        return self.with_df(self._stacked([self, *others]), ["source_ord", *self.order], end=self.gathered_end(*others))

    def merge_ended_delay_error(self: Seq, *others: Seq) -> Seq:
        """All rows by arrival, also of sources that fail; all errors are gathered at the end."""
        merged = self.merge_with(*others)
        return merged.with_df(merged.df, end=self.gathered_end(*others))
