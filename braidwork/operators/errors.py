"""Errors as data: an expression's failure is a nullable message, so that what came before it can be kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.retry import Retry

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Errors:
    """`failed` is a boolean column: the row's computation fails."""

    def on_error_return(self: Seq, failed: Column, row: dict) -> Seq:
        """Rows before the first failure, then this row."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema)
        return self.on_error_resume(failed, self.with_df(self.spark.createDataFrame([row], schema)))

    def on_error_resume(self: Seq, failed: Column, fallback: Seq) -> Seq:
        """Rows before the first failure, then the fallback sequence."""
        before = self.on_error_complete(failed)
        broke = F.broadcast(self.df.where(failed).limit(1).agg(F.count("*").alias("_n")).where("_n > 0"))  # one row
        instead = fallback.df.crossJoin(broke).drop("_n")
        both = before.df.withColumn("source_ord", F.lit(0)).unionByName(instead.withColumn("source_ord", F.lit(1)))
        return self.with_df(both, ["source_ord", *self.order])

    def on_error_complete(self: Seq, failed: Column) -> Seq:
        """Rows before the first failure."""
        return self._cut(failed, lambda place, cut: cut.isNull() | (place < cut))

    def on_error_continue(self: Seq, failed: Column) -> tuple[Seq, DataFrame]:
        """Rows that don't fail, and the failing ones as a table of their own."""
        bad = F.coalesce(failed, F.lit(False))
        return self.with_df(self.df.where(~bad)), self.df.where(bad)

    def on_error_stop(self: Seq) -> Seq:
        return self

    def error_if(self: Seq, failed: Column, message: str) -> Seq:
        good = F.when(failed, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
        return self.with_df(self.df.where(good))

    def on_error_map(self: Seq, translate: Callable[[BaseException], BaseException]) -> Seq:
        return self.hooked("map_error", translate)

    def retry(self: Seq, times: int | None = None) -> Seq:
        return self.hooked("retry", Retry.indefinitely() if times is None else Retry.max(times))

    def retry_when(self: Seq, spec: Retry) -> Seq:
        return self.hooked("retry", spec)
