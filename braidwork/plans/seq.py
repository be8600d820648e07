"""An ordered, optionally timed sequence of rows: a DataFrame with a declared total order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.context import Context
from braidwork.functions.hooks import decorated
from braidwork.operators.aggregate import Aggregate
from braidwork.operators.combine import Combine
from braidwork.operators.control import Control
from braidwork.operators.ends import Ends
from braidwork.operators.errors import Errors
from braidwork.operators.project import Project
from braidwork.operators.select import Select
from braidwork.operators.share import Share
from braidwork.operators.timeops import TimeOps
from braidwork.operators.windows import Windows
from braidwork.plans.ordered import Ordered


class Seq(Project, Select, Combine, Aggregate, Windows, TimeOps, Errors, Share, Ends, Control):
    """Immutable: every operator returns a new Seq. `order` is unique; `ts` names the event time, `keys` the
    columns by which the sequence is many independent ones (operators that need positions then work per key)."""

    def __init__(self, df: DataFrame, order: Sequence[str] | str, ts: str | None = None, keys: Sequence[str] = (), hooks: tuple = (), context: Context | None = None, end: DataFrame | None = None):
        self.df = df
        self.order = [order] if isinstance(order, str) else list(order)
        self.ts, self.keys = ts, list(keys)
        self.hooks, self.context, self.end = hooks, context or Context(), end

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, order: Sequence[str] | None = None, **changes: Any) -> Seq:
        kept = {"ts": self.ts, "keys": self.keys, "hooks": self.hooks, "context": self.context, "end": self.end} | changes
        if kept["ts"] not in df.columns:
            kept["ts"] = None
        kept["keys"] = [k for k in kept["keys"] if k in df.columns]
        return Seq(decorated(df), self.order if order is None else order, **kept)

    def ordered(self) -> Ordered:
        return Ordered(self.df, self.order, self.keys)

    def place(self) -> Column:
        """The order as one comparable value."""
        return F.struct(*self.order)

    def micros(self, name: str | None = None) -> Column:
        """Event time as microseconds since 1970, the same in every session time zone."""
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name or self.ts}` AS TIMESTAMP_NTZ))")

    def sorted_df(self) -> DataFrame:
        return self.df.orderBy(*self.keys, *self.order)

    def columns(self) -> list[str]:
        return self.df.columns

    def flux(self) -> Seq:
        return self

    on_assembly = flux

    def get_prefetch(self) -> int:
        """Rows that Spark hands over at a time, from executors to the driver's iterators: a partition."""
        return -1

    def __str__(self) -> str:
        return f"Seq(order={self.order}, ts={self.ts}, keys={self.keys}, columns={self.df.columns})"

    def to_string(self) -> str:
        return str(self)

    def as_(self, convert: Callable[[Seq], Any]) -> Any:
        return convert(self)


def us(duration: float) -> int:
    """Seconds as microseconds."""
    return round(duration * 1_000_000)
