"""Delays, sampling and timeouts on event time."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from braidwork.plans.gates import carried, opened

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Latest:
    """A consumer that takes so long for each row; of those that come meanwhile the last one waits. `state`: when it is free."""

    def __init__(self, length: int):
        self.length, self.state, self.moved = length, None, 0

    def step(self, at: int | None, following: int | None) -> int | None:
        if at is None or (self.state is not None and at < self.state and following is not None and following <= self.state):
            return None
        taken = at if self.state is None else max(at, self.state)
        self.state = taken + self.length
        return taken


class Queue:
    """A consumer that takes so long for each row, with so many places to wait; a row that finds none goes. `state`: when it is free."""

    def __init__(self, length: int, size: int):
        self.length, self.size, self.state, self.moved = length, size, None, 0

    def step(self, at: int | None) -> int | None:
        if at is None:
            return None
        if self.state is None or self.state <= at:
            taken = at
        elif -((at - self.state) // self.length) - 1 >= self.size:  # those that wait are taken one after the other, up to now
            return None
        else:
            taken = self.state
        self.state = taken + self.length
        return taken


class TimeOps:
    def delay_elements(self: Seq, duration: float, name: str = "out_us") -> Seq:
        """When each row comes out if every one waits so long after the later of its arrival and the row before's exit.

        The recurrence has a closed form: (i + 1) * d + the running maximum of time - i * d.
        """
        d = round(duration * 1e6)
        frame = self.ordered().position("_pos")
        frame.running("_lead", self.micros() - F.col("_pos").cast("long") * d, "max")
        return self.with_df(frame.frame().withColumn(name, F.col("_lead") + (F.col("_pos").cast("long") + 1) * d).drop("_pos", "_lead"))

    delay_element = delay_elements

    def delay_sequence(self: Seq, duration: float, name: str = "out_us") -> Seq:
        return self.with_df(self.df.withColumn(name, self.micros() + round(duration * 1e6)))

    def delay_until(self: Seq, ready_us: str, name: str = "out_us") -> Seq:
        """When each row comes out if it waits for its own trigger (a column of microseconds) and for the rows before it."""
        return self.with_df(self.ordered().running(name, F.greatest(self.micros(), F.col(ready_us)), "max").frame())

    def delay_subscription(self: Seq, duration: float, hot: bool = False) -> Seq:
        """The sequence, read so many seconds later. A cold source loses nothing; a hot one loses the rows of that time."""
        return self.skip_for(duration) if hot else self.delay_subscription_wall(duration)

    def sample(self: Seq, period: float, origin: int | None = None) -> Seq:
        """The last row of each period, ticks counted from `origin` (by default the first row's time)."""
        last = self.window_time(period, origin=origin)
        rows = last.per_window(F.max_by(F.struct(*self.df.columns), F.struct(*self.order)).alias("_row"))
        return self.with_df(rows.df.select("_row.*"))

    def sample_by(self: Seq, ticks: Seq) -> Seq:
        """At each tick the last row since the tick before, and what is left at the end."""
        last = self.window_boundary(ticks)
        rows = last.per_window(F.max_by(F.struct(*self.df.columns), F.struct(*self.order)).alias("_row"))
        return self.with_df(rows.df.select("_row.*"))

    def sample_timeout(self: Seq, quiet: float) -> Seq:
        """Rows that no other follows within so many seconds, and the last one."""
        frame = self.ordered().neighbour("_next", self.micros(), 1).frame()
        return self.with_df(frame.where(F.col("_next").isNull() | (F.col("_next") > self.micros() + round(quiet * 1e6))).drop("_next"))

    def sample_first(self: Seq, period: float) -> Seq:
        """A row, then none for so many seconds, and so on; rows without a time go."""
        timed = self.with_df(self.df.where(self.micros().isNotNull()))
        rows = opened(timed, timed.micros(), round(period * 1e6), opens="_passed")
        return self.with_df(rows.where("_passed").drop("_passed", "_window"))

    def timeout(self: Seq, duration: float, fallback: Seq | None = None, first: float | None = None, start_us: int | None = None) -> Seq:
        """Rows up to the first gap longer than so many seconds; then the fallback, or an error when read.

        `first` is the limit for the first row, counted from start_us. In a keyed sequence each key has gaps of its
        own, and a fallback has the key columns: a key that times out goes on with its rows there.
        """
        frame = self.ordered().neighbour("_before", self.micros(), -1).frame()
        late = self.micros() - F.col("_before") > round(duration * 1e6)
        if first is not None and start_us is not None:
            late = F.when(F.col("_before").isNull(), self.micros() - F.lit(start_us) > round(first * 1e6)).otherwise(late)
        gaps = self.with_df(frame.withColumn("_late", F.coalesce(late, F.lit(False))))
        cut = gaps.df.where("_late").groupBy(*self.keys).agg(F.min(gaps.place()).alias("_cut"))
        joined = self.joined_by_key(gaps.df, cut, "left") if self.keys else gaps.df.crossJoin(F.broadcast(cut))  # one row
        if fallback is None:
            place = gaps.place()
            good = F.when(place >= F.col("_cut"), F.raise_error(F.lit(f"no row within {duration} s")).cast("boolean")).otherwise(F.lit(True))
            return self.with_df(joined.where(good).drop("_late", "_cut", "_before"))
        kept = joined.where(F.col("_cut").isNull() | (gaps.place() < F.col("_cut"))).drop("_late", "_cut", "_before")
        timed_out = cut.where(F.col("_cut").isNotNull())
        instead = (self.joined_by_key(fallback.df, timed_out, "inner") if self.keys else fallback.df.crossJoin(F.broadcast(timed_out))).drop("_cut")
        both = kept.withColumn("source_ord", F.lit(0)).unionByName(instead.withColumn("source_ord", F.lit(1)), allowMissingColumns=True)
        return self.with_df(both, ["source_ord", *self.order])

    def limit_rate(self: Seq, high: int, low: int | None = None) -> Seq:
        """Demand has no meaning in a plan that pulls; in streams the source's own limits do this."""
        return self

    # Overflow: what a consumer does that takes `drain` seconds for each row. Without a drain rate a plan that pulls has none.

    def on_backpressure_drop(self: Seq, drain: float | None = None) -> Seq:
        """Rows that come while the consumer is busy go."""
        return self if drain is None else self.sample_first(drain)

    def on_backpressure_latest(self: Seq, drain: float | None = None, name: str = "out_us") -> Seq:
        """Of the rows that come while the consumer is busy the last one waits; `name` is when each is taken."""
        if drain is None:
            return self
        seq = self.with_df(self.ordered().neighbour("_next", self.micros(), 1).frame())
        length = round(drain * 1e6)
        taken = carried(seq, lambda: Latest(length), [self.micros(), F.col("_next")], name)
        return self.with_df(taken.drop("_next"))

    def on_backpressure_buffer(self: Seq, drain: float | None = None, size: int | None = None, overflow: str = "error", name: str = "out_us") -> Seq:
        """Rows wait their turn, `size` at most (None: any number); `name` is when each is taken.

        A row that comes when so many wait fails the action (overflow "error") or goes ("drop").
        """
        if drain is None:
            return self
        length = round(drain * 1e6)
        if overflow == "drop" and size == 0:
            return self.with_df(self.sample_first(drain).df.withColumn(name, self.micros()))
        if overflow == "drop" and size is not None:
            return self.with_df(carried(self, lambda: Queue(length, size), [self.micros()], name))
        timed = self.with_df(self.df.where(self.micros().isNotNull()))
        frame = timed.ordered().position("_pos")
        at, pos = self.micros(), F.col("_pos").cast("long")
        frame.running("_lead", at - pos * length, "max")  # as in delay_elements: every row so long after the one before, or at once
        taken, waiting = F.col("_lead") + pos * length, F.ceil((F.col(name) - at) / length)
        df = frame.frame().withColumn(name, taken)
        if size is not None:
            over = (F.col(name) > at) & (waiting > size)
            df = df.withColumn(name, F.when(over, F.raise_error(F.lit(f"more than {size} rows wait")).cast("long")).otherwise(F.col(name)))
        return self.with_df(df.drop("_pos", "_lead"))

    def on_backpressure_error(self: Seq, drain: float | None = None) -> Seq:
        """A row that comes while the consumer is busy fails the action."""
        return self if drain is None else self.on_backpressure_buffer(drain, 0)
