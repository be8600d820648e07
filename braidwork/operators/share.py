"""Shared and replayed results: a persisted plan, with explicit life time."""

from __future__ import annotations

import threading
import time
import weakref
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Lease:
    """What a reader's sequence and all made from it hold; when they are gone, so is the lease."""


class Connectable:
    """A sequence that is computed once and read by many: connect() fills it, the last reader (or disconnect) frees it."""

    def __init__(self, seq: Seq, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.seq, self.level, self.readers, self.connected, self.needed = seq, level, 0, False, None
        self.grace: float | None = None
        self.lock, self.timer = threading.RLock(), None

    def connect(self) -> Connectable:
        """Compute the sequence and keep it, now."""
        if not self.connected:
            self.seq.df.persist(self.level)
            self.seq.df.write.format("noop").mode("overwrite").save()
            self.connected = True
        return self

    def disconnect(self) -> None:
        if self.connected:
            self.seq.df.unpersist()
            self.connected = False

    def auto_connect(self, readers: int = 1) -> Connectable:
        """Connect when so many readers have come; 0: now."""
        self.needed = readers
        return self.connect() if readers == 0 else self

    def ref_count(self, readers: int = 1, grace: float | None = None) -> Connectable:
        """Connect when so many readers have come. With a grace time the rows are freed by themselves, so many seconds after
        the last reader's sequence (and all sequences made from it) is gone, unless another reader comes; without one by release()."""
        self.grace = grace
        return self.auto_connect(readers)

    def reader(self) -> Seq:
        with self.lock:
            self.readers += 1
            if self.timer is not None:
                self.timer.cancel()
                self.timer = None
            if self.needed is not None and self.readers >= self.needed:
                self.connect()
        if self.grace is None:
            return self.seq
        lease = Lease()
        weakref.finalize(lease, self.release)
        return self.seq.hooked("lease", lease)

    def release(self) -> None:
        """A reader is done."""
        with self.lock:
            self.readers = max(0, self.readers - 1)
            if self.readers:
                return
            if not self.grace:
                self.disconnect()
            elif self.timer is None:
                self.timer = threading.Timer(self.grace, self._free)
                self.timer.daemon = True
                self.timer.start()

    def _free(self) -> None:
        with self.lock:
            self.timer = None
            if self.readers == 0:
                self.disconnect()

    def hide(self) -> Connectable:
        return self


class Cached:
    """A sequence whose rows are kept until they are too old or a test says so, then computed again."""

    def __init__(self, seq: Seq, ttl: float | None = None, stale: Callable[[], bool] | None = None, on_invalidate: Callable[[], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.seq, self.ttl, self.stale, self.on_invalidate, self.clock = seq, ttl, stale, on_invalidate, clock
        self.since: float | None = None

    def get(self) -> Seq:
        old = self.since is not None and self.ttl is not None and self.clock() - self.since >= self.ttl
        if self.since is not None and (old or (self.stale is not None and self.stale())):
            self.invalidate()
        if self.since is None:
            self.seq.df.persist(StorageLevel.MEMORY_AND_DISK)
            self.seq.df.write.format("noop").mode("overwrite").save()  # filled now, so its age counts from when the rows are there
            self.since = self.clock()
        return self.seq

    def invalidate(self) -> None:
        if self.since is not None:
            self.seq.df.unpersist()
            self.since = None
            if self.on_invalidate:
                self.on_invalidate()


class Rails:
    """A sequence dealt to a number of partitions that work side by side."""

    def __init__(self, seq: Seq, n: int):
        self.seq, self.n = seq, n

    @staticmethod
    def of(seq: Seq, n: int | None = None) -> Rails:
        n = n or seq.spark.sparkContext.defaultParallelism
        return Rails(seq.with_df(seq.df.repartition(n)), n)

    def _with(self, seq: Seq) -> Rails:
        return Rails(seq, self.n)

    def parallelism(self) -> int:
        return self.n

    def run_on(self, pool: str | None = None) -> Rails:
        """Rails run on the executors' slots; a name sets the scheduler pool of the driver's thread."""
        if pool:
            self.seq.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return self

    def map(self, **columns) -> Rails:
        return self._with(self.seq.map(**columns))

    def filter(self, predicate) -> Rails:
        return self._with(self.seq.filter(predicate))

    def flat_map(self, array, name: str = "value") -> Rails:
        return self._with(self.seq.flat_map(array, name))

    concat_map = flat_map

    def flat_map_delay_error(self, array, error, name: str = "value") -> Rails:
        return self._with(self.seq.flat_map_delay_error(array, error, name))

    concat_map_delay_error = flat_map_delay_error

    def collect(self, *columns) -> Seq:
        """Aggregates of each rail."""
        df = self.seq.df.withColumn("rail", F.spark_partition_id()).groupBy("rail").agg(*columns)
        return self.seq.with_df(df, ["rail"], ts=None, keys=())

    def reduce(self, how: str, column, name: str = "value", seed=None) -> Seq:
        """Without seed one value of all rails (partial sums, then one); with a seed a value of each rail."""
        if seed is None:
            return self.seq.with_df(self.seq.df, keys=()).reduce(how, column, name)
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}[how]
        combine = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "product": lambda a, b: a * b}[how]
        return self.collect(combine(seed, agg(column)).alias(name))

    def groups(self) -> Seq:
        return self.seq.with_df(self.seq.df.withColumn("rail", F.spark_partition_id())).group_by("rail")

    def sorted(self, *by) -> Seq:
        return self.seq.sort(*by)

    ordered = sorted

    def collect_sorted_list(self, column, name: str = "values") -> Seq:
        return self.seq.collect_sorted_list(column, name)

    def sequential(self) -> Seq:
        return self.seq

    def transform(self, function) -> Rails:
        return function(self)

    def transform_groups(self, function: Callable, schema: str) -> Rails:
        return self._with(self.seq.map_pandas(function, schema))

    def subscribe(self, each_rail: Callable) -> None:
        """Run each_rail(rows) on every rail."""
        self.seq.run(lambda _: self.seq.df.foreachPartition(each_rail))

    def then(self) -> None:
        self.seq.then()

    from_ = of

    def get_prefetch(self) -> int:
        return self.seq.get_prefetch()

    def to_string(self) -> str:
        return str(self)

    # Hooks: of rows on every rail, of the run on the driver.

    def do_on_next(self, hook: Callable[[dict], None]) -> Rails:
        return self._with(self.seq.do_on_row(hook))

    def do_on_each(self, hook: Callable) -> Rails:
        return self._with(self.seq.do_on_each(hook))

    def do_on_error(self, hook: Callable[[BaseException], None]) -> Rails:
        return self.hooked("error", hook)

    def do_on_complete(self, hook: Callable[[], None]) -> Rails:
        return self.hooked("complete", hook)

    def do_on_subscribe(self, hook: Callable[[], None]) -> Rails:
        return self.hooked("subscribe", hook)

    def do_on_terminate(self, hook: Callable[[], None]) -> Rails:
        return self.hooked("terminate", hook)

    def do_after_terminate(self, hook: Callable[[], None]) -> Rails:
        return self.hooked("after_terminate", hook)

    def do_on_cancel(self, hook: Callable[[], None]) -> Rails:
        return self.hooked("cancel", hook)

    def do_on_request(self, hook: Callable) -> Rails:
        """There is no demand to watch in a plan that pulls."""
        return self

    def hooked(self, kind: str, function) -> Rails:
        return self._with(self.seq.hooked(kind, function))

    def name(self, name: str) -> Rails:
        return self._with(self.seq.name(name))

    def tag(self, key: str, value: str) -> Rails:
        return self._with(self.seq.tag(key, value))

    def log(self, category: str = "braidwork") -> Rails:
        return self._with(self.seq.log(category))

    def as_(self, convert: Callable):
        return convert(self)

    def checkpoint(self, label: str = "checkpoint") -> Rails:
        return self._with(self.seq.checkpoint(label))

    def validate(self, consumers: list) -> bool:
        """Whether there is one consumer for each rail."""
        return len(consumers) == self.n

    def hide(self) -> Rails:
        return self

    on_assembly = hide

    def __str__(self) -> str:
        return f"Rails({self.n}, {self.seq})"


class Share:
    def publish(self: Seq, selector: Callable[[Seq], Seq] | None = None) -> Connectable | Seq:
        """A connectable; or, with a selector, its result over a plan that is computed once and freed after the result's first action (a selector that gives a DataFrame keeps it until the session ends)."""
        if selector is None:
            return Connectable(self)
        self.df.persist(StorageLevel.MEMORY_AND_DISK)
        result = selector(self)
        return result.do_finally(lambda: self.df.unpersist()) if isinstance(result, Share) else result

    def share(self: Seq) -> Connectable:
        return Connectable(self).ref_count()

    def publish_next(self: Seq) -> Connectable:
        return Connectable(self.next()).ref_count()

    share_next = publish_next

    def replay(self: Seq, last: int | None = None, ttl: float | None = None, now_us: int | None = None) -> Connectable:
        """Shared with history: all rows, the last n, or those not older than ttl seconds (by event time, at now_us or the last row)."""
        out = self if last is None else self.take_last(last)
        if ttl is not None:
            end = F.lit(now_us) if now_us is not None else None
            if end is None:
                latest = out.df.agg(F.max(out.micros()).alias("_now"))
                out = out.with_df(out.df.crossJoin(F.broadcast(latest)).where(out.micros() > F.col("_now") - round(ttl * 1e6)).drop("_now"))  # one row
            else:
                out = out.with_df(out.df.where(out.micros() > end - round(ttl * 1e6)))
        return Connectable(out)

    def cache(self: Seq, ttl: float | None = None) -> Cached:
        return Cached(self, ttl)

    def cache_invalidate_if(self: Seq, stale: Callable[[], bool]) -> Cached:
        return Cached(self, stale=stale)

    def cache_invalidate_when(self: Seq, stale: Callable[[], bool], on_invalidate: Callable[[], None] | None = None) -> Cached:
        return Cached(self, stale=stale, on_invalidate=on_invalidate)

    def parallel(self: Seq, n: int | None = None) -> Rails:
        return Rails.of(self, n)

    def publish_on(self: Seq, partitions: int | None = None) -> Seq:
        """A boundary between stages."""
        return self.with_df(self.df.repartition(partitions) if partitions else self.df)
