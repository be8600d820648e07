"""Actions, hooks, context, scheduling: what the driver does around a plan."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from braidwork.functions.context import Context
from braidwork.functions.listeners import CALLBACKS, Watch

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq

POOL = ThreadPoolExecutor(max_workers=8, thread_name_prefix="braidwork")


class TimedOut(RuntimeError):
    pass


def cancelled(error: BaseException) -> bool:
    """Whether a job failed because its tag was interrupted."""
    said = str(error).lower()
    return "cancelled" in said and ("job tag" in said or "job group" in said or "operation" in said)


class Control:
    # Running a plan, with the hooks of the chain around it.

    def run(self: Seq, action: Callable[[DataFrame], Any], ordered: bool = True) -> Any:
        """Do an action on the rows (in order): first-hooks (last declared first), subscribe, the action under its retry rule, then the
        hooks for its end. Hooks for runs get a `Run` with its rows, times, duration and error."""
        calls = lambda kind: [f for k, f in self.hooks if k == kind]
        for hook in reversed(calls("first")):
            hook()
        for hook in calls("subscribe"):
            hook()
        retries, names, tags = calls("retry"), calls("name"), calls("tag")
        spark = self.spark
        if names:
            spark.sparkContext.setJobDescription(names[-1])
        for tag in tags:
            spark.addTag(tag)
            spark.sparkContext.addJobTag(tag)
        rows, watched = self.sorted_df() if ordered else self.df, calls("run")
        watch = Watch(rows, self.micros() if self.ts in rows.columns else None) if watched else None

        def told(error: BaseException | None = None, cancelled: bool = False) -> None:
            if watched:
                run = watch.ended(names[-1] if names else None, error, cancelled)
                for hook in watched:
                    hook(run)

        attempt = lambda: action(watch.df if watched else rows)
        for spec in retries:
            attempt = (lambda inner, spec: lambda: spec.run(inner))(attempt, spec)
        try:
            result = attempt()
        except Exception as error:
            told(error, cancelled(error))
            if cancelled(error):
                for hook in calls("cancel"):
                    hook()
                raise
            for hook in calls("error"):
                hook(error)
            for hook in calls("terminate"):
                hook()
            shown = error
            for translate in calls("map_error"):
                shown = translate(shown)
            if shown is not error:
                raise shown from error
            raise
        else:
            told()
            for hook in calls("complete"):
                hook()
            for hook in calls("terminate"):
                hook()
            return result
        finally:
            for hook in calls("after_terminate"):
                hook()
            for hook in reversed(calls("finally")):
                hook()
            for tag in tags:
                spark.removeTag(tag)
                spark.sparkContext.removeJobTag(tag)

    def subscribe(self: Seq, on_next: Callable[[Row], None] | None = None, on_error: Callable | None = None, on_complete: Callable | None = None) -> None:
        """Rows in order to a consumer on the driver, streamed partition by partition."""
        seq = self
        if on_error:
            seq = seq.do_on_error(on_error)
        if on_complete:
            seq = seq.do_on_complete(on_complete)

        def consume(df: DataFrame) -> None:
            if on_next is None:
                df.write.format("noop").mode("overwrite").save()
                return
            for row in df.toLocalIterator(prefetchPartitions=True):
                on_next(row)

        try:
            seq.run(consume)
        except Exception:
            if on_error is None:
                raise

    def subscribe_with(self: Seq, sink: Callable) -> Callable:
        """Every partition's rows to a sink on the executors; returns the sink."""
        self.run(lambda df: df.foreachPartition(sink))
        return sink

    def write(self: Seq, path: str, format: str = "parquet", mode: str = "errorifexists", **options: Any) -> None:
        self.run(lambda df: df.write.format(format).mode(mode).options(**options).save(path), ordered=False)

    def collect_rows(self: Seq) -> list[Row]:
        return self.run(lambda df: df.collect())

    def to_future(self: Seq) -> Future:
        return POOL.submit(self.collect_rows)

    def _within_time(self: Seq, action: Callable[[], Any], timeout: float | None) -> Any:
        if timeout is None:
            return action()
        tag, spark = f"braidwork-{id(self)}-{time.monotonic_ns()}", self.spark

        def tagged() -> Any:
            spark.sparkContext.addJobTag(tag)
            try:
                return action()
            finally:
                spark.sparkContext.removeJobTag(tag)

        future = POOL.submit(tagged)
        try:
            return future.result(timeout)
        except TimeoutError as error:
            spark.sparkContext.cancelJobsWithTag(tag)
            raise TimedOut(f"no result within {timeout} s") from error

    def block_first(self: Seq, timeout: float | None = None) -> Row | None:
        rows = self._within_time(lambda: self.take(1).collect_rows(), timeout)
        return rows[0] if rows else None

    def block_last(self: Seq, timeout: float | None = None) -> Row | None:
        rows = self._within_time(lambda: self.take_last(1).collect_rows(), timeout)
        return rows[0] if rows else None

    def block(self: Seq, timeout: float | None = None) -> Row | None:
        """The row of a sequence that has one at most."""
        rows = self._within_time(self.single_or_empty().collect_rows, timeout)
        return rows[0] if rows else None

    block_optional = block

    def to_iterable(self: Seq) -> Iterator[Row]:
        return self.run(lambda df: df.toLocalIterator(prefetchPartitions=True))

    to_stream = to_iterable

    def then(self: Seq, following: Seq | None = None) -> Seq | None:
        """Run to completion without keeping rows; then go on with another sequence."""
        self.run(lambda df: df.write.format("noop").mode("overwrite").save(), ordered=False)
        return following

    then_many = then_empty = then_return = then

    def and_(self: Seq, *others: Seq) -> None:
        when(self, *others)

    # Hooks.

    def hooked(self: Seq, kind: str, function: Any) -> Seq:
        return self.with_df(self.df, hooks=(*self.hooks, (kind, function)))

    def do_first(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("first", hook)

    def do_on_subscribe(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("subscribe", hook)

    def do_on_complete(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("complete", hook)

    do_on_success = do_on_complete

    def do_on_error(self: Seq, hook: Callable[[BaseException], None]) -> Seq:
        return self.hooked("error", hook)

    def do_on_terminate(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("terminate", hook)

    def do_after_terminate(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("after_terminate", hook)

    def do_finally(self: Seq, hook: Callable[[], None]) -> Seq:
        return self.hooked("finally", hook)

    def do_on_each(self: Seq, hook: Callable[[str, Any], None]) -> Seq:
        """hook(kind, value): ("next", row as a dictionary) on the executors, ("complete", None) or ("error", error) on the driver."""
        return self.do_on_row(lambda row: hook("next", row)).do_on_complete(lambda: hook("complete", None)).do_on_error(lambda e: hook("error", e))

    def do_on_row(self: Seq, hook: Callable[[dict], None]) -> Seq:
        """hook(row as a dictionary) for each row that passes, on the executor that has it; rows go on as they are.

        A task that runs again calls it again; what it raises fails the action.
        """

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    hook(row)
                yield batch

        return self.with_df(self.df.mapInArrow(run, self.df.schema))

    def do_on_next(self: Seq, name: str | Callable[[dict], None], **metrics: Any) -> Any:
        """With a function: it is called with each row (see do_on_row). With a name: metrics of the rows that pass, filled by the next action, as (sequence, observation)."""
        if callable(name):
            return self.do_on_row(name)
        seen = Observation(name)
        return self.with_df(self.df.observe(seen, *[c.alias(n) for n, c in (metrics or {"rows": F.count(F.lit(1))}).items()])), seen

    def tap(self: Seq, listener: Any) -> Seq:
        """A listener with any of the methods do_first, do_on_subscribe, do_on_complete, do_on_error(error), do_on_cancel, do_on_terminate,
        do_after_terminate, do_finally, do_on_next(row), and do_on_run(run), which gets rows, event times, duration and error of each run."""
        seq = self.do_on_row(listener.do_on_next) if hasattr(listener, "do_on_next") else self
        for method, kind in CALLBACKS.items():
            if hasattr(listener, method):
                seq = seq.hooked(kind, getattr(listener, method))
        return seq

    def log(self: Seq, category: str = "braidwork", level: int = logging.INFO) -> Seq:
        out = logging.getLogger(category)
        return self.do_on_subscribe(lambda: out.log(level, "subscribe")).do_on_complete(lambda: out.log(level, "complete")).do_on_error(lambda e: out.error("error: %s", e))

    def do_on_request(self: Seq, hook: Callable) -> Seq:
        """There is no demand to watch in a plan that pulls."""
        return self

    do_on_discard = do_on_request

    def do_on_cancel(self: Seq, hook: Callable[[], None]) -> Seq:
        """Called instead of the hooks for errors when a tag of the run is interrupted (cancel_on, a timeout)."""
        return self.hooked("cancel", hook)

    def cancel_on(self: Seq, tag: str) -> Seq:
        """Runs under a tag; spark.sparkContext.cancelJobsWithTag(tag) from any thread cancels it."""
        return self.hooked("tag", tag)

    def on_terminate_detach(self: Seq) -> Seq:
        return self

    # Names and context.

    def name(self: Seq, name: str) -> Seq:
        return self.hooked("name", name)

    def tag(self: Seq, key: str, value: str) -> Seq:
        return self.hooked("tag", f"{key}={value}")

    def metrics(self: Seq) -> tuple[Seq, Observation]:
        return self.do_on_next("metrics")

    def checkpoint(self: Seq, label: str = "checkpoint") -> Seq:
        """A label for error messages, not a data checkpoint."""
        def noted(error: BaseException) -> BaseException:
            error.add_note(f"at checkpoint: {label}")
            return error

        return self.hooked("map_error", noted)

    def context_write(self: Seq, **values: Any) -> Seq:
        return self.with_df(self.df, context=self.context.put_all(values))

    def context_capture(self: Seq, captured: dict) -> Seq:
        return self.context_write(**captured)

    def subscribe_on(self: Seq, pool: str) -> Seq:
        """Jobs of this sequence go to a scheduler pool."""
        return self.do_first(lambda: self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool))

    def delay_subscription_wall(self: Seq, seconds: float) -> Seq:
        return self.do_first(lambda: time.sleep(seconds))

    def repeat_when(self: Seq, spec: Any, action: Callable[[DataFrame], Any]) -> list[Any]:
        return spec.run(lambda: self.run(action))

    def repeat_when_empty(self: Seq, build: Callable[[], Seq], most: int = 10, pause: float = 0.0) -> Seq:
        """This sequence, or the first of up to `most` rebuilt ones that has a row."""
        seq = self
        for _ in range(most):
            if not seq.df.isEmpty():
                break
            time.sleep(pause)
            seq = build()
        return seq

    def plan(self: Seq, mode: str = "formatted") -> None:
        self.df.explain(mode)


def when(*seqs: Any, delay_error: bool = False) -> None:
    """Run all to completion side by side. delay_error: wait for all, then raise what failed together."""
    futures = [POOL.submit(s.then) for s in seqs]
    errors = []
    for f in futures:
        try:
            f.result()
        except Exception as error:
            if not delay_error:
                raise
            errors.append(error)
    if errors:
        raise ExceptionGroup("several sequences failed", errors)


def when_delay_error(*seqs: Any) -> None:
    when(*seqs, delay_error=True)
