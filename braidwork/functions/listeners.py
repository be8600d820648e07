"""What runs of batches and streams tell to listeners: when, how long, how many rows, and how they ended."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Methods of a listener, and the hooks of a run that they become.
CALLBACKS = {
    "do_first": "first", "do_on_subscribe": "subscribe", "do_on_complete": "complete", "do_on_error": "error", "do_on_cancel": "cancel",
    "do_on_terminate": "terminate", "do_after_terminate": "after_terminate", "do_finally": "finally", "do_on_run": "run",
}


@dataclass(frozen=True)
class Run:
    """One run of a plan, or one batch of a stream. rows and metrics are None where the run didn't get to its end."""

    name: str | None
    seconds: float
    rows: int | None = None
    first_us: int | None = None
    last_us: int | None = None
    error: BaseException | str | None = None
    cancelled: bool = False
    metrics: dict[str, Any] = field(default_factory=dict)


class Watch:
    """Counts what an action reads of a frame: rows, first and last event time."""

    def __init__(self, df: DataFrame, micros):
        self.seen, self.began = Observation(), time.monotonic()
        columns = [F.count(F.lit(1)).alias("rows")]
        if micros is not None:
            columns += [F.min(micros).alias("first_us"), F.max(micros).alias("last_us")]
        self.df = df.observe(self.seen, *columns)

    def ended(self, name: str | None, error: BaseException | None = None, cancelled: bool = False, wait: float = 5.0) -> Run:
        found, until = {}, time.monotonic() + wait
        seconds = time.monotonic() - self.began
        while error is None and not found and time.monotonic() < until:  # metrics come from the listener bus; an action that read nothing has none
            found = self.metrics()
        return Run(name, seconds, found.get("rows"), found.get("first_us"), found.get("last_us"), error, cancelled)

    def metrics(self) -> dict:
        held = self.seen._jo.getOrEmpty() if self.seen._jo is not None else None
        if held is None or held.isEmpty():
            time.sleep(0.02)
            return {}
        return dict(self.seen.get)


class StreamListener(StreamingQueryListener):
    """Streams of a session to a listener with any of do_on_subscribe(name), do_on_run(run) for each batch, do_on_complete(), do_on_error(error), do_finally()."""

    def __init__(self, spark: SparkSession, listener: Any, name: str | None = None):
        self.spark, self.listener, self.only, self.names = spark, listener, name, {}
        spark.streams.addListener(self)

    def stop(self) -> None:
        self.spark.streams.removeListener(self)

    def tell(self, method: str, *args: Any) -> None:
        if hasattr(self.listener, method):
            getattr(self.listener, method)(*args)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self.only is None or event.name == self.only:
            self.names[event.id] = event.name
            self.tell("do_on_subscribe", event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.id in self.names:
            metrics = {k: v.asDict() for k, v in p.observedMetrics.items()}
            self.tell("do_on_run", Run(p.name, (p.batchDuration or 0) / 1000, p.numInputRows, metrics=metrics))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.id in self.names:
            if event.exception is None:
                self.tell("do_on_complete")
            else:
                self.tell("do_on_error", event.exception)
            self.tell("do_finally")
