"""Where the driver's own work runs. Work on rows runs on the executors' slots and is scheduled by Spark."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


class Scheduler:
    """Tasks on a pool of threads (none: in the caller's thread), once, later or again and again."""

    def __init__(self, threads: int, name: str):
        self.name, self.stopped = name, threading.Event()
        self.pool = ThreadPoolExecutor(threads, thread_name_prefix=name) if threads else None

    def schedule(self, task: Callable[[], Any], delay: float = 0.0) -> Future:
        def later() -> Any:
            if self.stopped.wait(delay):
                raise RuntimeError(f"{self.name} was disposed")
            return task()

        if self.pool is not None:
            return self.pool.submit(later)
        done: Future = Future()
        try:
            done.set_result(later())
        except Exception as error:
            done.set_exception(error)
        return done

    def schedule_periodically(self, task: Callable[[], Any], delay: float, period: float) -> Callable[[], None]:
        """Run every so often until the returned function is called."""
        if self.pool is None:
            raise RuntimeError("the caller's thread can't repeat a task")
        ended = threading.Event()

        def again() -> None:
            ended.wait(delay)
            while not ended.is_set() and not self.stopped.is_set():
                task()
                ended.wait(period)

        self.pool.submit(again)
        return ended.set

    def now(self) -> float:
        return time.time()

    def dispose(self) -> None:
        self.stopped.set()
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)


def parallel(threads: int | None = None) -> Scheduler:
    return Scheduler(threads or os.cpu_count() or 1, "parallel")


def bounded_elastic(threads: int | None = None) -> Scheduler:
    return Scheduler(threads or 10 * (os.cpu_count() or 1), "bounded-elastic")


def single() -> Scheduler:
    return Scheduler(1, "single")


def immediate() -> Scheduler:
    return Scheduler(0, "immediate")
