"""Retry and repeat specifications, used around actions by the driver."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


class RetryExhausted(RuntimeError):
    """All attempts failed; the last failure is the cause."""


@dataclass(frozen=True)
class Retry:
    """How often and after what pause an action runs again. attempts None: without end."""

    attempts: int | None = None
    min_backoff: float = 0.0
    max_backoff: float = float("inf")
    multiplier: float = 2.0
    jitter_factor: float = 0.0
    transient: bool = False
    when: Callable[[BaseException], bool] = field(default=lambda error: True)
    before: Callable[[int, BaseException], None] = field(default=lambda n, error: None)
    after: Callable[[int, BaseException], None] = field(default=lambda n, error: None)
    exhausted: Callable[[int, BaseException], BaseException] = field(default=lambda n, error: RetryExhausted(f"Retries exhausted: {n}/{n}"))
    companion: Callable[[int, BaseException], float | None] | None = None
    context: dict = field(default_factory=dict)

    @staticmethod
    def max(attempts: int) -> Retry:
        return Retry(attempts)

    @staticmethod
    def max_in_a_row(attempts: int) -> Retry:
        """Failures count since the last success: see run_all."""
        return Retry(attempts, transient=True)

    @staticmethod
    def indefinitely() -> Retry:
        return Retry()

    @staticmethod
    def backoff(attempts: int, min_backoff: float) -> Retry:
        return Retry(attempts, min_backoff, jitter_factor=0.5)

    @staticmethod
    def fixed_delay(attempts: int, delay: float) -> Retry:
        return Retry(attempts, delay, max_backoff=delay)

    @staticmethod
    def from_(companion: Callable[[int, BaseException], float | None]) -> Retry:
        """companion(n, error) says after each failure how long to wait, or (None) that the failure stands."""
        return Retry(companion=companion)

    def filter(self, when: Callable[[BaseException], bool]) -> Retry:
        return replace(self, when=when)

    def modify_error_filter(self, change: Callable[[Callable[[BaseException], bool]], Callable[[BaseException], bool]]) -> Retry:
        """change(filter so far) is the new one."""
        return replace(self, when=change(self.when))

    def max_attempts(self, attempts: int) -> Retry:
        return replace(self, attempts=attempts)

    def transient_errors(self, transient: bool = True) -> Retry:
        """Whether failures count since the last success (see run_all)."""
        return replace(self, transient=transient)

    def with_min_backoff(self, least: float) -> Retry:
        return replace(self, min_backoff=least)

    def with_multiplier(self, multiplier: float) -> Retry:
        return replace(self, multiplier=multiplier)

    def with_retry_context(self, **values: Any) -> Retry:
        """Values for hooks and companions that hold this rule."""
        return replace(self, context=self.context | values)

    def jitter(self, factor: float) -> Retry:
        return replace(self, jitter_factor=factor)

    def with_max_backoff(self, most: float) -> Retry:
        return replace(self, max_backoff=most)

    def do_before_retry(self, hook: Callable[[int, BaseException], None]) -> Retry:
        return replace(self, before=hook)

    def do_after_retry(self, hook: Callable[[int, BaseException], None]) -> Retry:
        return replace(self, after=hook)

    def on_exhausted_throw(self, make: Callable[[int, BaseException], BaseException]) -> Retry:
        return replace(self, exhausted=make)

    def delay(self, n: int, uniform: Callable[[float, float], float] = random.uniform) -> float:
        """The pause before retry n (from 0): exponential, capped, spread by the jitter factor within its bounds."""
        if not self.min_backoff:
            return 0.0
        try:
            base = min(self.min_backoff * self.multiplier**n, self.max_backoff)
        except OverflowError:
            base = self.max_backoff
        if not self.jitter_factor:
            return base
        clamp = lambda pause: min(max(pause, self.min_backoff), self.max_backoff)
        return base + uniform(clamp(base * (1 - self.jitter_factor)) - base, clamp(base * (1 + self.jitter_factor)) - base)

    def run_all(self, actions: list[Callable[[], Any]], sleep: Callable[[float], None] = time.sleep) -> list[Any]:
        """Actions one after the other, each again where it fails; retries add up over all of them, or (transient) since the last success."""
        done, used = [], 0
        for action in actions:
            left = self if self.transient or self.attempts is None else replace(self, attempts=self.attempts - used)
            tried = []
            done.append(replace(left, before=lambda n, error, tried=tried: (tried.append(n), self.before(n, error))).run(action, sleep))
            used += len(tried)
        return done

    def run(self, action: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        n = 0
        while True:
            try:
                return action()
            except Exception as error:
                if not self.when(error):
                    raise
                pause = self.delay(n) if self.companion is None else self.companion(n, error)
                if pause is None:
                    raise
                if self.attempts is not None and n >= self.attempts:
                    raise self.exhausted(n, error) from error
                self.before(n, error)
                sleep(pause)
                self.after(n, error)
                n += 1


@dataclass(frozen=True)
class Repeat:
    """How often a finished action runs again. times None: as long as `only_if` holds."""

    times: int | None = None
    pause: float = 0.0
    jitter_factor: float = 0.0
    only_if: Callable[[int], bool] = field(default=lambda n: True)
    before: Callable[[int, Any], None] = field(default=lambda n, result: None)
    after: Callable[[int, Any], None] = field(default=lambda n, result: None)
    companion: Callable[[int, Any], float | None] | None = None

    @staticmethod
    def once() -> Repeat:
        return Repeat(1)

    @staticmethod
    def of(times: int) -> Repeat:
        return Repeat(times)

    @staticmethod
    def while_(only_if: Callable[[int], bool]) -> Repeat:
        return Repeat(only_if=only_if)

    @staticmethod
    def from_(companion: Callable[[int, Any], float | None]) -> Repeat:
        """companion(n, result) says after each run how long to wait, or (None) that it was the last."""
        return Repeat(companion=companion)

    def do_before_repeat(self, hook: Callable[[int, Any], None]) -> Repeat:
        return replace(self, before=hook)

    def do_after_repeat(self, hook: Callable[[int, Any], None]) -> Repeat:
        return replace(self, after=hook)

    def with_fixed_delay(self, pause: float) -> Repeat:
        return replace(self, pause=pause)

    def jitter(self, factor: float) -> Repeat:
        return replace(self, jitter_factor=factor)

    def run(self, action: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> list[Any]:
        """The results of all runs. Hooks and companion get the number of the repetition (from 0) and the result before it."""
        results, n = [action()], 0
        while (self.times is None or n < self.times) and self.only_if(n):
            pause = self.pause * (1 + random.uniform(-self.jitter_factor, self.jitter_factor)) if self.companion is None else self.companion(n, results[-1])
            if pause is None:
                break
            self.before(n, results[-1])
            sleep(pause)
            results.append(action())
            self.after(n, results[-2])
            n += 1
        return results
