"""Expectations about a sequence's rows and end, for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from braidwork.plans.seq import Seq


class Verifier:
    def __init__(self, seq: Seq, column: str | None = None):
        self.seq, self.column, self.steps = seq, column, []

    def expect_next(self, *values: Any) -> Verifier:
        self.steps += [("is", v) for v in values]
        return self

    def expect_next_matches(self, test: Callable[[Any], bool]) -> Verifier:
        self.steps.append(("matches", test))
        return self

    def expect_next_count(self, n: int) -> Verifier:
        self.steps.append(("count", n))
        return self

    def expect_next_sequence(self, values: Iterable[Any]) -> Verifier:
        return self.expect_next(*values)

    def assert_next(self, test: Callable[[Any], None]) -> Verifier:
        """test(value) raises if it doesn't like the row."""
        self.steps.append(("asserts", test))
        return self

    def expect_recorded_matches(self, test: Callable[[list], bool]) -> Verifier:
        """All rows that are left, as a list."""
        self.steps.append(("rest", test))
        return self

    def then_consume_while(self, test: Callable[[Any], bool]) -> Verifier:
        self.steps.append(("while", test))
        return self

    def verify_complete(self) -> None:
        rows = self.seq.collect_rows()
        values = [r[self.column] if self.column else tuple(r) for r in rows]
        for kind, what in self.steps:
            if kind == "count":
                assert len(values) >= what, f"expected {what} more rows, there are {len(values)}"
                values = values[what:]
            elif kind == "while":
                while values and what(values[0]):
                    values.pop(0)
            elif kind == "rest":
                assert what(values), f"the rows left don't match: {values[:5]!r}"
                values = []
            elif kind == "asserts":
                assert values, "expected another row, the sequence ended"
                what(values.pop(0))
            else:
                assert values, f"expected another row ({kind} {what!r}), the sequence ended"
                value = values.pop(0)
                assert value == what if kind == "is" else what(value), f"row {value!r}: not {what!r}"
        assert not values, f"unexpected rows: {values[:5]!r}"

    def verify_error_matches(self, test: Callable[[BaseException], bool]) -> None:
        try:
            self.seq.collect_rows()
        except Exception as error:
            assert test(error), f"failed otherwise: {error}"
        else:
            raise AssertionError("completed instead of failing")

    def verify_error(self, message: str = "") -> None:
        try:
            self.seq.collect_rows()
        except Exception as error:
            assert message in str(error), f"failed otherwise: {error}"
        else:
            raise AssertionError("completed instead of failing")


def verify(seq: Seq, column: str | None = None) -> Verifier:
    return Verifier(seq, column)


class Probe:
    """Counts how often a sequence is run, ends, fails and is cancelled."""

    def __init__(self, seq: Seq):
        self.subscribed = self.completed = self.failed = self.cancelled = 0

        def count(name: str) -> Callable[..., None]:
            return lambda *_: setattr(self, name, getattr(self, name) + 1)

        self.seq = seq.do_on_subscribe(count("subscribed")).do_on_complete(count("completed")).do_on_error(count("failed")).do_on_cancel(count("cancelled"))

    def assert_was_subscribed(self) -> None:
        assert self.subscribed, "never run"

    def assert_was_not_subscribed(self) -> None:
        assert not self.subscribed, f"run {self.subscribed} times"

    def assert_was_cancelled(self) -> None:
        assert self.cancelled, "never cancelled"


class VirtualClock:
    """A clock that a test moves: for caches and sinks with a time to live, and as a pause for retries."""

    def __init__(self, now: float = 0.0):
        self.now = now

    def __call__(self) -> float:
        return self.now

    def advance(self, seconds: float) -> None:
        self.now += seconds

    sleep = advance
