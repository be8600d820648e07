"""Cases that went wrong once: null keys, exact integers, keyed cuts, cancelled runs, batches of a stream that overlap in time."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from braidwork import sources, streaming
from braidwork.functions.retry import Repeat, Retry, RetryExhausted
from braidwork.operators.control import TimedOut
from braidwork.plans.seq import Seq
from braidwork.plans.verify import Probe, VirtualClock, verify
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def timed_rows(spark, rows, keyed=True):
    """rows: (id, key, seconds, value)."""
    data = [(i, k, T0 + dt.timedelta(seconds=s), v) for i, k, s, v in rows]
    df = spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, value long")
    return Seq(df, "id", "ts", ["key"] if keyed else [])


def test_folds_keep_null_keys_and_integers(spark):
    big = 2**53 + 1
    seq = timed_rows(spark, [(i, None, i, big if i else None) for i in range(5)] + [(9, "a", 0, 1)])
    assert [(r.id, r.value) for r in seq.sample_first(100).df.orderBy("id").collect()] == [(0, None), (9, 1)]
    windows = seq.window_timeout(3, 100).df.orderBy("id").collect()
    assert [(r.id, r.window_id, r.value) for r in windows] == [(0, 0, None), (1, 0, big), (2, 0, big), (3, 1, big), (4, 1, big), (9, 0, 1)]

    def numbered(rows):
        for n, row in enumerate(rows):
            yield {"id": row["id"], "key": row["key"], "n": n, "value": row["value"]}

    folded = seq.fold(numbered, "id long, key string, n long, value long").df.orderBy("id").collect()
    assert [(r.id, r.n, r.value) for r in folded] == [(0, 0, None), (1, 1, big), (2, 2, big), (3, 3, big), (4, 4, big), (9, 0, 1)]


def test_overflow_policies(spark):
    seq = timed_rows(spark, [(0, None, 0, 0), (1, None, 1, 0), (2, None, 2, 0), (3, None, 9, 0), (4, None, 10, 0), (5, None, 30, 0)], keyed=False)
    at = lambda out: [(r.id, (r.out_us - 1_704_067_200_000_000) // 1_000_000) for r in out.df.orderBy("id").collect()]
    assert [r.id for r in seq.on_backpressure_drop(5).df.orderBy("id").collect()] == [0, 3, 5]
    assert at(seq.on_backpressure_latest(5)) == [(0, 0), (2, 5), (4, 10), (5, 30)]
    assert at(seq.on_backpressure_buffer(5)) == [(0, 0), (1, 5), (2, 10), (3, 15), (4, 20), (5, 30)]
    assert at(seq.on_backpressure_buffer(5, 1, "drop")) == [(0, 0), (1, 5), (3, 10), (4, 15), (5, 30)]
    with pytest.raises(PySparkException, match="more than 1 rows wait"):
        seq.on_backpressure_buffer(5, 1).df.collect()
    with pytest.raises(PySparkException, match="more than 0 rows wait"):
        seq.on_backpressure_error(5).df.collect()
    assert seq.on_backpressure_drop().df.count() == 6


def test_timeout_by_key(spark):
    seq = timed_rows(spark, [(0, "a", 0, 0), (1, "a", 100, 0), (2, "b", 101, 0), (3, "b", 102, 0), (4, None, 5, 0), (5, None, 50, 0)])
    instead = Seq(spark.createDataFrame([(7, "a"), (8, "b"), (9, None)], "id long, key string"), "id", keys=["key"])
    assert sorted(r.id for r in seq.timeout(5, fallback=instead).df.collect()) == [0, 2, 3, 4, 7, 9]
    kept = seq.take_while(F.col("id") % 2 == 0).df.collect()
    assert sorted(r.id for r in kept) == [0, 2, 4]


def test_materialize_by_key(spark):
    rows = timed_rows(spark, [(0, "a", 0, 5), (1, "b", 0, 6), (2, "a", 0, 7)]).materialize("value").df.collect()
    assert sorted((r.key, r.signal_pos, r.type, r.value) for r in rows if r.type == "NEXT") == [("a", 0, "NEXT", 5), ("a", 1, "NEXT", 7), ("b", 0, "NEXT", 6)]
    assert sorted((r.key, r.signal_pos) for r in rows if r.type == "COMPLETE") == [("a", 2), ("b", 1)]


def test_switch_map_makes_no_pairs(spark):
    outer = timed_rows(spark, [(0, "a", 0, 0), (1, "b", 10, 0), (2, "c", 10, 0)], keyed=False)
    outer = outer.with_df(outer.df.select(F.col("id").alias("outer_id"), F.col("ts").alias("outer_ts")), ["outer_id"], ts="outer_ts")
    inner = timed_rows(spark, [(10, "x", -1, 0), (11, "x", 0, 0), (12, "x", 9, 0), (13, "x", 10, 0), (14, "x", 99, 0)], keyed=False)
    switched = outer.switch_map(inner)
    assert [(r.outer_id, r.id) for r in switched.df.orderBy("id").collect()] == [(0, 11), (0, 12), (2, 13), (2, 14)]
    plan = switched.df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_generators(spark):
    many = sources.generate(spark, "CAST(0 AS BIGINT)", "state + 1", until="n >= 250").df.collect()
    assert sorted(r.value for r in many) == list(range(250))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sources, "GENERATED", 120)
        with pytest.raises(PySparkException, match="not ended after 120 steps"):
            sources.generate(spark, "CAST(0 AS BIGINT)", "state + 1").df.collect()


def test_cancel_hooks(spark):
    slow = sources.range_(spark, 0, 8).map_pandas(lambda frames: (time.sleep(20) or f for f in frames), "value long")
    calls = []
    slow = slow.do_on_cancel(lambda: calls.append("cancel")).do_on_error(lambda e: calls.append("error")).do_finally(lambda: calls.append("finally"))
    with pytest.raises(TimedOut):
        slow.block_last(timeout=2)
    for _ in range(100):
        if "finally" in calls:
            break
        time.sleep(0.2)
    assert calls == ["cancel", "finally"]


def test_cold_subscription_loses_nothing(spark):
    seq = timed_rows(spark, [(0, None, 0, 0), (1, None, 5, 0)], keyed=False)
    began = time.monotonic()
    assert len(seq.delay_subscription(0.3).collect_rows()) == 2 and time.monotonic() - began >= 0.3
    assert [r.id for r in seq.delay_subscription(3, hot=True).collect_rows()] == [1]


def test_connect_fills(spark):
    kept = lambda: spark._jsc.sc().getPersistentRDDs().size()
    before, seq = kept(), sources.range_(spark, 0, 10)
    shared = seq.share()
    assert kept() == before and shared.reader().df.count() == 10 and kept() == before + 1
    shared.release()
    assert kept() == before
    assert seq.publish(lambda s: s.filter(F.col("value") > 7)).collect_rows() and kept() == before


def test_row_hooks_and_rails(spark):
    def refuse(row):
        if row["value"] == 3:
            raise ValueError("no threes")

    seq, ends = sources.range_(spark, 0, 5), []
    with pytest.raises(PySparkException, match="no threes"):
        seq.do_on_next(refuse).collect_rows()
    rails = seq.parallel(2).do_on_next(lambda row: None).do_on_complete(lambda: ends.append("complete")).do_on_terminate(lambda: ends.append("terminate"))
    rails.subscribe(lambda rows: [None for _ in rows])
    assert ends == ["complete", "terminate"] and rails.to_string().startswith("Rails(2") and rails.get_prefetch() == seq.get_prefetch()
    assert type(rails).from_(seq, 3).parallelism() == 3


def test_errors_are_translated_in_turn(spark):
    failing = sources.error(spark, "boom", "value int").on_error_map(lambda e: ValueError("first")).on_error_map(lambda e: KeyError(f"second after {e}"))
    with pytest.raises(KeyError, match="second after first"):
        failing.collect_rows()


def test_retries_in_a_row():
    def flaky(times):
        left = [times]

        def act():
            if left[0]:
                left[0] -= 1
                raise OSError("again")
            return times

        return act

    assert Retry.max_in_a_row(2).run_all([flaky(2), flaky(0), flaky(2)]) == [2, 0, 2]
    with pytest.raises(RetryExhausted):
        Retry.max(2).run_all([flaky(2), flaky(1)])


def test_rules_of_retries_and_repeats():
    tried, pauses, said = [], [], []

    def act():
        tried.append(1)
        if len(tried) < 4:
            raise OSError(f"failure {len(tried)}")
        return len(tried)

    rule = Retry.backoff(9, 1.0).jitter(0).with_multiplier(3.0).with_min_backoff(2.0).with_max_backoff(10.0).max_attempts(3).with_retry_context(a=1).with_retry_context(b=2)
    rule = rule.filter(lambda e: isinstance(e, OSError)).modify_error_filter(lambda f: lambda e: f(e) and "9" not in str(e)).do_before_retry(lambda n, e: said.append((n, str(e))))
    assert rule.run(act, pauses.append) == 4 and pauses == [2.0, 6.0, 10.0] and said[0] == (0, "failure 1") and rule.context == {"a": 1, "b": 2}
    assert Retry.backoff(9, 1.0).jitter(0).with_max_backoff(60).delay(5000) == 60
    tried.clear()
    with pytest.raises(OSError, match="failure 2"):
        Retry.from_(lambda n, e: 0.5 if n < 1 else None).run(act, pauses.append)
    assert Retry.max(1).transient_errors().transient and not Retry.max_in_a_row(2).transient_errors(False).transient
    runs, told = iter(range(9)), []
    rule = Repeat.from_(lambda n, result: 0.25 if result < 3 else None).do_before_repeat(lambda n, r: told.append(("before", n, r))).do_after_repeat(lambda n, r: told.append(("after", n, r)))
    pauses.clear()
    assert rule.run(lambda: next(runs), pauses.append) == [0, 1, 2, 3] and pauses == [0.25] * 3 and told[:2] == [("before", 0, 0), ("after", 0, 0)]
    assert Repeat.of(2).run(lambda: 7, lambda s: None) == [7, 7, 7]


def test_sinks(spark):
    clock = VirtualClock()
    many = sources.sink_multicast(spark, "value int")
    many.emit_next(1)
    late = many.reader()
    many.emit_next(2)
    assert [r.value for r in late.as_seq().collect_rows()] == [2] and many.as_seq().df.count() == 2
    lone = sources.sink_unicast(spark, "value int")
    lone.emit_next(1)
    assert lone.as_seq().df.count() == 1
    with pytest.raises(RuntimeError, match="one consumer"):
        lone.as_seq()
    old = sources.sink_replay(spark, "value int", max_age=10, clock=clock)
    old.emit_next(1)
    clock.advance(8)
    old.emit_next(2)
    clock.advance(5)
    assert [r.value for r in old.as_seq().collect_rows()] == [2]
    none = sources.sink_empty(spark, "value int")
    assert none.try_emit_next(1) == "FAIL_OVERFLOW" and none.try_emit_empty() == "OK" and none.as_seq().df.count() == 0


def test_verifier_and_probe(spark):
    probe = Probe(sources.just(spark, 1, 2, 3, schema="value int"))
    probe.assert_was_not_subscribed()
    verify(probe.seq, "value").expect_next_sequence([1]).assert_next(lambda v: None).expect_recorded_matches(lambda left: left == [3]).verify_complete()
    probe.assert_was_subscribed()
    assert (probe.completed, probe.failed, probe.cancelled) == (1, 0, 0)
    verify(sources.error(spark, "boom", "value int")).verify_error_matches(lambda e: "boom" in str(e))


def overlapping(spark, tmp_path):
    """Three files, one for each batch: the second has rows older than the first's."""
    for n, rows in enumerate([[(0, 10)], [(1, 0), (2, 3)], [(3, 100)], [(4, 300)]]):
        data = [(i, "k", T0 + dt.timedelta(seconds=s), s * 1_000_000) for i, s in rows]
        spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files come in the order of their times
    return str(tmp_path / "in")


def test_stream_folds_across_batches(spark, tmp_path):
    path = overlapping(spark, tmp_path)
    held = {"ts": "ts", "late": "20 seconds", "expire_ms": 50_000}
    first = streaming.run_available(spark, path, lambda s: streaming.sample_first(s, ["key"], "us", 5_000_000, **held), files=1)
    assert sorted(r.id for r in first.collect()) == [0, 1, 3]  # the newest row waits for the watermark
    windows = streaming.run_available(spark, path, lambda s: streaming.count_windows(s, ["key"], "us", 2, ts="ts", late="20 seconds"), files=1)
    assert sorted((r.id, r.window_id) for r in windows.collect()) == [(0, 1), (1, 0), (2, 0), (3, 1)]
    quiet = streaming.run_available(spark, path, lambda s: streaming.inactivity(s, ["key"], "ts", "20 seconds", "30 seconds"), files=1)
    found = quiet.select("key", (F.unix_millis("last_ts") - 1_704_067_200_000).alias("at")).orderBy("at").collect()
    assert [tuple(r) for r in found] == [("k", 10_000), ("k", 100_000)]
