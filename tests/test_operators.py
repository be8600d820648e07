"""Operators against literal sequences and element-at-a-time loops."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidwork import sources
from braidwork.functions.context import Context
from braidwork.functions.retry import Repeat, Retry, RetryExhausted
from braidwork.operators.control import TimedOut, when
from braidwork.plans.seq import Seq


def ints(spark, *values):
    return sources.just(spark, *values, schema="value int")


def values(seq, column="value"):
    return [r[column] for r in seq.sorted_df().collect()]


def lists(seq):
    return [r["values"] for r in seq.collect_windows(F.col("value")).sorted_df().collect()]


@pytest.fixture(params=["window", "chunks"])
def ten(spark, request):
    """1..10, with positional functions by plain windows and by range chunks."""
    spark.conf.set("spark.braidwork.singleTaskBytes", str(256 << 20) if request.param == "window" else "0")
    yield ints(spark, *range(1, 11))
    spark.conf.unset("spark.braidwork.singleTaskBytes")


@pytest.mark.parametrize(
    "size, skip, expected",
    [
        (2, None, [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]]),
        (2, 3, [[1, 2], [4, 5], [7, 8], [10]]),
        (2, 1, [[i, i + 1] for i in range(1, 10)] + [[10]]),
        (3, 2, [[1, 2, 3], [3, 4, 5], [5, 6, 7], [7, 8, 9], [9, 10]]),
    ],
)
def test_count_windows(ten, size, skip, expected):
    assert lists(ten.window(size, skip)) == expected


def test_window_while_shows_empty_windows(ten):
    counts = ten.take(9).window_while_counts(F.col("value") % 3 == 0)
    assert [r.n for r in counts.sorted_df().collect()] == [0, 0, 1, 0, 1, 0, 1]


def test_changes(spark, ten):
    seq = ints(spark, 1, 1, 2, 2, 1, 1, 2, 2, 1, 2, 3, 3)
    assert values(seq.distinct_until_changed(F.col("value"))) == [1, 2, 1, 2, 1, 2, 3]
    zero = ints(spark, 0, 1, 2, 3, 4)
    assert lists(zero.window_until_changed(F.expr("value div 2"))) == [[0, 1], [2, 3], [4]]
    assert lists(zero.window_until_changed(F.col("value"))) == [[0], [1], [2], [3], [4]]


def test_cuts(ten):
    v = F.col("value")
    assert values(ten.take_while(v < 4)) == [1, 2, 3]
    assert values(ten.take_until(v >= 4)) == [1, 2, 3, 4]
    assert values(ten.skip_until(v > 4)) == [5, 6, 7, 8, 9, 10]
    assert values(ten.skip_while(v < 9)) == [9, 10]
    assert values(ten.take_last(5)) == [6, 7, 8, 9, 10]
    assert values(ten.skip_last(8)) == [1, 2]
    assert values(ten.skip_last(20)) == []
    assert values(ten.skip(7)) == [8, 9, 10]
    assert values(ten.take_while(v < 99)) == list(range(1, 11))
    assert values(ten.skip_until(v > 99)) == []


def test_positions_and_folds(ten):
    assert [r["index"] for r in ten.index().sorted_df().collect()] == list(range(10))
    assert values(ten.scan(F.col("value"), name="s"), "s") == [1, 3, 6, 10, 15, 21, 28, 36, 45, 55]
    assert values(ten.scan(F.col("value"), name="s", seed=F.lit(0)), "s") == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 55]
    assert values(ten.scan(F.col("value"), "last", name="s"), "s") == list(range(1, 11))


def test_single_rows(spark, ten):
    assert values(ten.element_at(3)) == [4]
    assert values(ten.element_at(30, {"seq": 0, "value": -1})) == [-1]
    with pytest.raises(PySparkException, match="source had 10 elements, expected at least 31"):
        ten.element_at(30).collect_rows()
    none = ten.filter(F.lit(False))
    with pytest.raises(PySparkException, match="empty"):
        none.last().collect_rows()
    with pytest.raises(PySparkException, match="empty"):
        none.single().collect_rows()
    with pytest.raises(PySparkException, match="more than one"):
        ten.single_or_empty().collect_rows()
    assert values(none.single_or_empty()) == []
    assert values(none.default_if_empty({"seq": 0, "value": 7})) == [7]
    assert ten.block_first().value == 1 and ten.block_last().value == 10


def test_empty_folds(ten):
    none = ten.filter(F.lit(False))
    assert none.count().block().n == 0
    assert none.any(F.col("value") > 1).block()["any"] is False
    assert none.all(F.col("value") > 1).block()["all"] is True
    assert none.reduce("sum", F.col("value")).collect_rows() == []
    assert none.reduce("sum", F.col("value"), seed=F.lit(5)).block().value == 5
    assert none.collect_list(F.col("value")).block()["values"] == []
    assert none.has_elements().block().has_elements is False


def test_strict_map_rejects_null(ten):
    with pytest.raises(PySparkException, match="gave null"):
        ten.map(strict=True, x=F.when(F.col("value") > 3, 1)).collect_rows()


def test_latest(spark):
    main = sources.just(spark, *[{"value": v, "ts": f"2024-01-01 00:00:{v:02d}"} for v in range(1, 11)])
    main = Seq(main.df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "seq", "ts")
    other = Seq(spark.sql("SELECT 0L AS seq, 10 AS value, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts"), "seq", "ts")
    assert [r.value + r.latest.value for r in main.with_latest_from(other).sorted_df().collect()] == list(range(11, 21))
    assert main.with_latest_from(other.filter(F.lit(False))).collect_rows() == []
    assert main.combine_latest(other.filter(F.lit(False))).collect_rows() == []


def test_merge_comparing(spark, ten):
    a, b = ints(spark, 1, 3, 5, 7), ints(spark, 2, 4, 6, 8, 10)
    assert values(a.merge_comparing(b, by=["value"])) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    heads, merged = [[5, 1, 6], [2, 9, 3]], []
    while any(heads):
        i = min((h[0], i) for i, h in enumerate(heads) if h)[1]
        merged.append(heads[i].pop(0))
    assert values(ints(spark, 5, 1, 6).merge_comparing(ints(spark, 2, 9, 3), by=["value"])) == merged


def timed(spark, *seconds):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "seq long, second int")
    return Seq(rows.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second)")), "seq", "ts")


def test_overlap_join(spark):
    left, right = timed(spark, 0, 10, 20), timed(spark, 5, 12, 13, 40)
    pairs = {(r.l_second, r.r_second) for r in left.join(right, 5, 2).collect_rows()}
    assert pairs == {(l, r) for l in (0, 10, 20) for r in (5, 12, 13, 40) if l - 2 <= r <= l + 5}
    counts = {r.l_second: r.n for r in left.group_join(right, 5).collect_rows()}
    assert counts == {0: 1, 10: 2, 20: 0}


def test_time_folds(spark):
    seq = timed(spark, 0, 1, 2, 10, 11, 30)
    assert values(seq.sample_first(5), "second") == [0, 10, 30]
    assert values(seq.sample_timeout(3), "second") == [2, 11, 30]
    assert values(seq.sample(10), "second") == [2, 11, 30]
    assert [r.n for r in seq.buffer_timeout(2, 5).sorted_df().collect()] == [2, 1, 2, 1]
    outs, at = [], 0
    for s in (0, 1, 2, 10, 11, 30):
        at = max(s, at) + 4
        outs.append(at)
    base = seq.df.agg(F.min(seq.micros()).alias("m")).first().m
    assert [(r.out_us - base) // 1_000_000 for r in seq.delay_elements(4).sorted_df().collect()] == outs
    with pytest.raises(PySparkException, match="no row within"):
        seq.timeout(5).collect_rows()
    assert values(seq.timeout(5, fallback=timed(spark, 99)), "second") == [0, 1, 2, 99]
    assert [r.n for r in seq.window_time_counts(5).sorted_df().collect()] == [3, 0, 2, 0, 0, 0, 1]


def test_cut_before_shows_an_empty_first_window(spark, ten):
    counts = ints(spark, 3, 1, 3, 2).window_until_counts(F.col("value") == 3, cut_before=True)
    assert [r.n for r in counts.sorted_df().collect()] == [0, 2, 2]


def test_errors_as_data(spark, ten):
    bad = F.col("value") == 4
    assert values(ten.on_error_complete(bad)) == [1, 2, 3]
    assert values(ten.on_error_return(bad, {"seq": 99, "value": -1})) == [1, 2, 3, -1]
    assert values(ten.on_error_resume(bad, ints(spark, 8, 9))) == [1, 2, 3, 8, 9]
    kept, dead = ten.on_error_continue(bad)
    assert values(kept) == [1, 2, 3, 5, 6, 7, 8, 9, 10] and dead.count() == 1
    with pytest.raises(PySparkException, match="broken"):
        ten.error_if(bad, "broken").collect_rows()
    signals = ten.take(2).materialize("value")
    assert [r.type for r in signals.sorted_df().collect()] == ["NEXT", "NEXT", "COMPLETE"]
    assert values(signals.dematerialize()) == [1, 2]


def test_hooks_and_retry(spark, ten):
    seen = []
    seq = ten.do_first(lambda: seen.append("b")).do_first(lambda: seen.append("a")).do_on_complete(lambda: seen.append("done")).do_finally(lambda: seen.append("end"))
    seq.then()
    assert seen == ["a", "b", "done", "end"]
    failing, errors = ten.error_if(F.lit(True), "always"), []
    failing.subscribe(lambda r: None, errors.append)
    assert len(errors) == 1
    with pytest.raises(RetryExhausted):
        failing.retry(2).then()
    with pytest.raises(ValueError, match="mapped"):
        failing.on_error_map(lambda e: ValueError("mapped")).then()
    with pytest.raises(ExceptionGroup):
        when(failing, ten, failing, delay_error=True)
    got = []
    ten.take(3).subscribe(lambda r: got.append(r.value))
    assert got == [1, 2, 3]


def test_backoff_stays_within_its_bounds():
    spec = Retry.backoff(5, 1.0).with_max_backoff(10.0)
    for n in range(8):
        base = min(2.0**n, 10.0)
        assert max(1.0, base * 0.5) <= spec.delay(n, lambda a, b: a) <= spec.delay(n, lambda a, b: b) <= min(10.0, base * 1.5)
    assert Retry.fixed_delay(3, 2.0).delay(7) == 2.0
    calls = []
    assert Retry.max(3).run(lambda: calls.append(1) or (1 / 0 if len(calls) < 3 else "ok"), sleep=lambda s: None) == "ok"
    assert Repeat.of(2).run(lambda: 1, sleep=lambda s: None) == [1, 1, 1]


def test_context():
    a = Context({"x": 1})
    b = a.put("y", 2)
    assert dict(a) == {"x": 1} and b["y"] == 2 and b.delete("x").get_or_default("x", 0) == 0
    with pytest.raises(ValueError):
        a.put("z", None)


def test_sharing(spark, ten):
    shared = ten.replay(last=2).auto_connect(1)
    assert not shared.connected
    assert values(shared.reader()) == [9, 10] and shared.connected
    shared.release()
    assert not shared.connected
    now = [0.0]
    cached = ten.cache(ttl=5)
    cached.clock = lambda: now[0]
    cached.get()
    now[0] = 6.0
    cached.get()
    assert cached.since == 6.0
    cached.invalidate()
    rails = ten.parallel(3)
    assert rails.parallelism() == 3 and rails.reduce("sum", F.col("value")).block().value == 55
    seeded = rails.reduce("sum", F.col("value"), seed=F.lit(0)).collect_rows()
    assert sum(r.value for r in seeded) == 55 and len(seeded) <= 3


def test_sinks_and_sources(spark):
    many = sources.sink_many(spark, "value int", limit=2)
    for i in range(4):
        many.emit_next(i)
    assert values(many.as_seq()) == [2, 3]
    assert many.try_emit_complete() == "OK" and many.try_emit_next(9) == "FAIL_TERMINATED"
    one = sources.sink_one(spark, "value int")
    assert one.try_emit_value(1) == "OK" and one.try_emit_value(2) == "FAIL_TERMINATED"
    failed = sources.sink_many(spark, "value int")
    failed.try_emit_error("lost")
    with pytest.raises(PySparkException, match="lost"):
        failed.as_seq().collect_rows()
    with pytest.raises(PySparkException, match="boom"):
        sources.error(spark, "boom").collect_rows()
    freed = []
    with sources.using(lambda: 3, lambda n: ints(spark, *range(n)), freed.append) as seq:
        assert values(seq) == [0, 1, 2]
    assert freed == [3]
    assert values(sources.from_callable(spark, lambda: 5)) == [5] and sources.from_callable(spark, lambda: None).collect_rows() == []


def test_block_gives_up(spark):
    import time

    def slow(frames):
        time.sleep(20)
        yield from frames

    seq = Seq(spark.range(1).mapInPandas(slow, "id long"), "id")
    with pytest.raises(TimedOut):
        seq.block_first(timeout=2)


def test_test_kit_hooks_and_schedulers(spark, ten):
    from braidwork.functions import hooks, schedulers
    from braidwork.plans.verify import verify

    verify(ten, "value").expect_next(1, 2).expect_next_count(3).expect_next_matches(lambda v: v == 6).then_consume_while(lambda v: v < 10).expect_next(10).verify_complete()
    verify(ten.error_if(F.col("value") == 3, "three")).verify_error("three")
    with pytest.raises(AssertionError):
        verify(ten, "value").expect_next(2).verify_complete()
    hooks.on_each_operator("mark", lambda df: df.hint("mark"))
    assert values(ten.filter(F.col("value") > 8)) == [9, 10]
    hooks.reset_on_each_operator()
    assert schedulers.immediate().schedule(lambda: 5).result() == 5
    pool = schedulers.single()
    assert pool.schedule(lambda: 6, 0.01).result(5) == 6
    ticks = []
    stop = pool.schedule_periodically(lambda: ticks.append(1), 0.0, 0.01)
    import time

    time.sleep(0.2)
    stop()
    pool.dispose()
    assert len(ticks) > 2


def test_optional_and_zip_when(ten):
    assert ten.filter(F.lit(False)).single_optional().block().value is None
    assert ten.filter(F.col("value") == 3).single_optional().block().value.value == 3
    assert [r.pair.twice for r in ten.take(2).zip_when("pair", twice=F.col("value") * 2).collect_rows()] == [2, 4]


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_files(spark, ten, tmp_path, format):
    path = str(tmp_path / format)
    ten.write(path, format, header="true")
    options = {"header": "true", "inferSchema": "true"} if format == "csv" else {}
    back = sources.from_(path, "seq", spark=spark, format=format, **options)
    assert values(back) == list(range(1, 11))
    ten.df.createOrReplaceTempView("ten_rows")
    assert values(sources.from_("ten_rows", "seq", spark=spark).take(2)) == [1, 2]


def test_streams_equal_batches(spark, tmp_path):
    from braidwork import streaming

    seq = timed(spark, 0, 1, 2, 10, 11, 30, 31, 32, 33)
    df = seq.df.withColumn("user", F.col("seq") % 2).withColumn("us", seq.micros())
    path = str(tmp_path / "t.parquet")
    df.repartition(3).write.parquet(path)
    keyed = Seq(df, "seq", "ts", ["user"])
    got = streaming.run_available(spark, path, lambda s: streaming.sample_first(s, ["user"], "us", 5_000_000))
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in keyed.sample_first(5).collect_rows())
    counts = streaming.run_available(spark, path, lambda s: streaming.tumbling_counts(s, "ts", "10 seconds", "0 seconds"), "complete")
    assert sorted(r.n for r in counts.collect()) == [2, 3, 4]
    first = streaming.run_available(spark, path, lambda s: streaming.distinct(s, "ts", "1 hour", ["user"]))
    assert sorted(r.user for r in first.collect()) == [0, 1]
