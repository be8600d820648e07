"""Sequences cut into chunks, one key hot: the same results as one task or loop, and no task with much more than others."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.plans import gates
from braidwork.plans.ordered import CHUNK, Ordered
from braidwork.plans.seq import Seq

T0 = dt.datetime(2024, 1, 1)
MICROS = 1_704_067_200_000_000


@pytest.fixture
def chunks(spark):
    """One task may hold nothing: everything is chunked."""
    spark.conf.set("spark.braidwork.singleTaskBytes", "0")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.braidwork.singleTaskBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows_of(n, keyed, seed, steps=(0, 0, 1, 1, 2, 3, 9, 40), nulls=0.0, backwards=0.0):
    """(id, key, seconds, value): nine tenths of the rows in key `hot`, null among the others."""
    rng, at, rows = random.Random(seed), defaultdict(int), []
    for i in range(n):
        key = ("hot" if rng.random() < 0.9 else rng.choice([None, "a", "b", "c", "z"])) if keyed else "all"
        at[key] += rng.choice(steps)
        seconds = None if rng.random() < nulls else at[key] - (rng.randrange(30) if rng.random() < backwards else 0)
        rows.append((i, key, seconds, rng.choice([None, 1, 2, 3, 5])))
    return rows


def seq_of(spark, rows, keyed):
    data = [(i, k, None if s is None else T0 + dt.timedelta(seconds=s), v) for i, k, s, v in rows]
    df = spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, value long").repartition(5)
    return Seq(df, "id", "ts", ["key"] if keyed else [])


def by_key(rows):
    keys = defaultdict(list)
    for r in rows:
        keys[r[1]].append(r)
    return keys.values()


def windows_plainly(rows, size, length):
    out = {}
    for group in by_key(rows):
        window, start, n, last = -1, None, 0, 0
        for i, _, at, _ in group:
            at = last = last if at is None else at * 1_000_000 + MICROS
            if start is None or n >= size or at >= start + length * 1_000_000:
                window, start, n = window + 1, at, 0
            n += 1
            out[i] = window
    return out


def restarted_plainly(rows, size, length):
    out = {}
    for group in by_key(rows):
        window, start, n = 0, None, 0
        for i, _, at, _ in group:
            start = at if start is None else start
            while at >= start + length:
                window, start, n = window + 1, start + length, 0
            n += 1
            out[i] = window
            if n == size:
                window, start, n = window + 1, at, 0
    return out


def passed_plainly(rows, length):
    out = []
    for group in by_key(rows):
        closed = None
        for i, _, at, _ in group:
            if at is not None and (closed is None or at >= closed):
                out.append(i)
                closed = at + length
    return sorted(out)


def latest_plainly(rows, drain):
    """The consumer's own view: it takes what waits when it is free, or else the next row."""
    out = {}
    for group in by_key(rows):
        free, waiting = None, None
        for i, _, at, _ in group:
            if free is not None and waiting is not None and at > free:
                out[waiting], free, waiting = free, free + drain, None
            if free is None or at >= free:
                out[i], free, waiting = at, at + drain, None
            else:
                waiting = i
        if waiting is not None:
            out[waiting] = free
    return out


def queue_plainly(rows, drain, size):
    out = {}
    for group in by_key(rows):
        taken = []
        for i, _, at, _ in group:
            waiting = [t for t in taken if t > at]
            turn = max(at, taken[-1] + drain) if taken else at
            if turn > at and len(waiting) >= size:
                continue
            taken.append(turn)
            out[i] = turn
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("size,length", [(3, 5), (1000, 7), (50, 100_000)])
def test_window_timeout(spark, chunks, keyed, size, length):
    rows = rows_of(400, keyed, size + length, nulls=0.1 if size == 3 else 0)
    got = {r.id: r.window_id for r in seq_of(spark, rows, keyed).window_timeout(size, length).df.collect()}
    assert got == windows_plainly(rows, size, length)


@pytest.mark.parametrize("keyed", [False, True])
def test_window_timeout_with_times_that_run_backwards(spark, chunks, keyed):
    rows = rows_of(400, keyed, 3, backwards=0.3)
    got = {r.id: r.window_id for r in seq_of(spark, rows, keyed).window_timeout(6, 8).df.collect()}
    assert got == windows_plainly(rows, 6, 8)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("length", [1, 6, 500])
def test_sample_first(spark, chunks, keyed, length):
    rows = rows_of(400, keyed, length, nulls=0.05, backwards=0.2)
    seq = seq_of(spark, rows, keyed)
    right = passed_plainly(rows, length)
    assert sorted(r.id for r in seq.sample_first(length).df.collect()) == right
    assert sorted(r.id for r in seq.on_backpressure_drop(length).df.collect()) == right


@pytest.mark.parametrize("keyed", [False, True])
def test_gates_that_carry_a_state(spark, chunks, keyed):
    for seed, drain in ((1, 3), (3, 40)) if keyed else ((2, 4),):
        rows = rows_of(500, keyed, seed)
        seq = seq_of(spark, rows, keyed)
        seconds = lambda out: {r.id: (r.out_us - MICROS) // 1_000_000 for r in out.df.collect()}
        assert seconds(seq.on_backpressure_latest(drain)) == latest_plainly(rows, drain)
        for size in (0, 2):
            assert seconds(seq.on_backpressure_buffer(drain, size, "drop")) == queue_plainly(rows, drain, size)
        assert seconds(seq.on_backpressure_buffer(drain)) == queue_plainly(rows, drain, 10**9)
        got = {r.id: r.window_id for r in seq.window_timeout(4, drain, restart=True).df.collect()}
        assert got == restarted_plainly(rows, 4, drain)
    with pytest.raises(Exception, match="rows wait"):
        seq.on_backpressure_buffer(40, 3).df.collect()


def test_guesses_that_never_agree(spark, chunks, monkeypatch):
    """Windows by time alone keep their phase for ever, so each chunk waits for the one ahead."""
    monkeypatch.setattr(gates, "GUESSES", 2)
    rows = rows_of(400, False, 9, steps=(3,))
    got = {r.id: r.window_id for r in seq_of(spark, rows, False).window_timeout(1000, 7, restart=True).df.collect()}
    assert got == restarted_plainly(rows, 1000, 7)


def test_bad_lengths(spark):
    seq = seq_of(spark, rows_of(5, False, 0), False)
    for wrong in (lambda: seq.sample_first(0), lambda: seq.window_timeout(0, 5)):
        with pytest.raises(ValueError):
            wrong()


def test_a_million_rows_in_one_sequence(spark, chunks):
    df = spark.range(1_000_000).select("id", F.expr("timestampadd(MICROSECOND, (id * id) % 7919 + id * 1000, TIMESTAMP_NTZ'2024-01-01')").alias("ts"))
    windows = Seq(df, "id", "ts").window_timeout(37, 0.05)
    n = np.arange(1_000_000, dtype=np.int64)
    t, opens, window = n * n % 7919 + n * 1000, [], -1
    start, count = None, 0
    for at in t.tolist():
        if start is None or count == 37 or at >= start + 50_000:
            window, start, count = window + 1, at, 0
            opens.append(at)
        count += 1
    got = windows.per_window(F.count("*").alias("n"), F.min(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)")).alias("low")).df
    assert got.count() == window + 1 and got.agg(F.sum("n"), F.max("window_id")).first()[:] == (1_000_000, window)


FUNCTIONS = {
    "index": lambda s: s.index("x"),
    "scan": lambda s: s.scan(F.col("value"), "sum", "x"),
    "count": lambda s: s.scan(F.col("value"), "count", "x"),
    "max": lambda s: s.scan(F.col("value"), "max", "x"),
    "last": lambda s: s.scan(F.col("value"), "last", "x"),
    "elapsed": lambda s: s.elapsed("x"),
    "changed": lambda s: s.window_until_changed(F.col("value")).df.withColumnRenamed("window_id", "x"),
    "until": lambda s: s.window_until(F.col("value") == 5).df.withColumnRenamed("window_id", "x"),
    "delayed": lambda s: s.delay_elements(3, "x"),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_positional_functions_under_a_hot_key(spark, name):
    rows = rows_of(800, True, 5)
    found = {}
    for most in ("0", str(1 << 40)):
        spark.conf.set("spark.braidwork.singleTaskBytes", most)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        out = FUNCTIONS[name](seq_of(spark, rows, True))
        found[most] = {r.id: r.x for r in getattr(out, "df", out).collect()}
    spark.conf.unset("spark.braidwork.singleTaskBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found["0"]) == 800 and found["0"] == found[str(1 << 40)]


def test_a_hot_key_is_dealt_evenly(spark, chunks):
    rows = rows_of(4000, True, 5)
    seq = seq_of(spark, rows, True)
    ordered = Ordered(seq.df, seq.order, seq.keys)
    sizes = [r["count"] for r in ordered.df.groupBy(CHUNK).count().collect()]
    assert ordered.chunked and len(sizes) > 5 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    assert ordered.borders().count() <= 2 * len(sizes)
    spark.conf.set("spark.braidwork.singleTaskBytes", "1000")
    mild = Ordered(spark.range(5000).withColumn("key", F.col("id") % 1000), ["id"], ["key"])
    assert not mild.chunked  # no key is large, so a key stays whole


# Lives that meet, where one time is dense, and long spines.


def lives(spark, n, seed):
    """Half of all rows within one minute."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "b", None]), None if i % 50 == 7 else rng.randrange(60) if i % 2 else rng.randrange(5000), i) for i in range(n)]
    return rows, seq_of(spark, rows, False)


@pytest.mark.parametrize("on", [None, ["key"]])
def test_lives_that_meet_in_a_burst(spark, chunks, monkeypatch, on):
    from braidwork.operators import combine

    monkeypatch.setattr(combine, "DENSE", 10)
    left, right = lives(spark, 120, 1), lives(spark, 150, 2)
    pairs = {(a[0], b[0]) for a in left[0] for b in right[0] if a[2] is not None and b[2] is not None and a[2] - 7 <= b[2] <= a[2] + 40 and (on is None or (a[1] is not None and a[1] == b[1]))}
    got = [(r.l_id, r.r_id) for r in left[1].join(right[1], 40, 7, on).df.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    counts = {r.l_id: (r.n, r.l_value) for r in left[1].group_join(right[1], 40, 7, on).df.collect()}
    assert counts == {a[0]: (sum(x == a[0] for x, _ in pairs), a[3]) for a in left[0]}
    listed = {r.l_id: r["values"] for r in left[1].group_join(right[1], 40, 7, on, collect="value").df.collect()}
    assert listed == {a[0]: sorted(b for x, b in pairs if x == a[0]) for a in left[0]}


def test_group_join_counts_without_pairs(spark):
    seq = Seq(spark.range(20).select("id", F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01')").alias("ts")), "id", "ts")
    plan = seq.group_join(seq, 40).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_spines(spark, monkeypatch):
    from braidwork import sources
    from braidwork.operators import windows

    ticks = sources.interval(spark, "2000-01-01", "2003-03-04 09:46:39.9", "1 second")
    assert ticks.df.count() == int((dt.datetime(2003, 3, 4, 9, 46, 39) - dt.datetime(2000, 1, 1)).total_seconds()) + 1
    assert "sequence" not in ticks.df._jdf.queryExecution().optimizedPlan().toString()
    assert [(str(r.ts), r.value) for r in sources.interval(spark, "2024-01-31", "2024-05-01", "1 month").df.orderBy("ts").collect()][:2] == [("2024-01-31 00:00:00", 0), ("2024-02-29 00:00:00", 1)]
    assert sources.interval(spark, "2024-01-02", "2024-01-01", "1 day").df.count() == 0
    monkeypatch.setattr(windows, "SPINE", 3)
    seq = seq_of(spark, [(0, "a", 0, 1), (1, "a", 100, 1), (2, "b", 5, 1)], True)
    got = [(r.key, r.window_id, r.n) for r in seq.window_time_counts(10).df.orderBy("key", "window_id").collect()]
    assert got == [("a", i, int(i in (0, 10))) for i in range(11)] + [("b", 0, 1)]


def test_sizes_that_the_optimiser_does_not_know(spark):
    """Local rows are counted, so a few of them are never cut into chunks; nor do crossed single rows make a table seem large."""
    from braidwork.plans.ordered import SINGLE_TASK_BYTES, input_bytes

    rows = spark.createDataFrame([(i, "k") for i in range(100)], "id long, key string")
    assert 100 < input_bytes(rows) < 10_000 and not Ordered(rows, ["id"]).chunked and not Ordered(rows, ["id"], ["key"]).chunked
    crossed = rows
    for i in range(6):
        crossed = crossed.crossJoin(F.broadcast(rows.agg(F.max("id").alias(f"m{i}"))))
    assert input_bytes(crossed) < SINGLE_TASK_BYTES and not Ordered(crossed, ["id"]).chunked


def test_small_files_of_many_rows(spark, tmp_path):
    """What one task sorts goes by the rows, not by the files, which are many times smaller."""
    path = str(tmp_path / "rows")
    spark.range(3_000_000).select("id", (F.col("id") % 7).alias("key"), F.lit(1).cast("long").alias("value")).write.parquet(path)
    rows = spark.read.parquet(path)
    assert Ordered(rows, ["id"]).chunked and not Ordered(rows, ["id"], ["key"]).chunked
    hot = rows.withColumn("key", F.when(F.col("id") % 100 == 0, F.col("key")).otherwise(9))
    assert Ordered(hot, ["id"], ["key"]).chunked
    assert not Ordered(rows.where("id < 1000000"), ["id"]).chunked
    wrong = Seq(rows, "id").index().df.where("index != id")
    assert wrong.count() == 0


def test_more_chunks_than_partitions(spark, monkeypatch):
    """Large inputs have more chunks than a shuffle usually has partitions, and as many tasks."""
    from braidwork.plans import ordered

    rows = rows_of(400, False, 3)
    plain = seq_of(spark, rows, False)

    def found(seq):
        other = seq.with_df(seq.df.where("id != 77"))
        zipped = sorted((r.position, r.z0.id, r.z1.id) for r in seq.zip(other).df.collect())
        equal = [seq.sequence_equal(s, ["id", "value"]).df.first()[0] for s in (seq, other)]
        held = sorted((r.id, r.source_ord, r["_held"].value) for r in seq.merge_comparing(other, by=["value"]).df.collect())
        gated = sorted((r.id, r.window_id) for r in seq.window_timeout(7, 30).df.collect())
        late = sorted((r.id, r.window_id) for r in seq.window_timeout(7, 30, restart=True).df.collect())
        return zipped, equal, held, gated, late, sorted(r.id for r in seq.sample_timeout(8).df.collect())

    expected = found(plain)
    assert expected[1] == [True, False]
    spark.conf.set("spark.braidwork.singleTaskBytes", "0")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    monkeypatch.setattr(ordered, "CHUNK_BYTES", 1000)
    try:
        positioned = Ordered(plain.df, ["id"]).position("_pos")
        assert positioned.parts > 10 and positioned.df.rdd.getNumPartitions() == positioned.parts
        assert found(plain) == expected
    finally:
        spark.conf.unset("spark.braidwork.singleTaskBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_task_holds_one_chunk(spark, monkeypatch):
    """Chunks are dealt one to a task, however many there are; by hash several would meet in one, and more so the more there are."""
    from braidwork.plans import ordered

    spark.conf.set("spark.braidwork.singleTaskBytes", "0")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    monkeypatch.setattr(ordered, "BELIEVED", 0)
    try:
        for most in (1 << 20, 20_000):  # as many chunks as partitions, and more
            monkeypatch.setattr(ordered, "CHUNK_BYTES", most)
            cut = Ordered(spark.range(0, 20_000, 1, 5), ["id"])
            assert (cut.parts > 24) == (most == 20_000)
            placed = cut.position("_pos").neighbour("_next", F.col("id"), 1)
            tasks = placed.df.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(CHUNK).alias("chunks")).collect()
            assert [t.chunks for t in tasks] == [1] * cut.parts
            wrong = placed.df.where("_pos != id OR coalesce(_next, 20000) != id + 1")
            assert placed.df.count() == 20_000 and wrong.count() == 0
            gated = gates.placed(cut, cut.df).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(CHUNK).alias("chunks")).collect()
            assert [t.chunks for t in gated] == [1] * cut.parts
    finally:
        spark.conf.unset("spark.braidwork.singleTaskBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunks_of_narrow_rows(spark):
    """A chunk is counted as a sort holds it: narrow rows take several times the bytes of their values."""
    rows = spark.range(9_000_000)
    spark.conf.set("spark.braidwork.singleTaskBytes", str(8 << 20))
    try:
        assert Ordered(rows, ["id"]).parts == 9_000_000 * 48 // (64 << 20)
    finally:
        spark.conf.unset("spark.braidwork.singleTaskBytes")


def test_table_functions_pass_rows_on_in_batches(spark):
    """What a row gives is no batch of its own, which costs more than the row."""

    class Same:
        def eval(self, row):
            yield row["id"], row["value"]

    made = seq_of(spark, rows_of(200, True, 4), True).flat_map_table(Same, "id long, value long", order=["id"])
    assert "ArrowEvalPythonUDTF" not in made.df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.value or 0) for r in made.df.collect()) == [(r[0], r[3] or 0) for r in rows_of(200, True, 4)]
