"""Streams whose batches overlap in time, against the same operators in batch."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork import streaming
from braidwork.plans.seq import Seq

T0 = dt.datetime(2024, 1, 1)
FAR = 10**6


def table(spark, rows, extra=""):
    """rows: (id, key, seconds); id and key None at the end: a row far ahead, which lets the watermark pass all others."""
    data = [(i, k, T0 + dt.timedelta(seconds=s), f"{i}{extra}") for i, k, s in rows]
    return spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, said string")


def stream_of(spark, rows, batches=3):
    """As a stream: each batch reaches back behind the one before; the last one is far ahead."""
    df = table(spark, [*rows, (-1, "far", FAR)])
    seconds = F.timestamp_diff("SECOND", F.lit(T0), "ts")
    return streaming.read_available(spark, streaming.replayed(df, F.when(seconds == FAR, batches).otherwise(F.least(F.lit(batches - 1), F.floor((seconds + F.col("id") % 3 * 20) / 60))), batches + 1), 1)


def rows_of(n, seed, low=0):
    rng = random.Random(seed)
    return [(low + i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(150)) for i in range(n)]


def pairs(df):
    return Counter((r.l_id, r.l_said, r.r_id, r.r_ts) for r in df.collect() if r.r_id >= 0)


def test_window_when_over_overlapping_batches(spark):
    opened, rows = rows_of(25, 1), rows_of(120, 2, 1000)
    made = streaming.window_when(stream_of(spark, opened), stream_of(spark, rows), ["key"], "ts", "ts", "17 seconds", "100 seconds")
    got = pairs(streaming.run_stream(spark, made).withColumn("r_ts", F.col("r_ts").cast("timestamp_ntz")))
    batch = Seq(table(spark, rows), "id", "ts").window_when(Seq(table(spark, opened), "id", "ts"), 17, on=None).df
    right = Counter((r.l_id, r.l_said, r.r_id, r.r_ts) for r in batch.where(F.col("l_key").eqNullSafe(F.col("r_key"))).collect())
    assert len(right) > 100 and got == right


def test_window_when_with_closings(spark):
    opened, rows, closed = rows_of(15, 3), rows_of(80, 4, 1000), rows_of(10, 5, 2000)
    made = streaming.window_when(stream_of(spark, opened), stream_of(spark, rows), ["key"], "ts", "ts", "60 seconds", "100 seconds", stream_of(spark, closed), "ts")
    got = Counter((r.l_id, r.r_id) for r in streaming.run_stream(spark, made).collect() if r.r_id >= 0)
    right = Counter()
    for o, k, s in opened:
        end = min([s + 60, *[c for _, j, c in closed if j == k and c > s]])
        right.update((o, r) for r, j, at in rows if j == k and s <= at <= end)
    assert len(right) > 20 and got == right


def test_state_goes_with_the_watermark(spark, tmp_path):
    """Once a far row has moved the watermark, nothing of the other keys is left in the state."""
    made = streaming.window_when(stream_of(spark, rows_of(25, 1)), stream_of(spark, rows_of(60, 2, 1000)), ["key"], "ts", "ts", "17 seconds", "100 seconds")
    query = made.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 8 and held[-1] <= 6  # what waits of the key `far`, with its timer


@pytest.mark.parametrize("name", ["sample_first", "buffer_timeout", "scan_sum"])
def test_folds_over_overlapping_batches(spark, name):
    rows = [(i, k or "none", s) for i, k, s in rows_of(100, 7)]
    distinct = {(k, s): (i, k, s) for i, k, s in rows}  # one row a key and time, so the order is one
    rows = sorted(distinct.values())
    held = {"ts": "ts", "late": "100 seconds"}
    micros = F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)), F.col("ts"))
    build = {
        "sample_first": lambda s: streaming.sample_first(s, ["key"], "us", 9_000_000, **held),
        "buffer_timeout": lambda s: streaming.buffer_timeout(s, ["key"], "us", 4, 9_000_000, **held),
        "scan_sum": lambda s: streaming.scan_sum(s, ["key"], "id", "us", **held),
    }[name]
    got = streaming.run_stream(spark, build(stream_of(spark, rows).withColumn("us", micros))).where("key != 'far'")
    seq = Seq(table(spark, rows), ["ts"], "ts", ["key"])
    if name == "sample_first":
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in seq.sample_first(9).df.collect())
    elif name == "buffer_timeout":
        assert {r.id: r.window_id for r in got.collect()} == {r.id: r.window_id for r in seq.window_timeout(4, 9).df.collect()}
    else:
        assert {r.id: r.scan for r in got.collect()} == {r.id: r.scan for r in seq.scan(F.col("id")).df.collect()}


def test_keys_share_a_bucket(spark, tmp_path):
    """State is kept for buckets of keys, so calls don't grow with the keys; null, text and -0.0 are keys as in a grouping."""
    from braidwork.streaming import read_available, replayed, run_stream, scan_sum, window_when

    t0 = dt.datetime(2024, 1, 1)
    kinds = [None, "null", "-", "a", "1:a", ""]
    rows = [(i, kinds[i % 6], -0.0 if i % 12 < 6 else 0.0, t0 + dt.timedelta(minutes=i * 7 % 120), i * 7 % 120, i % 3) for i in range(120)]
    rows.append((-1, "last", 1.0, dt.datetime(2030, 1, 1), 0, 3))
    df = spark.createDataFrame(rows, "id long, k string, z double, ts timestamp_ntz, at long, batch long")
    path = replayed(df, F.col("batch"), 4)
    spark.conf.set("spark.braidwork.streamBuckets", "1")
    try:
        made = scan_sum(read_available(spark, path, 1), ["k", "z"], "at", "at", ts="ts", late="1 day")
        assert "_bucket" in made._jdf.queryExecution().analyzed().toString()
        found = {r.id: r.scan for r in run_stream(spark, made).where("id >= 0").collect()}
        pairs = window_when(read_available(spark, path, 1).where("id % 10 = 0 OR id < 0"), read_available(spark, path, 1), ["k", "z"], "ts", "ts", "30 minutes", "1 day")
        met = sorted((r.l_id, r.r_id) for r in run_stream(spark, pairs).where("l_id >= 0").collect())
    finally:
        spark.conf.unset("spark.braidwork.streamBuckets")
    real = rows[:-1]
    assert found == {r[0]: sum(x[4] for x in real if x[1] == r[1] and x[4] <= r[4]) for r in real}
    assert met == sorted((a[0], b[0]) for a in real if a[0] % 10 == 0 for b in real if a[1] == b[1] and a[4] <= b[4] <= a[4] + 30)
