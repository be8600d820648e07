"""Listeners of batches and streams; shared rows that free themselves."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from braidwork import streaming
from braidwork.functions.listeners import StreamListener
from braidwork.plans.seq import Seq

T0 = dt.datetime(2024, 1, 1)


class Listener:
    def __init__(self):
        self.said, self.runs = [], []

    def do_first(self):
        self.said.append("first")

    def do_on_subscribe(self, *name):
        self.said.append("subscribe")

    def do_on_complete(self):
        self.said.append("complete")

    def do_on_error(self, error):
        self.said.append("error")

    def do_on_cancel(self):
        self.said.append("cancel")

    def do_finally(self):
        self.said.append("finally")

    def do_on_run(self, run):
        self.runs.append(run)


def seconds(spark, n):
    return Seq(spark.range(n).select("id", F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01')").alias("ts")), "id", "ts")


def test_batches(spark, tmp_path):
    heard = Listener()
    seq = seconds(spark, 100).filter(F.col("id") >= 10).name("kept").tap(heard)
    assert len(seq.collect_rows()) == 90 and seq.then() is None
    seq.write(str(tmp_path / "out"))
    assert heard.said == ["first", "subscribe", "complete", "finally"] * 3
    for run in heard.runs:
        assert (run.rows, run.name, run.error, run.last_us - run.first_us) == (90, "kept", None, 89_000_000) and 0 < run.seconds < 60
    assert len(heard.runs) == 3


def test_failures_and_cancels(spark):
    heard = Listener()
    failing = seconds(spark, 5).map(x=F.raise_error(F.lit("broken"))).tap(heard)
    with pytest.raises(Exception, match="broken"):
        failing.then()
    assert heard.said == ["first", "subscribe", "error", "finally"]
    assert heard.runs[0].rows is None and "broken" in str(heard.runs[0].error) and not heard.runs[0].cancelled
    slow, heard = Listener(), Listener()
    waiting = Seq(spark.range(4).select("id", F.expr("reflect('java.lang.Thread', 'sleep', 20000L)").alias("x")), "id").cancel_on("stopped").tap(slow)
    import threading

    threading.Timer(4, lambda: spark.sparkContext.cancelJobsWithTag("stopped")).start()
    with pytest.raises(Exception):  # noqa: B017
        waiting.then()
    assert slow.said[-2:] == ["cancel", "finally"] and slow.runs[0].cancelled


def test_streams(spark):
    df = seconds(spark, 50).df
    stream = streaming.read_available(spark, streaming.replayed(df, F.floor(F.col("id") / 20), 3), 1)
    heard = Listener()
    listening = StreamListener(spark, heard)
    observed = stream.observe("seen", F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    assert streaming.run_stream(spark, observed).count() == 50
    until = time.monotonic() + 20
    while "finally" not in heard.said and time.monotonic() < until:
        time.sleep(0.2)
    listening.stop()
    assert heard.said == ["subscribe", "complete", "finally"]
    runs = [r for r in heard.runs if r.rows]
    assert [r.rows for r in runs] == [20, 20, 10] and [r.metrics["seen"]["most"] for r in runs] == [19, 39, 49] and all(r.seconds > 0 for r in runs)


def test_shared_rows_free_themselves(spark):
    import gc

    shared = seconds(spark, 30).publish().ref_count(2, grace=1.0)
    one = shared.reader()
    assert not shared.connected
    two = shared.reader().filter(F.col("id") > 9)
    assert shared.connected and len(two.collect_rows()) == 20
    del one
    gc.collect()
    time.sleep(1.5)
    assert shared.connected and shared.seq.df.storageLevel.useMemory  # what was made from the second reader still reads
    del two
    gc.collect()
    again = shared.reader()  # within the grace time
    time.sleep(1.5)
    assert shared.connected and len(again.collect_rows()) == 30
    del again
    gc.collect()
    until = time.monotonic() + 10
    while shared.connected and time.monotonic() < until:
        time.sleep(0.1)
    assert not shared.connected and not shared.seq.df.storageLevel.useMemory
