"""Structured Streaming counterparts of the timed operators: event time, watermarks, state in the engine's stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from braidwork.plans.storage import shared_root
from braidwork.streaming.processors import WaitingFold, Windows, stateful


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark. Times without zone are read as UTC, which watermarks need."""
    if dict(stream.dtypes)[ts] == "timestamp_ntz":
        stream = stream.withColumn(ts, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`))"))
    return stream.withWatermark(ts, late)


def tumbling_counts(stream: DataFrame, ts: str, length: str, late: str, slide: str | None = None, keys: list[str] = (), columns: list[Column] = ()) -> DataFrame:
    """Windows by time, tumbling or sliding: the streaming buffer and window."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    grouped = timed(stream, ts, late).groupBy(window.alias("w"), *keys).agg(*(columns or [F.count("*").alias("n")]))
    return grouped.withColumn("window_us", F.unix_micros("w.start")).drop("w")


def sample(stream: DataFrame, ts: str, period: str, late: str, keys: list[str] = ()) -> DataFrame:
    """The last row of each period."""
    row = F.struct(*[c for c in stream.columns])
    return tumbling_counts(stream, ts, period, late, keys=keys, columns=[F.max_by(row, F.col(ts)).alias("row")])


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of rows with gaps shorter than this: where a quiet period ends (the streaming sample_timeout)."""
    grouped = timed(stream, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return grouped.drop("w")


def distinct(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(keys)


def join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, alive: str, late: str, on: Column) -> DataFrame:
    """Pairs where the right row comes within a left row's life; old state is dropped by the watermarks."""
    a, b = timed(left, left_ts, late), timed(right, right_ts, late)
    return a.join(b, on & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {alive}")))


def window_when(openings: DataFrame, rows: DataFrame, keys: list[str], opening_ts: str, ts: str, length: str, late: str = "0 seconds", closings: DataFrame | None = None, closing_ts: str | None = None) -> DataFrame:
    """Pairs of openings (columns l_*) and rows (r_*) of their key while they are open: both ends included, so the streaming window_when.

    A window is open from its opening's time for `length`, or up to the first row of `closings` after it, whichever
    is first. Windows may overlap. A row's pairs are given once the watermark (of the slowest stream) has passed it, so
    it doesn't matter in which order or batch rows, openings and closings come; rows wait in list state, and a window
    leaves the state with the watermark. Null keys are a key; rows without a time are dropped.
    """

    def side(df: DataFrame, at: str, number: int, prefix: str | None) -> DataFrame:
        df = timed(df.withColumn("_ts", F.col(at)), "_ts", late)
        own = [F.struct(*[c for c in df.columns if c != "_ts"]).alias(prefix)] if prefix else []
        return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_ts", F.lit(number).alias("_side"), *own)

    both = side(openings, opening_ts, 0, "l").unionByName(side(rows, ts, 1, "r"), allowMissingColumns=True)
    if closings is not None:
        both = both.unionByName(side(closings, closing_ts, 2, None), allowMissingColumns=True)
    both = both.withColumns({"_ms": F.unix_millis("_ts"), "_us": F.unix_micros("_ts")})
    schema = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in ("l", "r"))
    spark = openings.sparkSession
    length_us = spark.range(1).select(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01', TIMESTAMP_NTZ'2000-01-01' + INTERVAL {length})")).first()[0]
    made = stateful(both, [f"_k{i}" for i in range(len(keys))], Windows(length_us), schema)
    return made.select(*[F.col(f"{n}.`{c}`").alias(f"{n}_{c}") for n, side_ in (("l", openings), ("r", rows)) for c in side_.columns])


def fold(stream: DataFrame, keys: list[str], schema: str, state: str, initial: tuple, step: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]], order: str, ts: str | None = None, late: str = "0 seconds", expire_ms: int | None = None) -> DataFrame:
    """A stateful fold for each key: step(state, rows in order) -> (state, rows out).

    Without `ts` rows are sorted within a micro-batch: enough where batches don't overlap in time. With it rows
    wait in list state until the watermark (`late` behind the newest row) has passed them, so rows that come in a
    later batch are folded in their place; the newest rows of a stream wait for later ones, and rows behind the
    watermark are dropped. A key without rows for `expire_ms` of event time is forgotten.
    """
    if ts is None:

        def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(frames)).sort_values(order)
            before = held.get if held.exists else initial
            after, out = step(tuple(before), rows)
            held.update(after)
            yield out

        return stream.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)

    rows = timed(stream, ts, late).withColumn("_ms", F.unix_millis(ts))
    return stateful(rows, keys, WaitingFold(step, initial, order, expire_ms), schema)


def columns_of(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)


def scan_sum(stream: DataFrame, keys: list[str], value: str, order: str, name: str = "scan", **held) -> DataFrame:
    """The running sum of each key. held: ts, late and expire_ms of `fold`."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        sums = rows[value].cumsum() + state[0]
        return (float(sums.iloc[-1]),), rows.assign(**{name: sums})

    return fold(stream, keys, f"{columns_of(stream)}, {name} double", "total double", (0.0,), step, order, **held)


def sample_first(stream: DataFrame, keys: list[str], micros: str, period_us: int, **held) -> DataFrame:
    """A row, then none for so long, and so on; `micros` is a column of microseconds that also orders the rows. held: ts, late and expire_ms of `fold`."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        gate, kept = state[0], []
        for at in rows[micros]:
            kept.append(at >= gate)
            if kept[-1]:
                gate = int(at) + period_us
        return (gate,), rows[kept]

    return fold(stream, keys, columns_of(stream), "gate long", (-(2**62),), step, micros, **held)


def buffer_timeout(stream: DataFrame, keys: list[str], micros: str, size: int, length_us: int, **held) -> DataFrame:
    """Each row with its window_id: windows of up to `size` rows and so long from their first row on. held: ts, late and expire_ms of `fold`."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        window, start, n = state
        ids = []
        for at in rows[micros]:
            if n == 0 or n >= size or at >= start + length_us:
                window, start, n = window + 1, int(at), 0
            n += 1
            ids.append(window)
        return (window, start, n), rows.assign(window_id=ids)

    return fold(stream, keys, f"{columns_of(stream)}, window_id long", "window long, start long, n long", (-1, 0, 0), step, micros, **held)


def inactivity(stream: DataFrame, keys: list[str], ts: str, late: str, quiet: str) -> DataFrame:
    """(keys, last_ts): keys that had no row for so long after last_ts, once the watermark shows it: the streaming timeout. A key that comes back starts anew."""
    return sessions(stream, ts, quiet, late, keys).select(*keys, "last_ts")


def count_windows(stream: DataFrame, keys: list[str], order: str, size: int, **held) -> DataFrame:
    """Each row with its window_id: windows of `size` rows of a key. held: ts, late and expire_ms of `fold`."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        return (state[0] + len(rows),), rows.assign(window_id=[(state[0] + i) // size for i in range(len(rows))])

    return fold(stream, keys, f"{columns_of(stream)}, window_id long", "seen long", (0,), step, order, **held)


def latest_per_batch(stream: DataFrame, keys: list[str], ts: str, sink: Callable[[DataFrame], None]):
    """Only the newest row of each key in a micro-batch goes on to the sink: what a slow consumer sees of a fast source."""

    def batch(df: DataFrame, _: int) -> None:
        row = F.max_by(F.struct(*df.columns), F.col(ts)).alias("row")
        sink(df.groupBy(*keys).agg(row).select("row.*"))

    return stream.writeStream.foreachBatch(batch)


def replayed(df: DataFrame, batch: Column, batches: int) -> str:
    """A folder that a stream can read with the rows of df, those with batch = 0 as the oldest files, and so on: for replays and tests."""
    path = f"{shared_root(df.sparkSession)}/braidwork/replay-{uuid.uuid4().hex}"
    for i in range(batches):
        df.where(batch == i).coalesce(1).write.mode("append").parquet(path)
    return path


def run_available(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 8) -> DataFrame:
    """What a stream over all Parquet files of a path gives once it has read them: for replays and tests."""
    stream = read_available(spark, path, files)
    return run_stream(spark, build(stream), mode)


def read_available(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads no single file, but a pattern that matches one
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(pattern)


def run_stream(spark: SparkSession, made: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once it has read all there is, as a stored table; in mode complete the table after the last batch."""
    base = f"{shared_root(spark)}/braidwork/stream-{uuid.uuid4().hex}"
    if mode == "complete":

        def replace(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out")

        spark.createDataFrame([], made.schema).write.parquet(f"{base}/out")
        made.writeStream.foreachBatch(replace).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{base}/out")
    made.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")
