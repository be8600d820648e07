"""Sources of sequences: literals, ranges, tables and files, generators, callables, pushed rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from braidwork.functions.context import Context
from braidwork.plans.seq import Seq


def just(spark: SparkSession, *values: Any, schema: str | None = None) -> Seq:
    """Literal rows, in this order (`seq`)."""
    if not values:
        return empty(spark, schema or "value string")
    if isinstance(values[0], dict):
        rows = [{**v, "seq": i} for i, v in enumerate(values)]
        names = [n for n in rows[0]]
        return Seq(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], f"{schema}, seq long" if schema else names), "seq")
    return Seq(spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"seq long, {schema}" if schema else ["seq", "value"]), "seq")


def from_iterable(spark: SparkSession, values: Iterable[Any], schema: str | None = None) -> Seq:
    return just(spark, *values, schema=schema)


from_array = from_stream = from_iterable


def from_(source: DataFrame | str | Seq, order: Sequence[str] | str = "seq", ts: str | None = None, spark: SparkSession | None = None, format: str = "parquet", **options: Any) -> Seq:
    """A DataFrame, a table's name, or a path (with a slash) of any format that Spark reads."""
    if isinstance(source, Seq):
        return source
    if isinstance(source, str):
        source = spark.read.format(format).options(**options).load(source) if "/" in source else spark.table(source)
    return Seq(source, order, ts)


def range_(spark: SparkSession, start: int, count: int) -> Seq:
    return Seq(spark.range(start, start + count).withColumnRenamed("id", "value"), "value")


def empty(spark: SparkSession, schema: str) -> Seq:
    df = spark.createDataFrame([], schema)
    return Seq(df, df.columns[0])


def error(spark: SparkSession, message: str, schema: str = "value string") -> Seq:
    """Fails when it is read, not when it is planned."""
    df = spark.range(1).select(F.raise_error(F.lit(message)).cast("string").alias("_e"))
    columns = spark.createDataFrame([], schema)
    made = [F.when(F.col("_e").isNull(), F.lit(None)).cast(f.dataType).alias(f.name) for f in columns.schema]
    return Seq(df.where(F.col("_e").isNotNull()).select(*made), columns.columns[0])


def never(spark: SparkSession) -> Seq:
    raise ValueError("a batch plan can't wait for ever; use a stream without data")


def defer(build: Callable[[], Seq]) -> Callable[[], Seq]:
    """The plan is built at each use."""
    return build


def defer_contextual(build: Callable[[Context], Seq], context: Context) -> Callable[[], Seq]:
    return lambda: build(context)


def interval(spark: SparkSession, start: str, end: str, period: str, delay: str = "0 seconds") -> Seq:
    """0, 1, 2, ... with event times `period` apart, from start plus delay up to end. Ticks of a fixed length are made where they are
    needed, any number of them; those of months and years, which differ in length, come from one array."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{}', {})"
    first = f"TIMESTAMP_NTZ'{start}' + INTERVAL {delay}"
    zero, span = micros.format("1970-01-01", first), f"timestampdiff(MICROSECOND, {first}, TIMESTAMP_NTZ'{end}')"
    steps = [micros.format(day, f"TIMESTAMP_NTZ'{day}' + INTERVAL {period}") for day in ("2023-01-31", "2024-02-01", "2025-04-30")]
    at, length, *step = spark.range(1).select(*[F.expr(x) for x in (zero, span, *steps)]).first()
    if len(set(step)) == 1 and step[0] > 0:
        ticks = spark.range(max(0, length // step[0] + 1) if length >= 0 else 0)
        us = F.lit(at) + F.col("id") * step[0]
        ts = F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))
        return Seq(ticks.select(ts.alias("ts"), F.col("id").alias("value")), "ts", "ts")
    times = spark.range(1).select(F.explode(F.expr(f"sequence(TIMESTAMP_NTZ'{start}' + INTERVAL {delay}, TIMESTAMP_NTZ'{end}', INTERVAL {period})")).alias("ts"))
    return Seq(times, "ts", "ts").index("value")


#: Steps after which a generator without a limit of its own fails.
GENERATED = 10_000


def generate(spark: SparkSession, state: str, step: str, emit: str = "state", until: str = "false", most: int | None = None) -> Seq:
    """A pull generator in SQL: from `state`, emit an expression of n and state, go on with `step` until a test holds.

    With `most` it ends after so many steps at the latest. Without, it ends by its test alone; GENERATED steps
    without that are an error when read. The recursion is one query, a job of Spark for each few steps: for
    very long sequences `create` with a Python generator is cheaper.
    """
    steps = GENERATED if most is None else most
    value = emit if most is not None else f"CASE WHEN n < {steps} THEN {emit} ELSE raise_error('the generator has not ended after {steps} steps') END"
    sql = f"""
    WITH RECURSIVE g(n, state) MAX RECURSION LEVEL {steps + 1} AS (
      SELECT CAST(0 AS BIGINT), {state} UNION ALL SELECT n + 1, {step} FROM g WHERE NOT ({until}) AND n < {steps})
    SELECT n AS seq, {value} AS value FROM g WHERE NOT ({until})
    """
    return Seq(spark.sql(sql), "seq")


class CallbackSource(DataSource):
    """Rows pushed by a function: `emitter` yields tuples on an executor, in one partition each."""

    emitters: dict[str, tuple[Callable, str, int]] = {}

    @classmethod
    def name(cls) -> str:
        return "braidwork_callback"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema):  # noqa: ANN001
        import base64

        from pyspark import cloudpickle

        return CallbackReader(cloudpickle.loads(base64.b64decode(self.options["emitter"])), int(self.options.get("partitions", "1")))


class CallbackReader(DataSourceReader):
    def __init__(self, emitter: Callable, partitions: int):
        self.emitter, self.n = emitter, partitions

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(i) for i in range(self.n)]

    def read(self, partition):  # noqa: ANN001
        yield from self.emitter(partition.value)


def create(spark: SparkSession, emitter: Callable[[int], Iterable[tuple]], schema: str, order: Sequence[str] | str, partitions: int = 1) -> Seq:
    """Rows from opaque code on the executors: emitter(partition) yields tuples."""
    import base64

    from pyspark import cloudpickle

    spark.dataSource.register(CallbackSource)
    code = base64.b64encode(cloudpickle.dumps(emitter)).decode()
    df = spark.read.format("braidwork_callback").option("schema", schema).option("emitter", code).option("partitions", str(partitions)).load()
    return Seq(df, order)


push = create


def from_callable(spark: SparkSession, make: Callable[[], Any], schema: str | None = None) -> Seq:
    """One row with the result, none for None."""
    value = make()
    return empty(spark, schema or "value string") if value is None else just(spark, value, schema=schema)


from_supplier = just_or_empty = from_callable


def from_direct(seq: Seq) -> Seq:
    """Trusted to have one row at most."""
    return seq


def from_runnable(spark: SparkSession, run: Callable[[], None]) -> Seq:
    """Do something on the driver, then nothing follows."""
    run()
    return empty(spark, "value string")


def delay(spark: SparkSession, seconds: float) -> Seq:
    """The number 0, after a pause of the driver."""
    import time

    time.sleep(seconds)
    return just(spark, 0, schema="value long")


def from_future(spark: SparkSession, future: Any, schema: str | None = None, timeout: float | None = None) -> Seq:
    return from_callable(spark, lambda: future.result(timeout), schema)


from_completion_stage = from_future


@contextmanager
def using(acquire: Callable[[], Any], build: Callable[[Any], Seq], release: Callable[[Any], None], on_error: Callable[[Any, BaseException], None] | None = None):
    """A sequence over a resource that is given back after the block, however it ends."""
    resource = acquire()
    try:
        yield build(resource)
    except Exception as failed:
        if on_error:
            on_error(resource, failed)
        raise
    finally:
        release(resource)


using_when = using


def zip_values(*seqs: Seq) -> Seq:
    """Sequences of one row at most as one row of structs z0, z1, ...; none if any is empty."""
    out = None
    for i, s in enumerate(seqs):
        side = s.df.limit(1).select(F.struct(*s.df.columns).alias(f"z{i}"))
        out = side if out is None else out.crossJoin(side)  # one row each
    return seqs[0].with_df(out, ["z0"])


def zip_delay_error(*seqs: Seq) -> Seq:
    """zip_values of sources with ends: what fails (see Seq.ending) is awaited, all errors are gathered in the result's end, and a source
    with an error gives no row."""
    zipped, end = zip_values(*seqs), seqs[0].gathered_end(*seqs[1:])
    failed = end.where("error IS NOT NULL").select(F.lit(True).alias("_failed"))
    return zipped.with_df(zipped.df.join(F.broadcast(failed), F.lit(True), "left_anti"), end=end)


class Sink:
    """Rows pushed by the driver, kept until read: many (all, or the last n), one, or empty."""

    def __init__(self, spark: SparkSession, schema: str, limit: int | None = None, single: bool = False, unicast: bool = False, max_age: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.schema, self.limit, self.single = spark, schema, limit, single
        self.unicast, self.read, self.max_age, self.clock, self.times = unicast, False, max_age, clock, {}
        self.rows: list[tuple] = []
        self.count, self.done, self.failure = 0, False, None

    def try_emit_next(self, *row: Any) -> str:
        if self.done:
            return "FAIL_TERMINATED"
        if self.single and self.count:
            return "FAIL_OVERFLOW"
        self.rows.append((self.count, *row))
        self.times[self.count] = self.clock()
        self.count += 1
        if self.limit is not None:
            del self.rows[: -self.limit or len(self.rows)]
        if self.single:
            self.done = True
        return "OK"

    try_emit_value = try_emit_next

    def emit_next(self, *row: Any) -> None:
        if (said := self.try_emit_next(*row)) != "OK":
            raise RuntimeError(said)

    emit_value = emit_next

    def try_emit_complete(self) -> str:
        if self.done:
            return "FAIL_TERMINATED"
        self.done = True
        return "OK"

    try_emit_empty = emit_complete = try_emit_complete

    def try_emit_error(self, message: str) -> str:
        if self.done:
            return "FAIL_TERMINATED"
        self.done, self.failure = True, message
        return "OK"

    def reader(self) -> Reader:
        """A subscription of a multicast sink: it sees what is emitted from now on."""
        return Reader(self, self.count)

    def as_seq(self, since: int = 0) -> Seq:
        if self.unicast and self.read:
            raise RuntimeError("a unicast sink has one consumer")
        self.read = True
        kept = [r for r in self.rows if r[0] >= since and (self.max_age is None or self.clock() - self.times[r[0]] <= self.max_age)]
        df = self.spark.createDataFrame(kept, f"seq long, {self.schema}")
        if self.failure is not None:
            failed = error(self.spark, self.failure, f"seq long, {self.schema}")
            df = df.unionByName(failed.df)
        return Seq(df, "seq")


class Reader:
    """A subscription of a sink."""

    def __init__(self, sink: Sink, since: int):
        self.sink, self.since = sink, since

    def as_seq(self) -> Seq:
        return self.sink.as_seq(self.since)


def sink_empty(spark: SparkSession, schema: str) -> Sink:
    """A sink that only ends: no row can be emitted."""
    sink = Sink(spark, schema, single=True)
    sink.count = 1
    return sink


def sink_unicast(spark: SparkSession, schema: str) -> Sink:
    """Rows are kept for one consumer; a second one is an error."""
    return Sink(spark, schema, unicast=True)


def sink_multicast(spark: SparkSession, schema: str) -> Sink:
    """Each reader() sees the rows emitted after it came."""
    return Sink(spark, schema)


def sink_replay(spark: SparkSession, schema: str, limit: int | None = None, max_age: float | None = None, clock: Callable[[], float] = time.monotonic) -> Sink:
    """Consumers see all rows, the last `limit`, or those no older than so many seconds."""
    return Sink(spark, schema, limit, max_age=max_age, clock=clock)


def sink_one(spark: SparkSession, schema: str) -> Sink:
    return Sink(spark, schema, single=True)


def sink_many(spark: SparkSession, schema: str, limit: int | None = None) -> Sink:
    return Sink(spark, schema, limit)

