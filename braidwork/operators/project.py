"""Projections: each row becomes one, several or no rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.plans.monoid import scan_chunks
from braidwork.plans.ordered import fits_one_task
from braidwork.plans.storage import store

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Sink:
    """What a handler of handle_with tells about a row."""

    def __init__(self):
        self.value, self.end = None, None

    def next(self, value: dict) -> None:
        if self.end is not None:  # dropped, as any signal after the end
            return
        if self.value is not None:
            raise ValueError("more than one call to next")
        self.value = value

    def complete(self) -> None:
        self.end = self.end or "complete"

    def error(self, message: str) -> None:
        self.end = self.end or f"error: {message}"


class Project:
    def map(self: Seq, strict: bool = False, **columns: Column) -> Seq:
        """Rows with only the order, time, keys and these columns. strict: a null result is an error."""
        made = {n: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"map gave null for {n}"))) if strict else c for n, c in columns.items()}
        return self.with_df(self.df.select(*self._kept(made), *[c.alias(n) for n, c in made.items()]))

    def _kept(self: Seq, made: dict) -> list[str]:
        own = [*self.order, *self.keys, *([self.ts] if self.ts else [])]
        return [c for c in dict.fromkeys(own) if c not in made]

    def map_not_null(self: Seq, **columns: Column) -> Seq:
        out = self.map(**columns)
        return out.with_df(out.df.dropna(subset=list(columns)))

    def map_pandas(self: Seq, function: Callable, schema: str) -> Seq:
        """Opaque code over Arrow batches: an iterator of pandas frames to another; it must keep the order columns."""
        return self.with_df(self.df.mapInPandas(function, schema))

    def cast(self: Seq, column: str, to: str) -> Seq:
        """Cast; a value that doesn't fit fails the action."""
        return self.with_df(self.df.withColumn(column, F.col(column).cast(to)))

    def of_type(self: Seq, column: str, to: str) -> Seq:
        """Keep the values that are of a type, as that type."""
        return self.with_df(self.df.withColumn(column, F.col(column).try_cast(to)).where(F.col(column).isNotNull()))

    def handle(self: Seq, value: Column, emit: Column | None = None, complete: Column | None = None, error: Column | None = None, name: str = "value") -> Seq:
        """One value or none for each row; the first row where `complete` holds ends the sequence (its value stays), `error` fails it."""
        out = self.take_until(complete) if complete is not None else self
        made = value if error is None else F.when(error, F.raise_error(F.lit("handler error"))).otherwise(value)
        df = out.df.where(emit) if emit is not None else out.df
        return out.with_df(df.withColumn(name, made))

    def index(self: Seq, name: str = "index", mapper: Callable[[Column], Column] | None = None) -> Seq:
        """The position, from 0 (within each key)."""
        df = self.ordered().position(name).frame().withColumn(name, F.col(name).cast("long"))
        return self.with_df(df if mapper is None else df.withColumn(name, mapper(F.col(name))))

    def timestamp(self: Seq, name: str = "millis") -> Seq:
        return self.with_df(self.df.withColumn(name, F.floor(self.micros() / 1000).cast("long")))

    def elapsed(self: Seq, name: str = "elapsed_us", origin: Column | None = None) -> Seq:
        """Microseconds since the row before; for the first row since `origin` (by default itself: 0)."""
        frame = self.ordered().neighbour("_before", self.micros(), -1)
        first = self.micros() if origin is None else origin
        return self.with_df(frame.frame().withColumn(name, self.micros() - F.coalesce("_before", first)).drop("_before"))

    def timed(self: Seq) -> Seq:
        """elapsed_us, since_start_us and at_us of each row."""
        frame = self.ordered().neighbour("_before", self.micros(), -1).running("_start", self.micros(), "min")
        at = self.micros()
        df = frame.frame().withColumns({"elapsed_us": at - F.coalesce("_before", at), "since_start_us": at - F.col("_start"), "at_us": at})
        return self.with_df(df.drop("_before", "_start"))

    def materialize(self: Seq, value: str) -> Seq:
        """Rows (signal_pos, type, value, error): every value as a signal, then the completion; for keyed sequences of each key."""
        none, keys = F.lit(None).cast("string").alias("error"), self.keys
        rows = self.with_df(self.df.select(*dict.fromkeys([*self.order, *keys, value]))).index("signal_pos").df
        nexts = rows.select(*keys, "signal_pos", F.lit("NEXT").alias("type"), F.col(value).alias("value"), none)
        counted = self.df.groupBy(*keys).agg(F.count("*").alias("signal_pos"))
        ends = counted.select(*keys, "signal_pos", F.lit("COMPLETE").alias("type"), F.lit(None).cast(self.df.schema[value].dataType).alias("value"), none)
        return self.with_df(nexts.unionByName(ends), ["signal_pos"])

    def dematerialize(self: Seq) -> Seq:
        """The values of signals up to the first terminal one; if that is an error, the action fails with it."""
        ended = self.take_until(F.col("type") != "NEXT").df
        failed = F.when(F.col("type") == "ERROR", F.raise_error(F.coalesce("error", F.lit("error signal"))).cast("boolean")).otherwise(F.col("type") == "NEXT")
        return self.with_df(ended.where(failed).drop("type", "error"))

    def scan(self: Seq, column: Column, how: str = "sum", name: str = "scan", seed: Column | None = None) -> Seq:
        """The running fold; with a seed also a first row that holds the seed alone (its order columns are null)."""
        folded = self.ordered().running(name, column, how).frame()
        if seed is None:
            return self.with_df(folded)
        combine = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}[how]
        folded = folded.withColumn(name, combine(seed, F.col(name))).withColumn("_seeded", F.lit(1))
        kind = dict(folded.dtypes)[name]
        spark = self.spark
        start = spark.range(1).select(seed.cast(kind).alias(name), F.lit(0).alias("_seeded"))
        return self.with_df(folded.unionByName(start, allowMissingColumns=True), ["_seeded", *self.order])

    scan_with = scan

    def scan_chunks(self: Seq, inputs: list[Column], lift: Callable, combine: Callable, emit: Callable, schema: str) -> Seq:
        """A running fold in opaque code, of a sequence or key of any size: emit(before, frame) gives a run's rows their values from
        the state of all rows ahead (None for none); lift and combine as in fold_chunks."""
        return self.with_df(scan_chunks(self, inputs, lift, combine, emit, schema))

    def handle_with(self: Seq, function: Callable, schema: str) -> Seq:
        """Opaque code for each row: function(row, sink) calls sink.next(value) once or not at all, and may end the sequence (of
        its key) by sink.complete() or sink.error(message); an exception of its own is an error too.

        Nothing is ordered: a first pass over batches stores values and signals, the first signal's place is a minimum,
        and rows behind it go. What the ending row emitted stays. An error fails the action that reads the result,
        after a completion ahead of it nothing does. The columns of schema come to the row's own; value is a dictionary of them.
        """
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        added = _parse_datatype_string(schema).names
        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema if f.name not in added]
        full = ", ".join([*own, schema, "_emitted boolean, _end string"])
        target = to_arrow_schema(_parse_datatype_string(full))
        kept = [c for c in self.df.columns if c not in added]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                sinks = []
                for row in batch.to_pylist():
                    sinks.append(Sink())
                    try:
                        function(row, sinks[-1])
                    except Exception as e:
                        sinks[-1].error(str(e))
                made = [pa.array([(s.value or {}).get(n) for s in sinks], type=target.field(n).type) for n in added]
                ends = [pa.array([s.value is not None for s in sinks]), pa.array([s.end for s in sinks], type=pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made, *ends], schema=target)

        stored = self.with_df(store(self.df.mapInArrow(run, full), "handled"))
        place = stored.place()
        first = stored.df.where("_end IS NOT NULL").groupBy(*self.keys).agg(F.min(F.struct(place.alias("at"), "_end")).alias("_first"))
        joined = self.joined_by_key(stored.df, first, "left") if self.keys else stored.df.crossJoin(F.broadcast(first))  # one row
        at, end = F.col("_first.at"), F.col("_first._end")
        failed = F.when(end.startswith("error") & (place == at), F.raise_error(F.coalesce(end, F.lit(""))).cast("boolean")).otherwise(F.col("_emitted"))
        return self.with_df(joined.where(at.isNull() | (place <= at)).where(failed).drop("_first", "_emitted", "_end"))

    def flat_map_table(self: Seq, handler: type, schema: str | None = None, batches: bool = False, **options) -> Seq:
        """Rows from a table function with state: a class whose eval(row) (or, with `batches`, eval(record batch)) and terminate() yield rows.

        An object of it sees one key's rows, in order, as they stream by; what it holds is its own state. The schema may
        come from the class's static `analyze(table)`. The result's order are its columns, unless `order` says so.
        """
        order = options.pop("order", None)
        if options:
            raise TypeError(f"unknown options {sorted(options)}")
        if batches:
            made = F.arrow_udtf(handler, returnType=schema)
        else:
            made = F.udtf(handler, returnType=schema, useArrow=False)  # Arrow makes a batch of what each row gives
        if not self.keys and not fits_one_task(self.df):
            raise ValueError("a table function over so large a sequence needs keys")
        table = self.df.asTable()
        table = table.partitionBy(*self.keys) if self.keys else table.withSinglePartition()
        out = made(table.orderBy(*self.order))
        return self.with_df(out, order or out.columns, ts=None)

    def fold(self: Seq, function: Callable, schema: str) -> Seq:
        """A running fold in opaque code: for each key (or the whole sequence), rows in order go through `function(rows) -> rows`.

        `function` gets an iterator of dictionaries and yields dictionaries; rows stream by, so only its own state is held.
        """
        keys = self.keys

        def run(batches):
            import pyarrow as pa

            def rows():
                for batch in batches:
                    yield from batch.to_pylist()  # nulls stay nulls and integers exact

            if keys:
                from itertools import groupby

                made = (r for _, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)) for r in function(group))
            else:
                made = function(rows())
            out = []
            for r in made:
                out.append(r)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        target = to_arrow_schema(_parse_datatype_string(schema))
        return self.with_df(self.sorted_parts().mapInArrow(run, schema))

    def sorted_parts(self: Seq) -> DataFrame:
        """Rows in order, all of a key in one task one after the other. Opaque code can't be cut into chunks: a sequence
        without keys must be small enough for one task. `fold_chunks` folds any size, with a function that combines."""
        if not self.keys and not fits_one_task(self.df):
            raise ValueError("a fold in opaque code over so large a sequence needs keys; see fold_chunks and scan_chunks")
        parted = self.df.repartition(*self.keys) if self.keys else self.df.repartition(1)
        return parted.sortWithinPartitions(*self.keys, *self.order)

    def flat_map(self: Seq, array: Column, name: str = "value", outer: bool = False) -> Seq:
        """Each row's array as rows; `pos` extends the order, so a source's values stay together and in order."""
        explode = F.posexplode_outer if outer else F.posexplode
        return self.with_df(self.df.select("*", explode(array).alias("pos", name)), [*self.order, "pos"])

    flat_map_iterable = concat_map = concat_map_iterable = flat_map_sequential = flat_map_many = flat_map

    def flat_map_delay_error(self: Seq, array: Column, error: Column, name: str = "value") -> Seq:
        """flat_map that goes on after failing rows: rows where `error` is not null give one row with the error and no value."""
        safe = F.when(error.isNull(), array)
        return self.with_df(self.df.select("*", error.alias("error"), F.posexplode_outer(safe).alias("pos", name)), [*self.order, "pos"])

    concat_map_delay_error = flat_map_sequential_delay_error = flat_map_delay_error

    def flat_map_join(self: Seq, inner: DataFrame, on: Column | str | list[str], order: list[str]) -> Seq:
        """Each row's inner sequence is a set of rows of another table."""
        return self.with_df(self.df.join(inner, on), [*self.order, *order])

    def switch_map(self: Seq, inner: Seq, outer_ts: str | None = None, on: str | None = None) -> Seq:
        """The inner rows that come while a row is the latest one: from its time until the next row's; with `on` for each key.

        Outer and inner rows are one sequence in time order, in which each inner row carries the last outer row.
        """
        own = outer_ts or self.ts
        keys = [] if on is None else [on]
        outer = self.df.select(*keys, F.col(own).alias("_at"), F.lit(0).alias("_side"), F.struct(*self.order).alias("_mine"), F.struct(*self.df.columns).alias("_outer"))
        rows = inner.df.select(*keys, F.col(inner.ts).alias("_at"), F.lit(1).alias("_side"), F.struct(*inner.order).alias("_theirs"), F.struct(*[c for c in inner.df.columns if c != on]).alias("_inner"))
        both = self.with_df(outer.unionByName(rows, allowMissingColumns=True), ["_at", "_side", "_mine", "_theirs"], ts=None, keys=keys)
        frame = both.ordered().running("_latest", F.col("_outer"), "last").frame()
        found = frame.where(F.col("_inner").isNotNull() & F.col("_latest").isNotNull()).select("_latest.*", "_inner.*")
        return self.with_df(found, inner.order, ts=inner.ts)

    def switch_on_first(self: Seq, choose: Callable[[dict | None, Seq], Seq]) -> Seq:
        """The plan is chosen by the first row."""
        first = self.df.orderBy(*self.order).limit(1).collect()
        return choose(first[0].asDict() if first else None, self)

    def expand(self: Seq, children: DataFrame, node: str, parent: str, depth_first: bool = False, most: int = 100) -> Seq:
        """Rows, their children, the children's children and so on: breadth first, or depth first.

        children: a table whose column `parent` names the `node` of another row. Rounds are joins; a round
        without new rows ends the expansion, and more than `most` rounds fail (a cycle).
        """
        from braidwork.plans.storage import store

        def path(value):
            return F.array(F.struct(F.lit(0).alias("d"), F.col(value).cast("string").alias("n")))

        level = self.df.select(node).withColumn("depth", F.lit(0)).withColumn("path", F.array(F.col(node).cast("string")))
        found = level
        for depth in range(1, most + 2):
            step = children.select(F.col(node).alias("_child"), F.col(parent).alias("_parent"))
            level = level.join(step, level[node] == F.col("_parent")).select(F.col("_child").alias(node), F.lit(depth).alias("depth"), F.concat("path", F.array(F.col("_child").cast("string"))).alias("path"))
            level = store(level, "expand")
            if level.isEmpty():
                break
            if depth > most:
                raise RuntimeError(f"expansion deeper than {most}")
            found = found.unionByName(level)
        return self.with_df(found, ["path"] if depth_first else ["depth", "path"])

    def expand_deep(self: Seq, children: DataFrame, node: str, parent: str, most: int = 100) -> Seq:
        return self.expand(children, node, parent, depth_first=True, most=most)

    def transform(self: Seq, function: Callable[[Seq], Seq]) -> Seq:
        return function(self)

    def transform_deferred(self: Seq, function: Callable[[Seq], Seq]) -> Callable[[], Seq]:
        return lambda: function(self)

    def transform_deferred_contextual(self: Seq, function: Callable) -> Callable[[], Seq]:
        return lambda: function(self, self.context)

    def hide(self: Seq) -> Seq:
        return self
