"""Folds in opaque code that depend on the order, without a list of a sequence's values anywhere.

What makes them distributed is that partial results combine: any associative `combine` will do, it need not commute.
Runs of rows are folded where they are; of a key that goes on over several chunks the chunks' results are combined in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from braidwork.plans.gates import placed, segments
from braidwork.plans.ordered import CHUNK, Ordered
from braidwork.plans.storage import discard, store

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq

#: Partial results that one task combines at a time.
FAN_IN = 64


def runs(batches, fed: list[str], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, int, int, pd.DataFrame]]:
    """Runs of rows of one key (or chunk and key): where they are in their batch, and their inputs."""
    for key, _, batch, low, high in segments(batches, [], by):
        yield key, batch, low, high, batch.select(fed).slice(low, high - low).to_pandas()


def partials(ordered: Ordered, df: DataFrame, fed: list[str], lift: Callable, combine: Callable) -> DataFrame:
    """(chunk, keys, _state): one partial result for each key in each chunk (chunk 0 if there is one)."""
    by = [*([CHUNK] if ordered.chunked else []), *ordered.keys]
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in ordered.keys)
    schema = f"`{CHUNK}` long, {keys + ', ' if keys else ''}_state binary"
    target = to_arrow_schema(_parse_datatype_string(schema))
    chunked = ordered.chunked

    def run(batches):
        current, state, out = None, None, []

        def row(key, state):
            chunk, own = (key[0], key[1:]) if chunked else (0, key)
            return dict(zip(target.names, (chunk, *own, pickle.dumps(state)), strict=True))

        for key, _, _, _, inputs in runs(batches, fed, by):
            mine = lift(inputs)
            if current is not None and key == current:
                state = combine(state, mine)
                continue
            if current is not None:
                out.append(row(current, state))
            current, state = key, mine
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if current is not None:
            out.append(row(current, state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return placed(ordered, df).mapInArrow(run, schema)


def combined(parts: DataFrame, keys: list[str], combine: Callable) -> DataFrame:
    """One row a key: the partial results of its chunks combined in order, FAN_IN at a time, then the results of those, and so on."""
    schema = parts.schema
    target, groups = to_arrow_schema(schema), [*keys, "_group"]

    def run(batches):
        current, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in groups)
                if key == current:
                    state = combine(state, pickle.loads(row["_state"]))
                    continue
                if current is not None:
                    out.append(made(current, state))
                current, state = key, pickle.loads(row["_state"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([made(current, state)], schema=target)

    def made(key, state):
        return dict(zip(keys, key, strict=False)) | {CHUNK: key[-1], "_state": pickle.dumps(state)}

    parts = parts.withColumn("_group", F.col(CHUNK))
    while True:
        several = parts.groupBy(*keys).count().where("count > 1").limit(1).count()
        if not several:
            return parts.drop("_group")
        grouped = parts.withColumn("_group", F.expr(f"`{CHUNK}` div {FAN_IN}")).repartition(*groups).sortWithinPartitions(*groups, CHUNK)
        parts = store(grouped.select(*groups, CHUNK, "_state").mapInArrow(run, schema), "fold-combined").withColumn("_group", F.col(CHUNK))


def fold_chunks(seq: Seq, inputs: list[Column], lift: Callable, combine: Callable, finish: Callable, schema: str, empty: dict | None = None) -> DataFrame:
    """One row for each key: keys and what `finish(state)` makes (a dictionary with the columns of schema).

    lift(frame): the state of a run of rows, a pandas frame with the inputs as c0, c1, ...; combine(a, b): the state of both,
    a's rows ahead of b's. A state should stay small. Without keys an empty sequence gives `empty`, or no row.
    """
    fed = [f"c{i}" for i in range(len(inputs))]
    own = seq.df.select(*seq.keys, *[c for c in seq.order if c not in seq.keys], *[c.alias(n) for c, n in zip(inputs, fed, strict=True)])
    ordered, keys = Ordered(own, seq.order, seq.keys), list(seq.keys)
    parts = partials(ordered, ordered.df, fed, lift, combine)
    if ordered.chunked:
        parts = store(parts, "fold-partials")
        if keys:  # only what goes on elsewhere is combined
            parts = ordered.at_segments(parts, ordered.borders().drop("_head"))
            whole, several = parts.where("_span IS NULL").drop("_span"), parts.where("_span IS NOT NULL").drop("_span")
            parts = whole.unionByName(combined(several, keys, combine))
        else:
            parts = combined(parts, keys, combine)
    out_schema = ", ".join([*(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys), schema])
    target = to_arrow_schema(_parse_datatype_string(out_schema))

    def finished(batches):
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in keys} | finish(pickle.loads(r["_state"])) for r in rows], schema=target)

    made = parts.mapInArrow(finished, out_schema)
    if empty is not None and not keys:
        instead = seq.spark.createDataFrame([tuple(empty[n] for n in target.names)], out_schema)
        made = made.unionByName(instead.join(made.limit(1).select(F.lit(1).alias("_any")), how="left_anti", on=F.lit(True)))
    return made


def scan_chunks(seq: Seq, inputs: list[Column], lift: Callable, combine: Callable, emit: Callable, schema: str) -> DataFrame:
    """seq's rows with the columns of schema: what `emit(before, frame)` gives for each run of rows.

    before: the state of all rows of the key ahead of the run, None if there are none; emit returns a frame with as many rows
    as it got. lift and combine as in fold_chunks; here combine also joins a run's state to the one before.
    """
    fed = [f"c{i}" for i in range(len(inputs))]
    plain = seq.df.columns
    ordered = Ordered(seq.df.withColumns(dict(zip([f"_{n}" for n in fed], inputs, strict=True))), seq.order, seq.keys)
    by, keys = [*([CHUNK] if ordered.chunked else []), *ordered.keys], list(seq.keys)
    df = ordered.df.withColumn("_ahead", F.lit(None).cast("binary"))
    if ordered.chunked:
        going_on = ordered.at_segments(ordered.df, ordered.borders().drop("_span", "_head"), "left_semi") if keys else ordered.df
        inner = going_on.select(CHUNK, *keys, *[c for c in seq.order if c not in keys], *[F.col(f"_{n}").alias(n) for n in fed])
        parts = store(partials(ordered, inner, fed, lift, combine), "scan-partials")
        df = ordered.at_segments(ordered.df, ahead_of(parts, keys, combine))
    columns = to_arrow_schema(_parse_datatype_string(schema))
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in seq.df.schema if f.name not in columns.names), schema])
    kept = [c for c in plain if c not in columns.names]
    inner_names = [f"_{n}" for n in fed]

    def run(batches):
        current, state, done, made = None, None, None, []

        def finished():
            frame = pd.concat(made, ignore_index=True)
            new = [pa.Array.from_pandas(frame[f.name], type=f.type) for f in columns]
            return pa.RecordBatch.from_arrays([*(done.column(c) for c in kept), *new], names=[*kept, *columns.names])

        for key, batch, low, _, inputs in runs(batches, inner_names, by):
            if done is not None and batch is not done:
                yield finished()
                made = []
            done, inputs.columns = batch, fed
            if current is None or key != current:
                held = batch.column("_ahead")[low].as_py()
                current, state = key, None if held is None else pickle.loads(held)
            made.append(emit(state, inputs))
            mine = lift(inputs)
            state = mine if state is None else combine(state, mine)
        if done is not None:
            yield finished()

    return placed(ordered, df).mapInArrow(run, out_schema)


def ahead_of(parts: DataFrame, keys: list[str], combine: Callable) -> DataFrame:
    """(chunk, keys, _ahead): what the chunks ahead of each combine to. A key has one small row a chunk, and a task passes over them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema).replace("_state", "_ahead")
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if current is None or key != current:
                    current, state = key, None
                mine = pickle.loads(row.pop("_state"))
                out.append(row | {"_ahead": None if state is None else pickle.dumps(state)})
                state = mine if state is None else combine(state, mine)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    parted = parts.repartition(*keys) if keys else parts.repartition(1)  # a row a chunk
    made = store(parted.sortWithinPartitions(*keys, CHUNK).mapInArrow(run, schema), "scan-ahead")
    discard(parts)
    return made
