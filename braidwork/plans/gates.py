"""Greedy folds: where the next window opens depends on where the last one did.

Rows are taken chunk by chunk (`Ordered`); no task sees more than one chunk, however long or hot a sequence is.

Openings by time and count have successors: the row that opens next is the first one late enough or far enough. Each
chunk finds the successors of all its rows at once, and for those that lead out of it the chunk and row where they
arrive, so that a chunk becomes a map from the row that it is entered at to the place where it is left. These maps
are composed by doubling: after k rounds the entries of 2^k chunks are known. Other gates carry a small state; chunks
are run from a guessed one, and again if the chunk ahead ends in another, until none changes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.plans.ordered import CHUNK, Ordered
from braidwork.plans.storage import discard, store

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq

NEVER = np.int64(1 << 62)
#: Stands for a null in arrays of times.
MISSING = -NEVER
#: Rounds in which all chunks with a changed state run again; then one chunk of each key at a time.
GUESSES = 8


def successors(t: np.ndarray, length: int, size: int | None) -> np.ndarray:
    """For each row the next one that opens if it does: the first at least `length` later, or `size` rows on; len(t) if none is here."""
    n, ends, top = len(t), t + length, np.maximum.accumulate(t)
    at = np.arange(n)
    found = np.maximum(np.searchsorted(top, ends), at + 1)
    if size is not None:
        found = np.minimum(found, at + size)
        for i in np.flatnonzero(top >= ends):  # an earlier row is as late: times run backwards here
            late = np.flatnonzero(t[i + 1 : i + size] >= ends[i])
            found[i] = i + 1 + late[0] if len(late) else i + size
    return np.minimum(found, n)


def chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the last row of its chain and the chain's length, by pointer doubling."""
    n = len(following)
    last, count, ahead = np.arange(n), np.ones(n, dtype=np.int64), following.copy()
    while len(live := np.flatnonzero(ahead < n)):
        to = ahead[live]
        last[live], count[live], ahead[live] = last[to], count[live] + count[to], ahead[to]
    return last, count


def segments(batches, columns: list[str], keys: list[str]):
    """(key, {column: array}, batch, low, high) for each run of rows alike in `keys`; a run may come in several batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.zeros(batch.num_rows, dtype=bool)
        cuts[0] = True
        for k in keys:
            column = batch.column(k)
            codes = pa.array(list(map(repr, column.to_pylist()))) if pa.types.is_nested(column.type) else column
            codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts[1:] |= codes[1:] != codes[:-1]
        lows = np.flatnonzero(cuts)
        values = {c: batch.column(c).fill_null(int(MISSING)).to_numpy() for c in columns}
        for low, high in zip(lows, [*lows[1:], batch.num_rows], strict=True):
            yield tuple(batch.column(k)[int(low)].as_py() for k in keys), {c: v[low:high] for c, v in values.items()}, batch, int(low), int(high)


def filled(t: np.ndarray, before: int) -> np.ndarray:
    """Times with that of the row before where one is missing."""
    known = np.maximum.accumulate(np.where(t != MISSING, np.arange(len(t)), -1))
    return np.where(known >= 0, t[known], before)


def whole_segments(batches, columns: list[str], keys: list[str]):
    """(key, {column: array}) with all rows of a run together."""
    current, held = None, []
    for key, values, *_ in segments(batches, columns, keys):
        if held and key != current:
            yield current, {c: np.concatenate([h[c] for h in held]) for c in columns}
            held = []
        current = key
        held.append(values)
    if held:
        yield current, {c: np.concatenate([h[c] for h in held]) for c in columns}


def placed(ordered: Ordered, df: DataFrame) -> DataFrame:
    """Rows in order: chunk by chunk, or a key as a whole in one task."""
    by = [*([CHUNK] if ordered.chunked else []), *ordered.keys]
    parted = ordered.by_chunk(df) if ordered.chunked else df.repartition(*ordered.keys) if ordered.keys else df.repartition(1)  # small
    return parted.sortWithinPartitions(*by, *(c for c in ordered.order if c not in by))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def opened(seq: Seq, time: Column, length: int, size: int | None = None, window: str = "_window", opens: str = "_opens") -> DataFrame:
    """seq's rows with `opens`, whether a row opens a window, and `window`, the number (from 0, within the key) of the window it is in.

    A key's first row opens one, then the first row that is `length` microseconds after the last opening row or (with a
    size) that many rows behind it. Where times run backwards, "first" goes by the order. A row without a time has that of
    the row before it, or 0.
    """
    if length <= 0 or size is not None and size < 1:
        raise ValueError("a length and a size must be positive")
    ordered = Ordered(seq.df.withColumn("_t", time), seq.order, seq.keys)
    by = [*([CHUNK] if ordered.chunked else []), *ordered.keys]
    if ordered.chunked:
        if ordered.df.where("_t IS NULL").limit(1).count():
            ordered.running("_t", F.col("_t"), "last")
            ordered.df = ordered.df.withColumn("_t", F.coalesce("_t", F.lit(0)))
        df = ordered.at_segments(ordered.df, chunk_entries(ordered, length, size))
    else:
        df = ordered.df.withColumns({"_span": F.lit(None).cast("long"), "_entry": F.lit(None).cast("long"), "_base": F.lit(None).cast("long")})
    columns = seq.df.columns

    def run(batches):
        current, skip, until, number, before = None, 0, NEVER, 0, 0
        done, flags = None, []
        for key, v, batch, low, _ in segments(batches, ["_t"], by):
            if done is not None and batch is not done:
                yield finished(done, flags)
                flags = []
            done = batch
            if key != current or current is None:
                going_on, entered = batch.column("_span")[low].is_valid, batch.column("_entry")[low]
                current, until, number, before = key, NEVER, (batch.column("_base")[low].as_py() or 0) - 1, 0
                skip = entered.as_py() if entered.is_valid else NEVER if going_on else 0
            t = filled(v["_t"], before)
            before, open_ = t[-1], np.zeros(len(t), dtype=bool)
            late = np.searchsorted(np.maximum.accumulate(t), until) if until != NEVER else len(t)
            i = int(min(late, skip))
            if i < len(t):
                following = successors(t, length, size).tolist()
                while i < len(t):
                    open_[i], last, i = True, i, following[i]
                until, skip = np.int64(t[last] + length), NEVER if size is None else last + size - len(t)
            elif skip != NEVER:
                skip -= len(t)
            numbers = number + np.cumsum(open_)
            number = int(numbers[-1])
            flags.append((open_, numbers))
        if done is not None:
            yield finished(done, flags)

    def finished(batch, flags):
        made = [pa.array(np.concatenate([f[0] for f in flags])), pa.array(np.concatenate([f[1] for f in flags]))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, opens, window])

    return placed(ordered, df).mapInArrow(run, f"{ddl(seq.df)}, `{opens}` boolean, `{window}` long")


def chunk_entries(ordered: Ordered, length: int, size: int | None) -> DataFrame:
    """For chunks and keys that go on over several chunks: `_entry`, the first opening row there (null: none), and `_base`, the number of openings ahead."""
    spans = ordered.borders()
    work = ordered.at_segments(ordered.df, spans, "inner").select(CHUNK, "_span", "_head", "_t", *(c for c in ordered.order if c not in ordered.keys))
    order = [c for c in work.columns if c not in (CHUNK, "_span", "_head", "_t")]
    bounds: dict[int, list] = {}
    for row in work.groupBy("_span", CHUNK).agg(F.max("_t").alias("top"), F.count("*").alias("n")).orderBy("_span", CHUNK).collect():  # two rows a chunk
        bounds.setdefault(row["_span"], []).append((row[CHUNK], row["top"], row["n"]))
    tables = {span: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for span, rows in bounds.items()}
    shared = work.sparkSession.sparkContext.broadcast(tables)

    def leaving(batches):
        """Rows whose successor is in a later chunk, with where it is looked for; and the end of the chain from a key's first row."""
        before = {}
        for (chunk, span, head), v in whole_segments(batches, ["_t"], [CHUNK, "_span", "_head"]):
            t = v["_t"].astype(np.int64)
            offset = before.get(chunk, 0)
            before = {chunk: offset + len(t)}
            following = successors(t, length, size)
            node = (np.int64(chunk) << 40) + offset + np.arange(len(t))
            if head:
                last, count = chains(following)
                yield rows_of(span, node[last[:1]], [-1], [chunk], [NEVER], [0], count[:1])
            out = np.flatnonzero(following == len(t))
            chunks, tops, sizes = shared.value[span]
            later = int(np.searchsorted(chunks, chunk)) + 1
            if later == len(chunks):
                continue
            until, skip = t[out] + length, np.full(len(out), NEVER) if size is None else out + size - len(t)
            ends = np.cumsum(sizes[later:])
            at = np.minimum(np.searchsorted(np.maximum.accumulate(tops[later:]), until), np.searchsorted(ends, skip, side="right"))
            here = at < len(ends)
            out, until, skip, at = out[here], until[here], skip[here], at[here]
            yield rows_of(span, node[out], np.zeros(len(out)), chunks[later + at], until, skip - (ends - sizes[later:])[at], np.zeros(len(out)))

    def rows_of(span, node, kind, chunk, until, skip, count):
        made = [np.full(len(node), span), node, kind, chunk, until, skip, count]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in made], names=["_span", "node", "kind", CHUNK, "until", "skip", "opened"])

    left = store(ordered.by_chunk(work).sortWithinPartitions(CHUNK, "_span", *order).mapInArrow(leaving, f"_span long, node long, kind long, `{CHUNK}` long, until long, skip long, opened long"), "gate-leaving")
    starts, arrivals = left.where("kind = -1"), left.where("kind = 0")

    def entering(batches):
        """For each arrival the row it enters at, the end of that row's chain in the chunk, and how many open on it."""
        before, held, ready = {}, None, None
        for (chunk, span, coming), v in whole_segments(batches, ["_t", "node", "skip"], [CHUNK, "_span", "coming"]):
            if not coming:
                t = v["_t"].astype(np.int64)
                offset = before.get(chunk, 0)
                before, held, ready = {chunk: offset + len(t)}, (t, offset), None
                continue
            t, offset = held
            if ready is None:
                ready = (np.maximum.accumulate(t), *chains(successors(t, length, size)))
            top, last, count = ready
            entry = np.minimum(np.searchsorted(top, v["_t"].astype(np.int64)), v["skip"].astype(np.int64))
            made = [np.full(len(entry), span), v["node"].astype(np.int64), (np.int64(chunk) << 40) + offset + last[entry], np.full(len(entry), chunk), entry, count[entry]]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in made], names=["_span", "node", "next", CHUNK, "_entry", "opened"])

    none = F.lit(0).cast("long")
    rows = work.select(CHUNK, "_span", F.lit(False).alias("coming"), "_t", none.alias("node"), none.alias("skip"), *order)
    coming = arrivals.select(CHUNK, "_span", F.lit(True).alias("coming"), F.col("until").alias("_t"), "node", "skip")
    both = ordered.by_chunk(rows.unionByName(coming, allowMissingColumns=True)).sortWithinPartitions(CHUNK, "_span", "coming", *order)
    edges = store(both.mapInArrow(entering, f"_span long, node long, next long, `{CHUNK}` long, _entry long, opened long"), "gate-entering")

    reached, jump, made = starts.select("node"), edges.select("node", "next"), []
    while True:
        fresh = store(reached.join(jump, "node").select(F.col("next").alias("node")), "gate-reached")
        made.append(fresh)
        if fresh.limit(1).count() == 0:
            break
        reached = reached.unionByName(fresh)
        jump = store(jump.join(jump.select(F.col("node").alias("next"), F.col("next").alias("beyond")), "next").select("node", F.col("beyond").alias("next")), "gate-jumps")
        made.append(jump)
    known = edges.join(reached, "node").select(CHUNK, "_span", "_entry", "opened").unionByName(starts.select(CHUNK, "_span", none.alias("_entry"), "opened"))
    ahead = Window.partitionBy("_span").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    joined = spans.join(known, [CHUNK, "_span"], "left")
    entries = store(joined.select(CHUNK, *ordered.keys, "_span", "_entry", F.coalesce(F.sum("opened").over(ahead), F.lit(0)).alias("_base")), "gate-entries")
    discard(left, edges, *made)
    return entries


def carried(seq: Seq, gate: Callable, inputs: list[Column], name: str) -> DataFrame:
    """seq's rows with `name`, a long: what a gate returns for the values of `inputs`, row by row in order; rows for which it returns None go.

    gate() makes an object for a key, with step(*values), `state` (small, None at first, equal where what follows is equal)
    and `moved` (a number that is added to what the chunks behind return; 0 for gates without).
    """
    fed = [f"_in{i}" for i in range(len(inputs))]
    ordered = Ordered(seq.df.withColumns(dict(zip(fed, inputs, strict=True))), seq.order, seq.keys)
    by, columns = [*([CHUNK] if ordered.chunked else []), *ordered.keys], seq.df.columns
    df = ordered.at_segments(ordered.df, chunk_states(ordered, gate, fed)) if ordered.chunked else ordered.df.withColumns({"_state": F.lit(None).cast("binary"), "_base": F.lit(0).cast("long")})

    def run(batches):
        current, now, base, done, out = None, None, 0, None, []

        def finished():
            made = pa.array(out, pa.int64())
            return pa.RecordBatch.from_arrays([*(done.column(c) for c in columns), made], names=[*columns, name]).filter(made.is_valid())

        for key, _, batch, low, high in segments(batches, [], by):
            if done is not None and batch is not done:
                yield finished()
                out = []
            done = batch
            if now is None or key != current:
                current, now, base = key, gate(), batch.column("_base")[low].as_py() or 0
                held = batch.column("_state")[low].as_py()
                if held is not None:
                    now.state = pickle.loads(held)
            for values in zip(*(batch.column(c)[low:high].to_pylist() for c in fed), strict=True):
                made = now.step(*values)
                out.append(None if made is None else made + base)
        if done is not None:
            yield finished()

    return placed(ordered, df).mapInArrow(run, f"{ddl(seq.df)}, `{name}` long")


def chunk_states(ordered: Ordered, gate: Callable, fed: list[str]) -> DataFrame:
    """For chunks and keys that go on over several chunks: the state that a gate enters with, and what it moved ahead."""
    spans, spark = ordered.borders(), ordered.df.sparkSession
    work = ordered.at_segments(ordered.df, spans, "inner")
    columns = [CHUNK, "_span", *fed, *(c for c in ordered.order if c not in ordered.keys and c not in fed)]
    rows = work.select(*columns)
    order = [c for c in columns if c not in (CHUNK, "_span", *fed)]
    chain = {}
    for row in spans.select("_span", CHUNK).orderBy("_span", CHUNK).collect():  # two rows a chunk
        chain.setdefault(row["_span"], []).append(row[CHUNK])
    entered = {(span, chunk): None for span, chunks in chain.items() for chunk in chunks[:-1]}
    left: dict[tuple, tuple] = {}

    def run(batches):
        current, now = None, None
        for key, _, batch, low, high in segments(batches, [], [CHUNK, "_span"]):
            if now is None or key != current:
                if now is not None:
                    yield ended(current, now)
                current, now = key, gate()
                held = batch.column("_from")[low].as_py()
                if held is not None:
                    now.state = pickle.loads(held)
            for values in zip(*(batch.column(c)[low:high].to_pylist() for c in fed), strict=True):
                now.step(*values)
        if now is not None:
            yield ended(current, now)

    def ended(key, now):
        return pa.RecordBatch.from_pylist([{"chunk": key[0], "span": key[1], "state": pickle.dumps(now.state), "moved": now.moved}], schema=pa.schema([("chunk", pa.int64()), ("span", pa.int64()), ("state", pa.binary()), ("moved", pa.int64())]))

    todo, rounds = list(entered), 0
    while todo:
        asked = spark.createDataFrame([(chunk, span, entered[span, chunk]) for span, chunk in todo], f"`{CHUNK}` long, _span long, _from binary")
        chosen = ordered.by_chunk(rows.join(F.broadcast(asked), [CHUNK, "_span"])).sortWithinPartitions(CHUNK, "_span", *order)
        for row in chosen.mapInArrow(run, "chunk long, span long, state binary, moved long").collect():  # two rows a chunk
            left[row["span"], row["chunk"]] = bytes(row["state"]), row["moved"]
        rounds += 1
        todo = []
        for span, chunks in chain.items():
            for before, chunk in zip(chunks[:-2], chunks[1:-1], strict=True):
                if entered[span, chunk] != left[span, before][0]:
                    entered[span, chunk] = left[span, before][0]
                    todo.append((span, chunk))
                    if rounds >= GUESSES:
                        break
    found = []
    for span, chunks in chain.items():
        base = 0
        for i, chunk in enumerate(chunks):
            state, moved = left[span, chunks[i - 1]] if i else (None, 0)
            base += moved
            found.append((chunk, span, state, base))
    made = spark.createDataFrame(found, f"`{CHUNK}` long, _span long, _state binary, _base long")
    return spans.join(made, [CHUNK, "_span"]).select(CHUNK, *ordered.keys, "_state", "_base")
