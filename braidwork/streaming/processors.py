"""State of streaming operators that wait for the watermark: list state of batches' rows, timers on event time."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The store of Spark's that has list state and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys that share state, a timer and calls, which cost more than a key's few rows; spark.braidwork.streamBuckets overrides it. A checkpoint keeps its number.
BUCKETS = 1024


def named_key(df: DataFrame, keys: list[str]) -> Column:
    """The keys as one string, which null and text can't confuse."""
    zeroed = [F.col(k) + F.lit(0.0).cast(t) if t in ("double", "float") else F.col(k) for k in keys for t in [df.schema[k].dataType.simpleString()]]  # -0.0 is 0.0
    texts = [c.cast("string") for c in zeroed]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]) if texts else F.lit("")


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """What a processor makes of the rows of a bucket of keys (`_key` tells them apart); the session's streams use the store that it needs from here on."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
    buckets = int(conf.get("spark.braidwork.streamBuckets", str(BUCKETS)))
    rows = rows.withColumn("_key", named_key(rows, keys)).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    processor.names = rows.columns  # frames have other names for columns that are no identifiers
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Waiting(StatefulProcessor):
    """Rows of a bucket of keys wait until the watermark has passed them. A batch's rows are appended as one element of a list; what waits
    is only read, and its rest written anew, when a timer says that some of it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.next = handle.getValueState("next", "ms long")

    def ring_at(self, ms: int) -> None:
        """One timer a bucket: the earliest that is wanted."""
        held = self.next.get() if self.next.exists() else None
        if held is not None:
            if held[0] <= ms:
                return
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(ms)
        self.next.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [f for f in rows if len(f)]
        if frames:
            frame = pd.concat(frames, ignore_index=True).set_axis(self.names, axis=1)
            self.waiting.appendValue((pickle.dumps(frame),))
            self.ring_at(max(int(frame["_ms"].min()), timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def due(self, watermark: int) -> pd.DataFrame | None:
        """Rows behind the watermark; the others wait on, and a timer is set for the first of them."""
        self.next.clear()
        self.held_keys: set[str] = set()
        held = [pickle.loads(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        if not held:
            return None
        frame = pd.concat(held, ignore_index=True)
        ready = frame["_ms"] < watermark
        rest = frame[~ready]
        if len(rest):
            self.held_keys = set(rest["_key"])
            self.waiting.put([(pickle.dumps(rest),)])
            self.ring_at(int(rest["_ms"].min()) + 1)
        else:
            self.waiting.clear()
        return frame[ready]

    def close(self) -> None:
        pass


class WaitingFold(Waiting):
    """step(state, rows in order) -> (state, rows out) for each key, for the rows that the watermark has passed; the states of a bucket's keys are kept together."""

    def __init__(self, step: Callable, initial: tuple, order: str, expire_ms: int | None):
        self.step, self.initial, self.order, self.expire_ms = step, initial, order, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states = handle.getValueState("states", "states binary")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        now = self.due(watermark)
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        changed, outs = False, []
        if now is not None and len(now):
            for name, rows in now.sort_values(self.order).groupby("_key", sort=False):
                before, _ = states.get(name, (self.initial, None))
                after, out = self.step(tuple(before), rows.drop(columns=["_ms", "_key", "_bucket"]))
                states[name] = tuple(x.item() if isinstance(x, np.generic) else x for x in after), int(rows["_ms"].max())
                outs.append(out)
            changed = True
        if self.expire_ms is not None and states:
            idle = states.keys() - self.held_keys
            gone = {name for name in idle if states[name][1] + self.expire_ms < watermark}
            states = {name: s for name, s in states.items() if name not in gone}
            changed = changed or bool(gone)
            if idle - gone:
                self.ring_at(min(states[name][1] for name in idle - gone) + self.expire_ms + 1)
        if changed and states:
            self.states.update((pickle.dumps(states),))
        elif changed:
            self.states.clear()
        if outs:
            yield pd.concat(outs, ignore_index=True)


def places(*sides: tuple[pd.Series, pd.Series]) -> list[np.ndarray]:
    """(keys, times) of each side as numbers that are ordered by key, then time, and compare across sides."""
    codes = pd.factorize(np.concatenate([k.to_numpy() for k, _ in sides]))[0].astype(np.int64)
    times, rank = np.unique(np.concatenate([t.to_numpy(dtype=np.int64) for _, t in sides]), return_inverse=True)
    return np.split(codes * len(times) + rank, np.cumsum([len(k) for k, _ in sides])[:-1])


class Windows(Waiting):
    """Openings (_side 0, a struct `l`), rows (1, a struct `r`) and closings (2) of a bucket of keys; open windows are a list of their own."""

    def __init__(self, length_us: int):
        self.length_us = length_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "rows binary")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        now = self.due(watermark)
        held = [pickle.loads(x[0]) for x in self.open.get()] if self.open.exists() else []
        if now is not None:
            fresh = now[now["_side"] == 0]
            if len(fresh):
                held.append(fresh.assign(_end=fresh["_us"] + self.length_us))
        if not held:
            return
        windows = pd.concat(held, ignore_index=True)
        if now is not None and len(now):
            now = now.astype({"_us": "int64"})
            shut, rows = now[now["_side"] == 2], now[now["_side"] == 1]
            if len(shut):  # the first one behind the opening; earlier ones have closed what was open then
                shut_at, opened_at = places((shut["_key"], shut["_us"]), (windows["_key"], windows["_us"]))
                order = np.argsort(shut_at, kind="stable")
                at = np.searchsorted(shut_at[order], opened_at, side="right")
                found = np.minimum(at, len(order) - 1)
                mine = (at < len(order)) & (shut["_key"].to_numpy()[order][found] == windows["_key"].to_numpy())
                first = np.where(mine, shut["_us"].to_numpy()[order][found], np.iinfo(np.int64).max)
                windows["_end"] = np.minimum(windows["_end"].to_numpy(), first)
            if len(rows):
                row_at, begin, end = places((rows["_key"], rows["_us"]), (windows["_key"], windows["_us"]), (windows["_key"], windows["_end"]))
                order = np.argsort(row_at, kind="stable")
                low, high = np.searchsorted(row_at[order], begin), np.searchsorted(row_at[order], end, side="right")
                count = np.maximum(high - low, 0)
                left = np.repeat(np.arange(len(windows)), count)
                right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                if len(left):
                    yield pd.DataFrame({"l": windows["l"].to_numpy()[left], "r": rows["r"].to_numpy()[order][right]})
        alive = windows[windows["_end"] // 1000 >= watermark]
        if len(alive):
            self.open.put([(pickle.dumps(alive),)])
            self.ring_at(int(alive["_end"].min()) // 1000 + 1)
        else:
            self.open.clear()
