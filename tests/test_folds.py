"""Folds that combine, opaque handlers, table functions and sort keys, on one task and on chunks."""

from __future__ import annotations

import datetime as dt
import functools
import math
import random
import sys
from decimal import Decimal

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidwork.functions.ordering import By, order_key
from braidwork.plans import monoid
from braidwork.plans.seq import Seq

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules

M = 1_000_003


@pytest.fixture(params=["one task", "chunks"])
def ways(request, spark, monkeypatch):
    """The same results in one task and with everything chunked, where results are combined three at a time."""
    if request.param == "chunks":
        spark.conf.set("spark.braidwork.singleTaskBytes", "0")
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        monkeypatch.setattr(monoid, "FAN_IN", 3)
    yield
    spark.conf.unset("spark.braidwork.singleTaskBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def compose(a, b):
    """First x -> a[0] x + a[1], then b: associative, and not commutative."""
    return a[0] * b[0] % M, (b[0] * a[1] + b[1]) % M


def lift(frame: pd.DataFrame):
    state = (1, 0)
    for a, b in zip(frame["c0"].tolist(), frame["c1"].tolist(), strict=True):
        state = compose(state, (a, b))
    return state


def numbers(spark, n=600, keyed=True):
    rng = random.Random(n)
    rows = [(i, ("hot" if rng.random() < 0.9 else rng.choice([None, "a", "z"])) if keyed else "all", rng.randrange(1, M), rng.randrange(M)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, key string, a long, b long").repartition(5)
    return rows, Seq(df, "id", keys=["key"] if keyed else [])


@pytest.mark.parametrize("keyed", [False, True])
def test_fold_chunks(spark, ways, keyed):
    rows, seq = numbers(spark, keyed=keyed)
    folded = seq.fold_chunks([F.col("a"), F.col("b")], lift, compose, lambda s: {"p": s[0], "q": s[1]}, "p long, q long")
    assert "collect_list" not in folded.df._jdf.queryExecution().toString()
    right = {}
    for _, k, a, b in rows:
        right[k] = compose(right.get(k, (1, 0)), (a, b))
    got = {(r.key if keyed else "all"): (r.p, r.q) for r in folded.df.collect()}
    assert got == right


def test_fold_of_nothing(spark, ways):
    none = Seq(spark.createDataFrame([], "id long, a long, b long"), "id")
    args = [F.col("a"), F.col("b")], lift, compose, lambda s: {"p": s[0]}, "p long"
    assert none.fold_chunks(*args).df.count() == 0
    assert [r.p for r in none.fold_chunks(*args, empty={"p": 7}).df.collect()] == [7]
    one = Seq(spark.createDataFrame([(1, 5, 6)], "id long, a long, b long"), "id")
    assert [r.p for r in one.fold_chunks(*args, empty={"p": 7}).df.collect()] == [5]


@pytest.mark.parametrize("keyed", [False, True])
def test_scan_chunks(spark, ways, keyed):
    rows, seq = numbers(spark, 300, keyed)

    def emit(before, frame):
        state, out = before or (1, 0), []
        for a, b in zip(frame["c0"].tolist(), frame["c1"].tolist(), strict=True):
            state = compose(state, (a, b))
            out.append(state[1])
        return pd.DataFrame({"q": out})

    got = {r.id: (r.q, r.a) for r in seq.scan_chunks([F.col("a"), F.col("b")], lift, compose, emit, "q long").df.collect()}
    right, state = {}, {}
    for i, k, a, b in rows:
        state[k] = compose(state.get(k, (1, 0)), (a, b))
        right[i] = (state[k][1], a)
    assert got == right


# Handlers.


def small(spark, n=20, keys=()):
    return Seq(spark.range(n).select(F.col("id").alias("at"), (F.col("id") % 3).alias("k")).repartition(4), "at", keys=list(keys))


def handled(seq, function):
    return sorted((r.at, r.v) for r in seq.handle_with(function, "v long").df.collect())


def test_handle_emits_filters_and_completes(spark):
    def even(row, sink):
        if row["at"] % 2 == 0:
            sink.next({"v": row["at"] * 10})

    def until_eleven(row, sink):
        if row["at"] == 11:
            sink.next({"v": -1})
            sink.complete()
        elif row["at"] > 13:
            sink.error("never reached")
        else:
            sink.next({"v": row["at"]})

    assert handled(small(spark), even) == [(i, i * 10) for i in range(0, 20, 2)]
    assert handled(small(spark), until_eleven) == [(i, i) for i in range(11)] + [(11, -1)]
    assert handled(small(spark), lambda row, sink: sink.complete()) == []
    assert handled(small(spark, 0), even) == []


def test_handle_fails(spark):
    def bad(row, sink):
        sink.next({"v": 1})
        if row["at"] == 7:
            raise KeyError("of its own")

    def twice(row, sink):
        sink.next({"v": 1})
        sink.next({"v": 2})

    def late(row, sink):
        sink.complete()
        sink.next({"v": 1})

    for function, said in ((bad, "of its own"), (twice, "more than one call to next"), (lambda row, sink: sink.error("asked for"), "asked for")):
        with pytest.raises(PySparkException, match=said):
            handled(small(spark), function)
    assert handled(small(spark), late) == []  # the completion comes first
    assert handled(small(spark).take_until(F.col("at") == 6), bad) == [(i, 1) for i in range(7)]


def test_handle_by_key_replaces_columns(spark):
    def third(row, sink):
        if row["at"] // 3 == row["k"] + 1:
            sink.complete()
        else:
            sink.next({"k": row["k"], "at": row["at"], "v": 0})

    rows = small(spark, 20, ["k"]).handle_with(third, "v long").df.collect()
    assert sorted(r.at for r in rows) == [i for i in range(20) if i // 3 < i % 3 + 1]


# Table functions.


class Pairs:
    """Yields a row for each two rows, and the last one alone."""

    def __init__(self):
        self.held = None

    def eval(self, row):
        if self.held is None:
            self.held = row["at"]
        else:
            yield self.held, row["at"]
            self.held = None

    def terminate(self):
        if self.held is not None:
            yield self.held, None


def test_flat_map_table(spark):
    rows = small(spark, 20, ["k"]).flat_map_table(Pairs, "low long, high long", order=["low"])
    right = [tuple((ids + [None])[i : i + 2]) for k in range(3) for ids in [[i for i in range(20) if i % 3 == k]] for i in range(0, len(ids), 2)]
    assert sorted((r.low, r.high or -1) for r in rows.df.collect()) == sorted((a, b or -1) for a, b in right) and rows.order == ["low"]
    assert sorted(r.low for r in small(spark, 5).flat_map_table(Pairs, "low long, high long").df.collect()) == [0, 2, 4]
    spark.conf.set("spark.braidwork.singleTaskBytes", "0")
    with pytest.raises(ValueError, match="needs keys"):
        small(spark, 5).flat_map_table(Pairs, "low long, high long")
    spark.conf.unset("spark.braidwork.singleTaskBytes")
    with pytest.raises(TypeError):
        small(spark, 5).flat_map_table(Pairs, "low long, high long", colour=1)


# Sort keys.

VALUES = {
    "long": [None, 0, -1, 1, 2**63 - 1, -(2**63), 77],
    "int": [None, 0, -(2**31), 2**31 - 1, 5],
    "double": [None, 0.0, -1.5, float("nan"), float("inf"), float("-inf"), 1e-300, 2.5],
    "string": [None, "", "a", "ab", "abc", "B", "b", "é", "😀", "z\u0000", "z"],
    "binary": [None, b"", b"\x00", b"\xff", b"\xff\x00", b"a"],
    "boolean": [None, True, False],
    "decimal(20,3)": [None, Decimal("1.5"), Decimal("-99999999999999999.999"), Decimal("0")],
    "date": [None, dt.date(1960, 1, 1), dt.date(2024, 2, 29), dt.date(1, 1, 1)],
    "timestamp": [None, dt.datetime(1960, 1, 1), dt.datetime(2024, 1, 1, 1, 1, 1, 5)],
    "timestamp_ntz": [None, dt.datetime(1960, 1, 1), dt.datetime(2024, 1, 1, 1, 1, 1, 5)],
}


def compared(a, b):
    rank = lambda x: (math.isnan(x), 0 if math.isnan(x) else x) if isinstance(x, float) else x.encode() if isinstance(x, str) else x
    return (rank(a) > rank(b)) - (rank(a) < rank(b))


@pytest.mark.parametrize("kind", VALUES)
def test_sort_keys_of_every_type(spark, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES[kind])], f"i int, v {kind}").repartition(3)
    fields = {"up": By("v"), "down": By("v").desc(), "up, last": By("v").nulls_last(), "down, first": By("v").desc().nulls_first()}
    keyed = df.select("i", *[order_key(df, f).alias(n) for n, f in fields.items()])
    for name in fields:
        order = [r.i for r in keyed.orderBy(f"`{name}`").collect()]
        sign = -1 if "down" in name else 1
        present = sorted((i for i, v in enumerate(VALUES[kind]) if v is not None), key=functools.cmp_to_key(lambda a, b: sign * compared(VALUES[kind][a], VALUES[kind][b])))  # noqa: B023
        assert order == (present + [0] if name in ("down", "up, last") else [0] + present)


def test_sort_keys_of_structs_and_misuse(spark):
    df = spark.createDataFrame([(0, (1, "b")), (1, (1, None)), (2, (None, "a")), (3, (2, "a")), (4, None)], "i int, v struct<a: int, b: string>")
    up = [r.i for r in df.orderBy(order_key(df, "v")).collect()]
    assert up == [4, 2, 1, 0, 3] and [r.i for r in df.orderBy(order_key(df, By("v").desc())).collect()] == up[::-1]
    with pytest.raises(TypeError):
        order_key(df, By("i").ignore_case())
    with pytest.raises(TypeError):
        order_key(df.withColumn("m", F.array("i")), By("m").desc())


def test_sort_by_is_stable_in_any_way(spark, ways):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "A", "b", None]), rng.choice([1.5, 2.5, None])) for i in range(300)]
    seq = Seq(spark.createDataFrame(rows, "id long, s string, x double").repartition(5), "id")
    got = [r.id for r in sorted(seq.sort_by(By("s").ignore_case().desc(), By("x").nulls_last()).index().df.collect(), key=lambda r: r["index"])]
    right = sorted(rows, key=lambda r: ((r[1] is None, -ord(r[1].lower()) if r[1] else 0), (r[2] is None, r[2] or 0), r[0]))
    assert got == [r[0] for r in right]


def test_merge_by_descending_keys(spark):
    df = spark.range(20).select("id", (F.col("id") % 7).alias("v"))
    sides = [Seq(df.where(F.col("id") % 2 == i), "id") for i in (0, 1)]
    sorted_sides = [s.sort_by(By("v").desc()) for s in sides]
    merged = sorted_sides[0].merge_comparing(sorted_sides[1], by=["_sort"]).index()
    got = [r.v for r in sorted(merged.df.collect(), key=lambda r: r["index"])]
    assert got == sorted(got, reverse=True) and len(got) == 20


def test_collect_sorted_by_a_comparator(spark):
    df = spark.createDataFrame([(0, "k", "ccc"), (1, "k", "a"), (2, "k", "bb"), (3, "k", "a2"), (4, "k", ""), (5, "j", "x")], "id int, k string, v string")
    lists = Seq(df, "id", keys=["k"]).collect_sorted_by(F.col("v"), lambda x, y: F.length(y) - F.length(x))
    assert {r.k: r["values"] for r in lists.df.collect()} == {"k": ["ccc", "bb", "a2", "a", ""], "j": ["x"]}
