"""Aggregations of a whole sequence or of its keys."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions.ordering import By, order_key
from braidwork.plans.monoid import fold_chunks

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


class Aggregate:
    def _agg(self: Seq, *columns: Column) -> Seq:
        df = self.df.groupBy(*self.keys).agg(*columns)
        return self.with_df(df, self.keys or [df.columns[0]], ts=None)

    def count(self: Seq, name: str = "n") -> Seq:
        return self._agg(F.count("*").alias(name))

    def any(self: Seq, predicate: Column, name: str = "any") -> Seq:
        return self._agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))

    def all(self: Seq, predicate: Column, name: str = "all") -> Seq:
        return self._agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias(name))

    def has_elements(self: Seq, name: str = "has_elements") -> Seq:
        found = self.df.limit(1).agg((F.count("*") > 0).alias(name))
        return self.with_df(found, [name], ts=None)

    def reduce(self: Seq, how: str, column: Column, name: str = "value", seed: Column | None = None) -> Seq:
        """A fold by sum, min, max or product; without seed an empty sequence gives no row."""
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}[how](column)
        if seed is None:
            reduced = self._agg(agg.alias(name), F.count("*").alias("_n"))
            return reduced.with_df(reduced.df.where("_n > 0").drop("_n"))
        combine = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "product": lambda a, b: a * b}[how]
        return self._agg(F.when(agg.isNull(), seed).otherwise(combine(seed, agg)).alias(name))

    def fold_chunks(self: Seq, inputs: list[Column], lift: Callable, combine: Callable, finish: Callable, schema: str, empty: dict | None = None) -> Seq:
        """A fold in opaque code whose result may depend on the order, of a sequence or key of any size: lift(frame) folds a run
        of rows, combine(a, b) two neighbouring results (associative, no more), finish(state) makes the row. No list of
        values is ever held. Without keys an empty sequence gives `empty`, or no row."""
        made = fold_chunks(self, inputs, lift, combine, finish, schema, empty)
        return self.with_df(made, self.keys or [made.columns[0]], ts=None)

    def reduce_ordered(self: Seq, column: Column, seed: Column, step, name: str = "value") -> Seq:
        """A fold whose result depends on the order: step(accumulator, value). Holds a key's values together; use keys."""
        items = F.sort_array(F.collect_list(F.struct(*self.order, column.alias("_v"))))
        return self._agg(F.aggregate(items, seed, lambda acc, x: step(acc, x["_v"])).alias(name))

    reduce_with = reduce

    def collect(self: Seq, *columns: Column) -> Seq:
        """Any aggregate columns."""
        return self._agg(*columns)

    def collect_list(self: Seq, column: Column, name: str = "values") -> Seq:
        items = F.sort_array(F.collect_list(F.struct(*self.order, column.alias("_v"))))
        return self._agg(F.transform(items, lambda x: x["_v"]).alias(name))

    def collect_sorted_list(self: Seq, column: Column, name: str = "values", descending: bool = False) -> Seq:
        items = F.sort_array(F.collect_list(F.struct(column.alias("_v"), *self.order)), not descending)
        return self._agg(F.transform(items, lambda x: x["_v"]).alias(name))

    def last_by_key(self: Seq, key: str, value: Column, name: str = "value") -> Seq:
        """One row for each key with its last value: the rows of collect_map."""
        return self.with_df(self.df.groupBy(*self.keys, key).agg(F.max_by(value, self.place()).alias(name)), [*self.keys, key], ts=None)

    def collect_map(self: Seq, key: str, value: Column, name: str = "map") -> Seq:
        entries = self.last_by_key(key, value, "_v").df
        df = entries.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct(key, "_v"))).alias(name))
        return self.with_df(df, self.keys or [name], ts=None)

    def lists_by_key(self: Seq, key: str, value: Column, name: str = "values") -> Seq:
        """One row for each key with its values in order: the rows of collect_multimap."""
        items = F.sort_array(F.collect_list(F.struct(*self.order, value.alias("_v"))))
        df = self.df.groupBy(*self.keys, key).agg(F.transform(items, lambda x: x["_v"]).alias(name))
        return self.with_df(df, [*self.keys, key], ts=None)

    def collect_multimap(self: Seq, key: str, value: Column, name: str = "map") -> Seq:
        lists = self.lists_by_key(key, value, "_v").df
        df = lists.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct(key, "_v"))).alias(name))
        return self.with_df(df, self.keys or [name], ts=None)

    def group_by(self: Seq, *keys: str) -> Seq:
        """The sequence as one sequence for each key: positional operators then work within keys, aggregates per key."""
        return self.with_df(self.df, keys=[*self.keys, *keys])

    def ungroup(self: Seq) -> Seq:
        return self.with_df(self.df, keys=())

    def top(self: Seq, n: int, *by: Column) -> Seq:
        """The first n rows by these columns; each task keeps n rows."""
        return self.with_df(self.df.orderBy(*by).limit(n))

    def sort_by(self: Seq, *fields: By | str | Column, name: str = "_sort") -> Seq:
        """A stable sort by fields with directions, places of nulls and blindness to case of their own (see `By`): one key column
        `name` leads the order, so positions, merges and chunks follow it."""
        return self.with_df(self.df.withColumn(name, order_key(self.df, *fields)), [name, *[c for c in self.order if c != name]])

    def collect_sorted_by(self: Seq, column: Column, compare: Callable[[Column, Column], Column], name: str = "values") -> Seq:
        """Lists (for each key) sorted by any comparator: compare(x, y) is negative, 0 or positive; ties stay in order. Holds a key's values together."""
        items = F.sort_array(F.collect_list(F.struct(*self.order, column.alias("_v"))))
        numbered = F.transform(items, lambda x, i: F.struct(x["_v"].alias("v"), i.alias("i")))
        ordered = F.array_sort(numbered, lambda x, y: F.coalesce(F.nullif(compare(x["v"], y["v"]).cast("int"), F.lit(0)), x["i"] - y["i"]))
        return self._agg(F.transform(ordered, lambda x: x["v"]).alias(name))

    def sort(self: Seq, *by: str | Column) -> Seq:
        """A stable sort: ties stay in the order they had. The new order is the sort keys, then the old order."""
        df, names = self.df, []
        for i, c in enumerate(by):
            if isinstance(c, str):
                names.append(c)
            else:
                df, names = df.withColumn(f"_sort{i}", c), [*names, f"_sort{i}"]
        return self.with_df(df, [*names, *[c for c in self.order if c not in names]])

    def percentile_by(self: Seq, column: str, *quantiles: float) -> Seq:
        return self._agg(*[F.percentile(column, F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles])

