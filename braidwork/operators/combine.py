"""Joins by overlap, latest value and position; concatenation and merging."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.plans.ordered import Ordered, fits_one_task
from braidwork.plans.storage import store

if TYPE_CHECKING:
    from braidwork.plans.seq import Seq


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


#: Rows of one time bucket (and key) that one task may join.
DENSE = 200_000


def dense_buckets(right: DataFrame, keys: list[str]) -> DataFrame | None:
    """(_c, keys, _parts) of the buckets with more than DENSE rows, a stored table of at most one row for each DENSE of them; None if there is none."""
    counts = right.groupBy("_c", *keys).agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE)
    found = store(counts.select("_c", *keys, F.ceil(F.col("_n") / DENSE).cast("int").alias("_parts")), "dense-buckets")
    return found if found.limit(1).count() else None


def dealt(left: DataFrame, right: DataFrame, parts: DataFrame, on: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Right rows of a dense bucket each in one of its parts (`_part_r`), left rows once for every part (`_part_l`)."""
    named_ = parts.select(F.col("_c").alias("_d"), *[F.col(f"r_{c}").alias(f"_d_{c}") for c in on], "_parts")

    def with_parts(side: DataFrame, bucket: str, prefix: str) -> DataFrame:
        same = F.col(bucket) == F.col("_d")
        for c in on:
            same &= F.col(f"{prefix}{c}") == F.col(f"_d_{c}")
        joined = side.join(named_, same, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        return joined.drop("_d", *[f"_d_{c}" for c in on])

    right = with_parts(right, "_c", "r_").withColumn("_part_r", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    left = with_parts(left, "_b", "l_").withColumn("_part_l", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left, right


class Combine:
    def join(self: Seq, other: Seq, alive: float, other_alive: float = 0.0, on: list[str] | None = None, how: str = "inner") -> Seq:
        """Pairs of rows that are alive together: a row lives from its time for so many seconds, both ends included.

        Columns get the prefixes l_ and r_. Times are cut into buckets as long as the longer life, so that rows
        meet by equality of bucket (and of `on`) before the exact test; a life spans three buckets at most. Of a large
        input, buckets with more than DENSE right rows are dealt into parts, which the left rows of the bucket meet one by one.
        """
        left_us, right_us = round(alive * 1e6), round(other_alive * 1e6)
        width = max(left_us, right_us, 1)
        left = named(self.df.withColumn("us", self.micros()), "l_")
        right = named(other.df.withColumn("us", other.micros()), "r_")

        def bucket(us: str) -> Column:  # rounds down, before 1970 too
            return F.expr(f"({us} - pmod({us}, {width})) div {width}")

        left = left.withColumn("_b", F.explode(F.sequence(bucket(f"(l_us - {right_us})"), bucket(f"(l_us + {left_us})"))))
        right = right.withColumn("_c", bucket("r_us"))
        parts = None if fits_one_task(other.df) else dense_buckets(right, [f"r_{c}" for c in on or []])
        if parts is not None:
            left, right = dealt(left, right, parts, on or [], [f"r_{c}" for c in other.order])
        match = (F.col("_b") == F.col("_c")) & F.col("r_us").between(F.col("l_us") - right_us, F.col("l_us") + left_us)
        for c in on or []:
            match &= F.col(f"l_{c}") == F.col(f"r_{c}")
        if parts is not None:
            match &= F.col("_part_l") == F.col("_part_r")
        joined = left.join(right, match).drop("_b", "_c", "_part_l", "_part_r")
        if how == "left":
            order = [f"l_{c}" for c in self.order]
            lonely = named(self.df.withColumn("us", self.micros()), "l_").join(joined.select(*order).distinct(), order, "left_anti")
            joined = joined.unionByName(lonely, allowMissingColumns=True)
        joined = joined.drop("l_us", "r_us")
        return self.with_df(joined, [*[f"l_{c}" for c in self.order], *[f"r_{c}" for c in other.order]], ts=f"l_{self.ts}", keys=())

    def group_join(self: Seq, other: Seq, alive: float, other_alive: float = 0.0, on: list[str] | None = None, collect: str | None = None) -> Seq:
        """Each row with the number of rows alive with it, and their values of `collect` in order; rows without partner too.

        Numbers alone need no pairs: they are differences of running counts, so bursts and long lives cost nothing.
        """
        if collect is None:
            return self._alive_counts(other, round(alive * 1e6), round(other_alive * 1e6), on or [])
        pairs = self.join(other, alive, other_alive, on, "left")
        mine = [f"l_{c}" for c in self.df.columns]
        hit = F.col(f"r_{other.order[0]}").isNotNull()
        sort = F.struct(*[f"r_{c}" for c in other.order], F.col(f"r_{collect}").alias("_v"))
        values = F.transform(F.sort_array(F.collect_list(F.when(hit, sort))), lambda x: x["_v"]).alias("values")
        parts = [F.count(F.when(hit, 1)).alias("n"), values]
        return self.with_df(pairs.df.groupBy(*mine).agg(*parts), [f"l_{c}" for c in self.order], ts=f"l_{self.ts}", keys=())

    def _alive_counts(self: Seq, other: Seq, left_us: int, right_us: int, on: list[str]) -> Seq:
        """Each row (columns l_*) with n: the rows of `other` up to the end of its time less those before its beginning."""
        mine, places = named(self.df, "l_"), [f"l_{c}" for c in self.order]
        none = F.lit(None).cast(mine.select(F.struct("*").alias("l")).schema["l"].dataType)
        keys = [F.col(k).alias(f"_on{i}") for i, k in enumerate(on)]

        def probes(us: Column, kind: int, sign: int, row: Column) -> DataFrame:
            ids = [F.col(c).alias(f"_o{i}") for i, c in enumerate(self.order)]
            return self.df.select(*keys, us.alias("_us"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"), *ids, row.alias("_row"))

        whole = F.struct(*[F.col(c).alias(f"l_{c}") for c in self.df.columns])
        low, high = probes(self.micros() - right_us, 0, -1, none), probes(self.micros() + left_us, 2, 1, whole)  # at one time: begins, rows, ends
        rows = other.df.select(*keys, other.micros().alias("_us"), F.lit(1).alias("_kind")).where("_us IS NOT NULL")
        union = low.unionByName(high).unionByName(rows, allowMissingColumns=True)
        ids = [f"_o{i}" for i in range(len(self.order))]
        order = ["_us", "_kind", *ids]
        counted = Ordered(union, order, [f"_on{i}" for i in range(len(on))]).running("_seen", F.when(F.col("_kind") == 1, 1), "count").frame().where("_kind != 1")
        known = F.col("_us").isNotNull()
        for i in range(len(on)):
            known = known & F.col(f"_on{i}").isNotNull()
        n = F.coalesce(F.sum(F.when(known, F.col("_seen") * F.col("_sign"))), F.lit(0)).cast("long").alias("n")
        grouped = counted.groupBy(*ids).agg(n, F.first("_row", ignorenulls=True).alias("_row"))
        return self.with_df(grouped.select(*[F.col(f"_row.`{c}`").alias(c) for c in mine.columns], "n"), places, ts=f"l_{self.ts}", keys=())

    # Latest values: rows of all sources in one order, each carrying the last row of the others.

    def _tagged(self: Seq, sources: list[Seq], by: str) -> Seq:
        """Union of the sources' rows as structs s0, s1, ..., ordered by time, source and own order."""
        frames = []
        for i, s in enumerate(sources):
            row = F.struct(*s.df.columns)
            frames.append(s.df.select(F.col(by or s.ts).alias("_at"), F.lit(i).alias("_source"), F.struct(*s.order).cast("string").alias("_tie"), *[F.col(c).alias(f"_o{j}") for j, c in enumerate(s.order)], *[F.col(k) for k in self.keys], row.alias(f"s{i}")))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        places = [c for c in out.columns if c.startswith("_o")]
        return self.with_df(out, ["_at", "_source", *places], ts="_at")

    def with_latest_from(self: Seq, other: Seq) -> Seq:
        """Each row with the last row of the other sequence strictly before it in time order (ties: its own sequence first); rows before any go."""
        union = self._tagged([self, other], None)
        frame = union.ordered().running("latest", F.col("s1"), "last").frame()
        out = frame.where(F.col("s0").isNotNull() & F.col("latest").isNotNull())
        return self.with_df(out.select("s0.*", "latest"))

    def combine_latest(self: Seq, *others: Seq) -> Seq:
        """A row for each arrival from when all sources have one: the last row of each, as s0, s1, ..."""
        sources = [self, *others]
        union = self._tagged(sources, None)
        frame = union.ordered()
        for i in range(len(sources)):
            frame.running(f"c{i}", F.col(f"s{i}"), "last")
        out = frame.frame().dropna(subset=[f"c{i}" for i in range(len(sources))])
        places = [c for c in out.columns if c.startswith("_o")]
        out = out.select("_at", "_source", *places, *self.keys, *[F.col(f"c{i}").alias(f"s{i}") for i in range(len(sources))])
        return self.with_df(out, ["_at", "_source", *places], ts="_at")

    # Positions.

    def zip(self: Seq, *others: Seq) -> Seq:
        """Rows paired by position up to the end of the shortest: structs z0, z1, ... and `position`."""
        sides = [s.ordered().position("_pos") for s in [self, *others]]
        widest, out = max(sides, key=lambda o: o.parts), None
        for i, (s, placed) in enumerate(zip([self, *others], sides, strict=True)):
            side = placed.frame().select(F.col("_pos").alias("position"), *self.keys, F.struct(*s.df.columns).alias(f"z{i}"))
            if widest.chunked:
                side = widest.spread(side, "position", *self.keys)
            out = side if out is None else out.join(side, ["position", *self.keys])
        return self.with_df(out, ["position"])

    zip_with = zip

    def zip_when(self: Seq, name: str, **columns: Column) -> Seq:
        """Each row with values made from it, as a struct."""
        return self.with_df(self.df.withColumn(name, F.struct(*[c.alias(n) for n, c in columns.items()])))

    def zip_with_iterable(self: Seq, values: list, name: str = "other") -> Seq:
        items = self.spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_pos", name])
        side = self.ordered().position("_pos").frame()
        return self.with_df(side.join(items, "_pos").drop("_pos"))

    def has_element(self: Seq, column: str, value) -> Seq:
        return self.with_df(self.df.agg(F.coalesce(F.bool_or(F.col(column) == F.lit(value)), F.lit(False)).alias("has_element")), ["has_element"])

    def first_with_value(self: Seq, *others: Seq) -> Seq:
        """The sequence whose first row is earliest (ties: the first named); all empty: an error when read."""
        sources = [self, *others]
        frames = None
        for i, s in enumerate(sources):
            f = s.df.withColumn("_s", F.lit(i))
            frames = f if frames is None else frames.unionByName(f, allowMissingColumns=True)
        winner = frames.agg(F.min(F.struct(F.col(self.ts).alias("t"), "_s"))["_s"].alias("_w"))
        sure = winner.select(F.when(F.col("_w").isNull(), F.raise_error(F.lit("no source has a value")).cast("int")).otherwise(F.col("_w")).alias("_w"))
        return self.with_df(sure.hint("broadcast").join(frames, F.col("_w") == F.col("_s"), "left").drop("_w", "_s"))

    # Concatenation and merging.

    def _stacked(self: Seq, sources: list[Seq]) -> DataFrame:
        out = None
        for i, s in enumerate(sources):
            f = s.df.withColumn("source_ord", F.lit(i))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def concat_with(self: Seq, *others: Seq) -> Seq:
        """This sequence, then the others: source_ord leads the order."""
        return self.with_df(self._stacked([self, *others]), ["source_ord", *self.order])

    concat = merge_sequential = concat_with

    def _delayed(self: Seq, sources: list[Seq], error: Column | None, build) -> Seq:
        """build(healthy parts of the sources), then their errors: a source ends at its first row where `error` is not null.

        Errors are data: `failed` leads the order, so all rows of all sources come ahead of the errors.
        """
        if error is None:
            return build(sources)
        ended = [s.take_until(error.isNotNull()) for s in sources]
        good = build([s.with_df(s.df.where(error.isNull())) for s in ended])
        bad = self._stacked([s.with_df(s.df.where(error.isNotNull())) for s in ended])
        both = good.df.withColumn("failed", F.lit(0)).unionByName(bad.withColumn("failed", F.lit(1)), allowMissingColumns=True)
        return good.with_df(both, ["failed", *good.order])

    def concat_delay_error(self: Seq, *others: Seq, error: Column | None = None) -> Seq:
        """concat_with in which a source that fails ends, the others go on, and the errors come last."""
        return self._delayed([self, *others], error, lambda parts: parts[0].concat_with(*parts[1:]))

    merge_sequential_delay_error = concat_delay_error

    def concat_with_values(self: Seq, *rows: dict) -> Seq:
        schema = self.df.schema.simpleString().removeprefix("struct<").removesuffix(">")
        return self.concat_with(*[self.with_df(self.spark.createDataFrame([r], schema)) for r in rows])

    def start_with(self: Seq, *others: Seq) -> Seq:
        return self.with_df(self._stacked([*others, self]), ["source_ord", *self.order])

    def merge_with(self: Seq, *others: Seq) -> Seq:
        """All rows, by arrival: event time, ties by source."""
        stacked = self._stacked([self, *others])
        return self.with_df(stacked, [*([self.ts] if self.ts else []), "source_ord", *self.order])

    merge = merge_with

    def merge_delay_error(self: Seq, *others: Seq, error: Column | None = None) -> Seq:
        """merge_with in which a source that fails ends, the others go on, and the errors come last."""
        return self._delayed([self, *others], error, lambda parts: parts[0].merge_with(*parts[1:]))

    def merge_comparing(self: Seq, *others: Seq, by: list[str]) -> Seq:
        """Merge of sequences that are sorted by `by`: the smallest head first, ties to the first source.

        A sequence that is not sorted holds back what follows a large row until that row is passed; the running
        maximum of the key is then what rows are merged by.
        """
        frames = None
        for i, s in enumerate([self, *others]):
            df = s.ordered().running("_held", F.struct(*by), "max").frame().withColumn("source_ord", F.lit(i))
            frames = df if frames is None else frames.unionByName(df, allowMissingColumns=True)
        return self.with_df(frames, ["_held", "source_ord", *self.order])

    merge_comparing_with = merge_ordered = merge_ordered_with = merge_priority = merge_comparing

    def merge_comparing_delay_error(self: Seq, *others: Seq, by: list[str], error: Column | None = None) -> Seq:
        """merge_comparing in which a source that fails ends, the others go on, and the errors come last."""
        return self._delayed([self, *others], error, lambda parts: parts[0].merge_comparing(*parts[1:], by=by))

    merge_priority_delay_error = merge_comparing_delay_error

    def switch_on_next(self: Seq, inner: Seq, on: str | None = None) -> Seq:
        return self.switch_map(inner, on=on)

    def repeat(self: Seq, times: int) -> Seq:
        """The sequence times + 1 times over."""
        rounds = self.spark.range(times + 1).withColumnRenamed("id", "round")
        return self.with_df(self.df.crossJoin(F.broadcast(rounds)), ["round", *self.order])  # times + 1 rows

    def sequence_equal(self: Seq, other: Seq, columns: list[str]) -> Seq:
        """One row `equal`: the same values at the same places, and equally many."""
        mine, others = self.ordered().position("_pos"), other.ordered().position("_pos")
        a, b = mine.frame().select("_pos", F.struct(*columns).alias("a")), others.frame().select("_pos", F.struct(*columns).alias("b"))
        widest = max(mine, others, key=lambda o: o.parts)
        if widest.chunked:
            a, b = widest.spread(a, "_pos"), widest.spread(b, "_pos")
        odd = a.join(b, "_pos", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        return self.with_df(odd.agg((F.count("*") == 0).alias("equal")), ["equal"])

