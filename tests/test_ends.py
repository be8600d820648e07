"""Races, concatenations and gathered errors of sequences that end well, fail or never end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidwork import sources
from braidwork.plans.seq import Seq

T0, US = dt.datetime(2024, 1, 1), 1_704_067_200_000_000


def values(spark, *numbers, at=0):
    """One row a second, from so many seconds on."""
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=at + i), v) for i, v in enumerate(numbers)], "seq long, ts timestamp_ntz, value int")
    return Seq(df, "seq", "ts")


def second(n):
    return US + n * 1_000_000


def read(seq):
    return [r.value for r in seq.df.orderBy(*seq.order).collect()]


def ended(seq):
    return [tuple(r) for r in seq.end_signal().collect()]


def test_first_winner(spark):
    assert read(values(spark, *range(1, 11)).first_with_signal(values(spark, *range(11, 21), at=1))) == list(range(1, 11))
    assert read(values(spark, 1, 2).first(values(spark, 3))) == [1, 2]  # ties go to the first named


def test_second_winner(spark):
    never = values(spark).never_ending()
    race = never.first_with_signal(values(spark, *range(11, 21), at=5), never.ending(second(9)))
    assert read(race) == list(range(11, 21)) and ended(race) == [(second(14), None)]


def test_second_emits_error(spark):
    race = values(spark).never_ending().first_with_signal(values(spark).ending(second(3), "forced failure"))
    assert read(race) == [] and ended(race) == [(second(3), "forced failure")]
    with pytest.raises(PySparkException, match="forced failure"):
        race.raising().df.collect()


def test_empty_sources_win(spark):
    late = values(spark, 1, at=10)
    assert read(late.or_(values(spark))) == []  # completes at once
    assert read(late.or_(values(spark).ending(second(5)))) == [] and read(late.or_(values(spark).ending(second(15)))) == [1]
    assert read(late.or_(values(spark).ending(second(10), "late"))) == [1]  # a row ahead of an end at one time
    endless = values(spark).never_ending().or_(values(spark).never_ending())
    assert read(endless) == [] and ended(endless) == []


def test_a_winner_that_fails_later(spark):
    race = values(spark, 1, 2, 3).ending(second(1), "broken").first_with_signal(values(spark, 7, at=5))
    assert read(race) == [1, 2] and ended(race) == [(second(1), "broken")]
    assert read(race.filter(F.col("value") > 1)) == [2]
    with pytest.raises(PySparkException, match="broken"):
        race.filter(F.col("value") > 1).raising().df.collect()
    assert read(values(spark, 1).raising()) == [1]


def test_concat_of_failing_sources(spark):
    good, bad = values(spark, 1, 2), values(spark, 3, 4, at=5).ending(second(6), "first")
    both = good.concat_ended(bad, values(spark, 9))
    assert read(both) == [1, 2, 3, 4] and ended(both) == [(second(6), "first")]
    assert read(good.concat_ended(values(spark, 9, at=3))) == [1, 2, 9] and ended(good.concat_ended(values(spark, 9, at=3))) == [(second(3), None)]
    endless = good.concat_ended(values(spark, 3).never_ending(), values(spark, 9))
    assert read(endless) == [1, 2, 3] and ended(endless) == []


def test_errors_are_gathered(spark):
    one, two, three = values(spark, 1).ending(second(9), "one"), values(spark, 2, at=1), values(spark, 3, at=2).ending(None, "three")
    both = one.concat_ended_delay_error(two, three)
    assert read(both) == [1, 2, 3] and ended(both) == [(second(9), "one; three")]
    merged = three.merge_ended_delay_error(two, one)
    assert read(merged) == [1, 2, 3] and ended(merged) == [(second(9), "three; one")]
    assert ended(two.concat_ended_delay_error(one.never_ending())) == []
    zipped = sources.zip_delay_error(one, two, three)
    assert zipped.df.count() == 0 and ended(zipped) == [(second(9), "one; three")]
    whole = sources.zip_delay_error(two, values(spark, 5))
    assert [(r.z0.value, r.z1.value) for r in whole.df.collect()] == [(2, 5)] and ended(whole)[0][1] is None


def test_ending_at_error(spark):
    seq = values(spark, 1, 2, 3, 4).ending_at_error(F.when(F.col("value") == 3, "three"))
    assert read(seq) == [1, 2] and ended(seq) == [(second(2), "three")]
    assert ended(values(spark, 1).ending_at_error(F.when(F.col("value") == 3, "three"))) == [(second(0), None)]
