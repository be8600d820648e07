"""Sort keys whose natural order is a wanted one: directions, nulls and case field by field, in one comparable column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits, and the same from behind.
DIGITS, BACKWARDS = "0123456789ABCDEF", "FEDCBA9876543210"


@dataclass(frozen=True)
class By:
    """A field to sort by: a column name or an expression of one."""

    column: str | Column
    descending: bool = False
    last: bool | None = None
    blind: bool = False

    def desc(self) -> By:
        return replace(self, descending=True)

    def nulls_last(self) -> By:
        return replace(self, last=True)

    def nulls_first(self) -> By:
        return replace(self, last=False)

    def ignore_case(self) -> By:
        return replace(self, blind=True)

    def key(self, df: DataFrame) -> Column:
        """A struct that orders df's rows by this field. Nulls are first if ascending, last if descending, unless said otherwise."""
        c = F.col(self.column) if isinstance(self.column, str) else self.column
        kind = df.select(c.alias("c")).schema["c"].dataType
        if self.blind:
            if not isinstance(kind, T.StringType):
                raise TypeError(f"only strings have a case, not {kind.simpleString()}")
            c = F.lower(c)
        last = self.descending if self.last is None else self.last
        absent = F.when(c.isNull(), F.lit(1 if last else -1)).otherwise(F.lit(0))
        return F.struct(absent.alias("absent"), (reversed_(c, kind) if self.descending else c).alias("value"))


def reversed_(c: Column, kind: T.DataType) -> Column:
    """Of the same field a value that orders the other way round, without a loss."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(c)  # -1 - c, which never overflows
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.struct(F.when(F.isnan(c), 0).otherwise(1).alias("number"), F.when(~F.isnan(c), -c).alias("value"))  # NaN is the largest of all
    if isinstance(kind, T.DecimalType):
        return F.negate(c)
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(kind, T.TimestampNTZType):
        return F.bitwise_not(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.concat(F.translate(F.hex(c), DIGITS, BACKWARDS), F.lit("G"))  # the mark puts a prefix behind what it begins
    if isinstance(kind, T.StructType):  # a null field is the least, so from behind the last
        parts = [F.struct(c[f.name].isNull().cast("int").alias("absent"), reversed_(c[f.name], f.dataType).alias("value")).alias(f.name) for f in kind]
        return F.struct(*parts)
    raise TypeError(f"{kind.simpleString()} has no order from behind")


def order_key(df: DataFrame, *fields: By | str | Column) -> Column:
    """One column that orders df's rows by several fields, the first one leading."""
    return F.struct(*[(f if isinstance(f, By) else By(f)).key(df).alias(f"f{i}") for i, f in enumerate(fields)])
