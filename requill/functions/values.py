"""Normal forms of values, so that equal results compare as equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """A type that holds the values of both, or None if they have none in common."""
    if a == b:
        return a
    number = lambda t: isinstance(t, T.NumericType)
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if number(a) and number(b):
        if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType) or isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            scale = max(t.scale for t in (a, b) if isinstance(t, T.DecimalType))
            whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in (a, b))
            return T.DecimalType(min(38, whole + scale), min(scale, 38 - min(whole, 38)))
        return T.LongType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return inner and T.ArrayType(inner)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and len(a) == len(b):
        parts = [common_type(x.dataType, y.dataType) for x, y in zip(a, b, strict=True)]
        return None if None in parts else T.StructType([T.StructField(f"f{i}", p) for i, p in enumerate(parts)])
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        key, value = common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType)
        return key and value and T.MapType(key, value)
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, moments) and isinstance(b, moments):
        return T.TimestampNTZType()
    return T.StringType() if isinstance(a, T.StringType) and isinstance(b, T.StringType) else None


def normal(column: Column, kind: T.DataType) -> Column:
    """Floats rounded to DIGITS (NaN and infinities as they are), arrays and structs by their parts, maps as sorted entries."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = column.cast("double")
        # Beyond 2**53 a double has no decimals to round; rounding it as a decimal could only do harm.
        return F.when(F.isnan(wide) | (F.abs(wide) > F.lit(float(2**53))), wide).otherwise(F.round(wide, DIGITS))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: normal(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [normal(column.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else column
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(normal(e["key"], kind.keyType).alias("k"), normal(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    return column


def positional(df: DataFrame) -> DataFrame:
    """Columns by place: c0, c1 and so on, so that repeated names do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def normalised(df: DataFrame, kinds: list[T.DataType] | None = None) -> DataFrame:
    """All values in normal form; ``kinds`` are types to cast to first."""
    placed = positional(df)
    own = [f.dataType for f in placed.schema]
    columns = []
    for i, kind in enumerate(kinds or own):
        c = F.col(f"c{i}")
        columns.append(normal(c.cast(kind) if kind != own[i] else c, kind).alias(f"c{i}"))
    return placed.select(*columns)


def multiset(df: DataFrame) -> DataFrame:
    """Each distinct row in normal form, with how often it occurs."""
    rows = normalised(df)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
