"""Column selectors, column naming and JSON-safe projections. All of it is driver-side schema work."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """The column of exactly this name: dots and back ticks are part of it, not a path."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in table order; booleans are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def normalise_names(names: Sequence[str]) -> list[str]:
    """Lower-case snake names; a repeated name gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def with_normalised_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_names(df.columns))


def finite(column: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def _safe(column: Column, kind: T.DataType) -> Column:
    """The column with every non-finite float below it, at any depth, set to null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column)
    if isinstance(kind, T.ArrayType) and _has_float(kind.elementType):
        return F.transform(column, lambda item: _safe(item, kind.elementType))
    if isinstance(kind, T.MapType) and _has_float(kind.valueType):
        return F.transform_values(column, lambda _, value: _safe(value, kind.valueType))
    if isinstance(kind, T.StructType) and _has_float(kind):
        fields = [_safe(column.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def _has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_float(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_float(f.dataType) for f in kind)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def json_safe(df: DataFrame) -> DataFrame:
    """Null out non-finite floats everywhere, nested values included. Types stay native."""
    return df.select(*[_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema])


def iso_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text to the second, without a zone."""
    replaced = {
        f.name: F.date_format(col(f.name), "yyyy-MM-dd'T'HH:mm:ss")
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(replaced) if replaced else df


def arrays_to_json(df: DataFrame) -> DataFrame:
    """Array columns as JSON text."""
    replaced = {f.name: F.to_json(col(f.name)) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return df.withColumns(replaced) if replaced else df


def clamp(column: Column, low, high) -> Column:
    """Null-preserving clamp. ``least`` and ``greatest`` skip nulls, hence the guard."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))
