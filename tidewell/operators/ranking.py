"""Latest and top-n rows. Ties break on the last order column, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key. Spark limits each task to n rows per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    return top_n_per_key(df, keys, [F.desc(time), F.desc(tie)], 1)


def latest(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The newest n rows: each task keeps n, then one merge of those."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def one_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one row, without a join."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
