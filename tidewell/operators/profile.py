"""Data-quality profiling: every column statistic of a table in as few passes as possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col, numeric_columns, text_columns
from tidewell.functions.text import is_invalid_token
from tidewell.operators.quantiles import column_quantiles

TOP_PROFILE_COLUMNS = 12
TOP_COMPARE_COLUMNS = 10


def null_counts(df: DataFrame, alias: str = "missing") -> DataFrame:
    """One row per column: (column, null count). A single map-side combined aggregate."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(alias)) for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*entries)))


def column_profile(df: DataFrame) -> DataFrame:
    """Type name and null count of each column."""
    types = F.create_map(*[F.lit(part) for pair in df.dtypes for part in pair])
    return null_counts(df, "nulls").select("column", types[F.col("column")].alias("dtype"), "nulls")


def top_missing_columns(df: DataFrame, n: int = TOP_PROFILE_COLUMNS) -> DataFrame:
    return null_counts(df).orderBy(F.desc("missing"), "column").limit(n)


def duplicate_count(df: DataFrame, alias: str = "duplicate_rows") -> DataFrame:
    """Rows minus distinct rows, nulls equal: one scan and one shuffle, before which repeats of a row combine."""
    groups = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias(alias))


def iqr_fences(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    """1.5 IQR fences of each numeric column with at least four values and a spread."""
    columns = numeric_columns(df) if columns is None else list(columns)
    fences = {}
    for column, found in column_quantiles(df, columns, (0.25, 0.75), least=4).items():
        if found and found[0] != found[1]:
            q1, q3 = found
            fences[column] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def _outside(column: str, fence: tuple[float, float]) -> Column:
    return (col(column) < fence[0]) | (col(column) > fence[1])


def total(parts: list[Column]) -> Column:
    """The sum of aggregates; 0 for none."""
    found = F.lit(0).cast("bigint")
    for part in parts:
        found = found + part
    return found


def outlier_total(fences: dict[str, tuple[float, float]]) -> Column:
    return total([F.count_if(_outside(c, fence)) for c, fence in fences.items()])


def missing_total(df: DataFrame) -> Column:
    return total([F.count_if(col(c).isNull()) for c in df.columns])


def invalid_total(df: DataFrame) -> Column:
    return total([F.count_if(is_invalid_token(col(c))) for c in text_columns(df)])


def missing_share(df: DataFrame) -> Column:
    """Null cells over all cells, as an aggregate; 0 for an empty table."""
    return missing_total(df) / F.greatest(F.count(F.lit(1)) * max(len(df.columns), 1), F.lit(1))


def iqr_outlier_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.agg(outlier_total(iqr_fences(df, columns)).alias("outlier_count"))


def completeness(df: DataFrame) -> Column:
    """Mean over the columns of the non-null share, as an aggregate."""
    cells = F.greatest(F.count(F.lit(1)), F.lit(1)) * max(len(df.columns), 1)
    return total([F.count(col(c)) for c in df.columns]) / cells


def quality_score(before: DataFrame, after: DataFrame) -> DataFrame:
    """min(1, completeness after / completeness before)."""
    sides = before.agg(completeness(before).alias("b"), F.lit(None).cast("double").alias("a")).unionByName(
        after.agg(F.lit(None).cast("double").alias("b"), completeness(after).alias("a"))
    )
    one = sides.agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return one.select(
        F.least(F.lit(1.0), F.col("a") / F.greatest(F.col("b"), F.lit(0.01))).alias("quality_score")
    )


def error_profile(df: DataFrame) -> DataFrame:
    """Table size, quality and issue counts as (metric, value) rows.

    Two aggregations over the table: one for all counts, one that finds repeated rows.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        missing_total(df).alias("missing"),
        outlier_total(iqr_fences(df)).alias("outliers"),
        invalid_total(df).alias("invalid"),
    )
    width = len(df.columns)
    cells = F.col("rows") * width
    quality = F.coalesce(F.round(F.try_divide((cells - F.col("missing")) * 100.0, cells), 2), F.lit(0.0))
    entries = {
        "rows": F.col("rows"),
        "columns": F.lit(width),
        "total_cells": cells,
        "quality_score": quality,
        "Missing Values": F.col("missing"),
        "Outliers": F.col("outliers"),
        "Invalid Formats": F.col("invalid"),
    }
    return counts.select(_metric_rows(entries)).unionByName(
        duplicate_count(df).select(F.lit("Duplicate Rows").alias("metric"), F.col("duplicate_rows").cast("double").alias("value"))
    )


def _metric_rows(entries: dict[str, Column]) -> Column:
    return F.inline(
        F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in entries.items()])
    )


def _side_metrics(df: DataFrame, side: str, outliers: bool) -> DataFrame:
    """(side, metric, value) rows of one side of a before/after comparison."""
    entries = {
        "rows": F.count(F.lit(1)).alias("rows"),
        "missing": missing_share(df).alias("missing"),
    }
    if outliers:
        entries["outliers"] = outlier_total(iqr_fences(df)).alias("outliers")
    counts = df.agg(*entries.values())
    rows = counts.select(_metric_rows({name: F.col(name) for name in entries} | {"columns": F.lit(len(df.columns))}))
    dups = duplicate_count(df).select(
        F.lit("duplicates").alias("metric"), F.col("duplicate_rows").cast("double").alias("value")
    )
    return rows.unionByName(dups).select(F.lit(side).alias("side"), "metric", "value")


def cleaning_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Improvement in percent from missing cells, duplicates and kept rows, as one row."""
    long = _side_metrics(before, "before", False).unionByName(_side_metrics(after, "after", False))

    def pick(side: str, metric: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("metric") == metric), F.col("value")))

    one = long.agg(
        *[pick(s, m).alias(f"{m}_{s}") for s in ("before", "after") for m in ("rows", "missing", "duplicates")]
    )
    lost = F.greatest(F.lit(0.0), F.col("missing_before") - F.col("missing_after"))
    deduped = F.when(
        F.col("duplicates_before") > 0,
        F.greatest(
            F.lit(0.0),
            (F.col("duplicates_before") - F.col("duplicates_after"))
            / F.greatest(F.col("duplicates_before"), F.lit(1.0)),
        ),
    ).otherwise(0.0)
    kept = F.least(F.col("rows_after") / F.greatest(F.col("rows_before"), F.lit(1.0)), F.lit(1.0))
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (lost * 0.5 + deduped * 0.3 + kept * 0.2) * 100))
    return one.select(
        F.round(percent, 2).alias("cleaned_percent"),
        F.round(F.col("missing_before") * 100, 2).alias("missing_before_percent"),
        F.round(F.col("missing_after") * 100, 2).alias("missing_after_percent"),
        F.col("duplicates_before").cast("bigint").alias("duplicates_before"),
        F.col("duplicates_after").cast("bigint").alias("duplicates_after"),
    )


def clean_compare(before: DataFrame, after: DataFrame, stored_quality: float) -> DataFrame:
    """Before/after table: size, quality, missing percent, duplicates and outliers."""
    long = _side_metrics(before, "before", True).unionByName(_side_metrics(after, "after", True))
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
        F.max(F.when(F.col("side") == "after", F.col("value"))).alias("after"),
    )
    labels = F.create_map(*[F.lit(x) for x in (
        "rows", "rows", "columns", "columns", "missing", "Missing %", "duplicates", "Duplicate Rows",
        "outliers", "Outlier Count",
    )])
    percent = F.when(F.col("metric") == "missing", 100.0).otherwise(1.0)
    shown = wide.select(
        labels[F.col("metric")].alias("metric"),
        F.round(F.col("before") * percent, 2).alias("before"),
        F.round(F.col("after") * percent, 2).alias("after"),
    )
    quality = shown.where(F.col("metric") == "Missing %").select(
        F.lit("quality").alias("metric"),
        F.round(100 - F.col("before"), 2).alias("before"),
        F.round(F.lit(stored_quality * 100), 2).alias("after"),
    )
    return shown.unionByName(quality)


def missing_by_column(before: DataFrame, after: DataFrame, n: int = TOP_COMPARE_COLUMNS) -> DataFrame:
    """Null counts of both sides per column name; a column missing on a side counts 0."""
    left = null_counts(before, "before")
    right = null_counts(after, "after")
    return (
        left.join(right, "column", "full_outer")
        .na.fill(0, ["before", "after"])
        .orderBy(F.desc(F.col("before") + F.col("after")), "column")
        .limit(n)
    )


def data_characteristics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean bias-corrected skew of the numeric columns and the flags derived from size and types."""
    columns = numeric_columns(df) if columns is None else list(columns)
    skews = []
    for c in columns:
        n = F.count(col(c))
        scale = F.sqrt(n * (n - 1).cast("double")) / (n - 2)
        # Fewer than three values have no skew; a constant column has skew 0.
        spread = F.when(F.stddev_pop(col(c)) == 0, 0.0).otherwise(F.skewness(col(c)) * scale)
        skews.append(F.when(n >= 3, spread))
    if skews:
        summed, known = F.lit(0.0), F.lit(0)
        for s in skews:
            summed = summed + F.coalesce(s, F.lit(0.0))
            known = known + s.isNotNull().cast("int")
        skew = F.try_divide(summed, known)
    else:
        skew = F.lit(0.0)
    stats = df.agg(skew.alias("skewness"), F.count(F.lit(1)).alias("n"))
    return stats.select(
        F.round("skewness", 6).alias("skewness"),
        F.when(F.lit(bool(skews)) & (F.abs("skewness") < 0.8), "normal").otherwise("skewed").alias("distribution"),
        F.lit(bool(skews)).alias("needs_normalization"),
        F.lit(False).alias("needs_standardization"),
        (F.col("n") > 80).alias("has_noise"),
        F.lit(bool(text_columns(df))).alias("has_text"),
    )
