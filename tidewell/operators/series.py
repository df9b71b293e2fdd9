"""Ordered series: positions, row frames, trends, anomalies and linear forecasts.

A series is the rows of one key in an explicit order. A plain window sorts a whole series in one task, so it
is used only when the longest series has a proven size. Longer series, and tables without a key, are cut into
chunks of consecutive rows, each with a halo of the neighbouring rows its frames reach into; the result is
the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.operators.keyed import join_on
from tidewell.operators.ranking import top_n_per_key
from tidewell.session import materialise

# Rows of one series that one task may order.
SERIES_ROWS = 1_000_000
# Rows per chunk of a longer series.
CHUNK_ROWS = 100_000

MIN_POINTS = 10
SHORT, LONG = 7, 30
# Fixed value: the confidence stated for a trend.
TREND_CONFIDENCE = 0.8


def longest_series(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counts combine map-side."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _fits_one_task(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether whole series may be ordered by one task each; a table without keys never is."""
    return bool(keys) and longest_series(df, keys) <= SERIES_ROWS


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Adds the 0-based position of each row in its series. ``order`` must be total within a key."""
    if _fits_one_task(df, keys):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, place.cast("bigint"))
    return _position_by_range(df, keys, order, name)


def _position_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Positions without one task per series: range partitions, their sizes, and running offsets."""
    # The partition number must not change between the two uses, so the ranged rows are written once.
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        # One row per key and range partition it spans.
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    else:
        # One row per range partition, summed up on the driver.
        counts = sorted((row["_part"], row["_n"]) for row in sizes.collect())
        starts = itertools.accumulate((n for _, n in counts), initial=0)
        rows = [(part, start) for (part, _), start in zip(counts, starts)]
        offsets = df.sparkSession.createDataFrame(rows, "_part int, _offset bigint")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    placed = join_on(ranged.withColumn("_local", local), offsets, [*keys, "_part"])
    return placed.select(*df.columns, (F.col("_offset") + F.col("_local")).cast("bigint").alias(name))


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    make: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Adds window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    ``make`` gets the ordered window of a series and returns the new columns.
    """
    if _fits_one_task(df, keys):
        return df.withColumns(make(Window.partitionBy(*keys).orderBy(*order)))
    placed = _position_by_range(df, keys, order, "_seq")
    return over_positions(placed, keys, "_seq", before, after, make).drop("_seq")


def over_positions(
    placed: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    make: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """The same for rows that know their position, chunk by chunk with a halo of ``before`` and ``after`` rows."""
    home = F.floor(F.col(position) / CHUNK_ROWS)
    first = F.floor(F.greatest(F.col(position) - after, F.lit(0)) / CHUNK_ROWS)
    last = F.floor((F.col(position) + before) / CHUNK_ROWS)
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(first, last)))
    framed = spread.withColumns(make(Window.partitionBy(*keys, "_chunk").orderBy(position)))
    return framed.where("_chunk = _home").drop("_home", "_chunk")


def _full_mean(column: str, window: WindowSpec, back: int, ahead: int) -> Column:
    """Mean over a row frame, null unless every row of the frame has a value."""
    frame = window.rowsBetween(-back, ahead)
    return F.when(F.count(column).over(frame) == back + ahead + 1, F.avg(column).over(frame))


def reduce_noise(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), window: int = 5
) -> DataFrame:
    """Replace each column by its centred moving mean; null where the frame is not full."""
    ahead = (window - 1) // 2
    back = window - 1 - ahead
    return over_series(
        df, keys, order, back, ahead, lambda w: {c: _full_mean(c, w, back, ahead) for c in columns}
    )


def moving_averages(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds the short and long trailing means; null until the frame is full."""
    return over_series(
        df.where(F.col(value).isNotNull()), keys, order, LONG - 1, 0,
        lambda w: {"ma_short": _full_mean(value, w, SHORT - 1, 0), "ma_long": _full_mean(value, w, LONG - 1, 0)},
    )


def with_anomaly(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``anomaly``: more than three population deviations from the key's mean.

    Statistics are grouped and joined back, so no task holds a whole series.
    """
    known = df.where(F.col(value).isNotNull())
    stats = known.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_spread"))
    score = F.try_divide(F.abs(F.col(value) - F.col("_mean")), F.col("_spread"))
    flagged = join_on(known, stats, keys).withColumn("anomaly", F.coalesce(score > 3, F.lit(False)))
    return flagged.drop("_mean", "_spread")


def trend_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Trend of each key from its last 7 and 30 values; only those 30 rows per key are shuffled."""
    tail = top_n_per_key(
        df.where(F.col(value).isNotNull()).select(*keys, *order, value), keys, [F.desc(c) for c in order], LONG
    )
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    means = (
        tail.withColumn("_age", F.row_number().over(newest))
        .groupBy(*keys)
        .agg(
            F.count(value).alias("_seen"),
            F.avg(F.when(F.col("_age") <= SHORT, F.col(value))).alias("_short"),
            F.avg(value).alias("_long"),
        )
        .where(F.col("_seen") >= MIN_POINTS)
    )
    long = F.when(F.col("_seen") == LONG, F.col("_long"))
    labelled = means.select(*keys, F.col("_short").alias("ma_short"), long.alias("ma_long"))
    trend = (
        F.when(F.col("ma_short") > F.col("ma_long") * 1.05, "increasing")
        .when(F.col("ma_short") < F.col("ma_long") * 0.95, "decreasing")
        .otherwise("stable")
    )
    strength = F.when(F.col("ma_long") == 0, 0.0).otherwise(
        F.try_divide(F.abs(F.col("ma_short") - F.col("ma_long")), F.col("ma_long"))
    )
    return labelled.withColumn("trend", trend).withColumn("trend_strength", strength)


def trend_anomaly(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Trend and anomaly count of every key with at least ten values."""
    counts = with_anomaly(df, keys, value).groupBy(*keys).agg(F.count_if("anomaly").alias("anomaly_count"))
    joined = join_on(trend_labels(df, keys, order, value), counts, keys)
    return joined.withColumn("confidence", F.lit(TREND_CONFIDENCE))


def clamp_confidence(r2: Column) -> Column:
    """Confidence from a coefficient of determination; 0.5 when there is none."""
    return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), (r2 + 1) / 2)), F.lit(0.5))


def fit_confidence(df: DataFrame, keys: Sequence[str], actual: str, fitted: str) -> DataFrame:
    """Confidence of a fit per key, from one grouped pass."""
    both = df.where(F.col(actual).isNotNull() & F.col(fitted).isNotNull())
    error = F.sum(F.pow(F.col(actual) - F.col(fitted), 2))
    r2 = 1 - F.try_divide(error, F.var_pop(actual) * F.count(actual))
    return both.groupBy(*keys).agg(clamp_confidence(r2).alias("confidence"), F.count(actual).alias("points"))


def linear_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Least-squares line over the position of each key with at least ten values, and the deviation around it."""
    placed = with_position(df.where(F.col(value).isNotNull()).select(*keys, *order, value), keys, order)
    around = F.var_pop(value) * (1 - F.coalesce(F.regr_r2(value, "_pos"), F.lit(1.0)))
    return (
        placed.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.regr_slope(value, "_pos").alias("slope"),
            F.regr_intercept(value, "_pos").alias("intercept"),
            clamp_confidence(F.regr_r2(value, "_pos")).alias("confidence"),
            F.sqrt(F.greatest(around, F.lit(0.0))).alias("deviation"),
        )
        .where(F.col("points") >= MIN_POINTS)
    )


def forecast_linear(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, periods: int = 12
) -> DataFrame:
    """The next ``periods`` values of each key on its fitted line."""
    fits = linear_fit(df, keys, order, value)
    steps = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    at = F.col("points") + F.col("step") - 1
    return steps.select(
        *keys, "step", (F.col("intercept") + F.col("slope") * at).alias("forecast"), "confidence", "points"
    )
