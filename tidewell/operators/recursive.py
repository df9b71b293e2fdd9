"""Forecasts whose fit is a recursion over the series: ARIMA(1,1,1) and additive seasonal smoothing.

The recursions are in ``arima`` and ``smoothing``, the search for their parameters in ``descent``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.arima import Arima
from tidewell.operators.descent import fit_series
from tidewell.operators.keyed import join_on
from tidewell.operators.series import clamp_confidence, over_series, with_position
from tidewell.operators.smoothing import SEASON, Smoothing


def _series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    return with_position(known.select(*keys, *order, F.col(value).cast("double").alias("y")), keys, order)


def _spread(placed: DataFrame, keys: Sequence[str], skip: int, *extra) -> DataFrame:
    """Points and total variation after the first ``skip`` rows of each series."""
    fitted = F.when(F.col("_pos") >= skip, F.col("y"))
    return placed.groupBy(*keys).agg(
        F.count("y").alias("points"), (F.var_pop(fitted) * F.count(fitted)).alias("_total"), *extra
    )


def forecast_arima(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, periods: int = 12
) -> DataFrame:
    """ARIMA(1,1,1) forecasts, by exact likelihood, of every series with at least ten values."""
    placed = _series(df, keys, order, value)
    lagged = over_series(
        placed, keys, ["_pos"], 2, 0, lambda w: {"y1": F.lag("y", 1).over(w), "y2": F.lag("y", 2).over(w)}
    ).select(*keys, "_pos", "y", "y1", "y2")
    last = F.max_by(F.struct("y", "y1"), "_pos").alias("_last")
    joined = join_on(fit_series(lagged, keys, Arima()), _spread(lagged, keys, 1, last), keys)
    phi, theta, error = F.col("fit")[0], F.col("fit")[1], F.col("fit")[3]
    first = phi * (F.col("_last.y") - F.col("_last.y1")) + theta * error
    steps = joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    # The differences decay by phi from the first one on.
    path = F.col("_last.y") + first * (1 - F.pow(phi, F.col("step"))) / (1 - phi)
    return steps.select(
        *keys, "step", path.alias("forecast"), phi.alias("phi"), theta.alias("theta"),
        clamp_confidence(1 - F.try_divide(F.col("fit")[2], F.col("_total"))).alias("confidence"), "points",
    )


def forecast_seasonal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, periods: int = 12
) -> DataFrame:
    """Additive seasonal smoothing forecasts of every series with at least two seasons."""
    placed = _series(df, keys, order, value).select(*keys, "_pos", "y")
    joined = join_on(fit_series(placed, keys, Smoothing()), _spread(placed, keys, SEASON), keys)
    steps = joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    slot = (F.col("points") + F.col("step") - 1) % SEASON
    season = F.element_at("fit", (slot + 5).cast("int"))
    return steps.select(
        *keys, "step", (F.col("fit")[3] + season).alias("forecast"), F.col("fit")[0].alias("alpha"),
        F.col("fit")[1].alias("gamma"),
        clamp_confidence(1 - F.try_divide(F.col("fit")[2], F.col("_total"))).alias("confidence"), "points",
    )
