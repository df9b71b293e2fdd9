"""One-shot analysis of many series at once: quality, trend, forecast and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import predict, series
from tidewell.operators.keyed import join_on
from tidewell.plans import cleaning

TREND_ROWS, FORECAST_ROWS = 10, 20


# Fixed value: the slope at which a logistic curve follows the normal distribution.
NORMAL_SLOPE = 1.702


def analyse_upload(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    config: cleaning.CleaningConfig,
    algorithm: str = "full_pipeline",
    periods: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """Clean an uploaded table and analyse the result: (``analyse`` of the cleaned series, log of the cleaning)."""
    cleaned, log = cleaning.clean_with_log(df, algorithm, config)
    return analyse(cleaned, keys, order, value, periods), log


def analyse(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, periods: int = 12) -> DataFrame:
    """Per key: completeness, trend (more than 10 rows), forecast mean and risk (more than 20) and advice.

    The risk is the chance that the mean of the next periods lies below the present average, by the spread of the values
    around their line.
    """
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(value) / F.count(F.lit(1))).alias("completeness"),
        F.avg(value).alias("current_average"),
    )
    trends = series.trend_anomaly(df, keys, order, value)
    lines = series.linear_fit(df, keys, order, value)
    # The mean of an arithmetic run is the line at its middle.
    middle = F.col("points") + (periods - 1) / 2
    ahead = lines.select(
        *keys, (F.col("intercept") + F.col("slope") * middle).alias("_ahead"), F.col("confidence").alias("_sure"),
        F.col("deviation").alias("_off"),
    )
    joined = join_on(join_on(sizes, trends, keys, "left"), ahead, keys, "left")
    fall = F.col("current_average") - F.col("_ahead")
    risk = F.when(F.col("_off") > 0, 1 / (1 + F.exp(-NORMAL_SLOPE * fall / F.col("_off")))).otherwise((fall > 0).cast("double"))
    enough = F.col("rows") > FORECAST_ROWS
    ready = joined.withColumns({
        "forecast_avg": F.when(enough, F.col("_ahead")),
        "forecast_confidence": F.when(enough, F.col("_sure")),
        "predicted_risk": F.when(enough, risk),
        **{c: F.when(F.col("rows") > TREND_ROWS, F.col(c)) for c in ("trend", "trend_strength", "anomaly_count")},
    })
    advised = predict.recommendations(ready)
    return advised.select(
        *keys, "rows", "completeness", "current_average", "trend", "trend_strength", "anomaly_count",
        "forecast_avg", "forecast_confidence", "predicted_risk", F.size("advice").cast("bigint").alias("advices"), "priority",
    )
