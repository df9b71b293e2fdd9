"""Sector ranking, recommendation rules and the risk model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import forest
from tidewell.operators.series import clamp_confidence
from tidewell.session import materialise

RISK_MIN_ROWS = 10


def rank_sectors(rows: DataFrame, sector: str, metrics: Sequence[str], sectors: DataFrame, on: str) -> DataFrame:
    """Score per sector: the mean over the metrics of (mean - min) / (max - min), best first.

    Rows combine per ``on`` key first, so the join to the sector names sees one row per key.
    """
    parts = rows.groupBy(on).agg(*[
        f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("s", F.sum), ("n", F.count), ("lo", F.min), ("hi", F.max))
    ])
    sums = parts.join(sectors, on).groupBy(sector).agg(*[
        f(f"{name}_{m}").alias(f"{name}_{m}") for m in metrics for name, f in (("s", F.sum), ("n", F.sum), ("lo", F.min), ("hi", F.max))
    ])

    def score(m: str) -> Column:
        spread = F.col(f"hi_{m}") - F.col(f"lo_{m}")
        mean = F.col(f"s_{m}") / F.col(f"n_{m}")
        return F.when(F.col(f"n_{m}") > 0, F.when(spread == 0, 0.5).otherwise((mean - F.col(f"lo_{m}")) / spread))

    scored = sums.select(sector, *[score(m).alias(m) for m in metrics])
    total = F.lit(0.0)
    for m in metrics:
        total = total + F.coalesce(F.col(m), F.lit(0.0))
    return scored.withColumn("score", total / len(metrics)).orderBy(F.desc("score"), sector)


def with_top_performer(ranking: DataFrame, sector: str) -> DataFrame:
    """Marks the best sector, ties to the first name."""
    best = ranking.agg(F.min_by(sector, F.struct(-F.col("score"), F.col(sector))).alias("_best"))
    marked = ranking.join(best, F.col(sector) == F.col("_best"), "left")
    return marked.withColumn("top_performer", F.col("_best").isNotNull()).drop("_best")


def ranking_insights(ranking: DataFrame, sector: str, metrics: Sequence[str]) -> DataFrame:
    """Sentences on the leader, the last and each outstanding metric; none for a single sector."""
    ranking = materialise(ranking)  # one row per sector, read three times
    if ranking.count() < 2:
        return ranking.limit(0).select(F.col(sector).alias("insight"))
    name = F.col(sector)
    place = F.struct(-F.col("score"), name)
    ends = ranking.agg(F.min_by(sector, place).alias("top"), F.max_by(sector, place).alias("bottom"))
    overall = ends.select(F.explode(F.array(
        F.concat("top", F.lit(" leads in overall performance")),
        F.concat("bottom", F.lit(" shows potential for improvement")),
    )).alias("insight"))
    notes = [
        F.when(F.col(m) > 0.8, F.concat(name, F.lit(f" excels in {m}"))).when(
            F.col(m) < 0.3, F.concat(name, F.lit(f" needs improvement in {m}"))
        )
        for m in metrics
    ]
    return overall.unionByName(ranking.select(F.explode(F.array_compact(F.array(*notes))).alias("insight")))


# Advice and reason of each rule.
ADVICE = {
    "growth": (
        "Increase production capacity - strong sales growth expected",
        "Forecast shows 10%+ growth above current average",
    ),
    "decline": (
        "Implement cost reduction measures - sales decline expected",
        "Forecast indicates potential sales decline",
    ),
    "rising": (
        "Scale up marketing efforts to capitalize on growth trend",
        "Positive trend detected in key metrics",
    ),
    "falling": (
        "Conduct market analysis to identify decline causes",
        "Negative trend detected requiring immediate attention",
    ),
    "high risk": ("Implement risk mitigation strategies immediately", "High risk score of {} detected"),
    "some risk": ("Monitor risk indicators closely", "Moderate risk level of {}"),
    "anomalies": ("Investigate data anomalies for potential issues", "{} anomalies detected in recent data"),
}


def _advice(rule: str, holds: Column, figure: Column | None = None) -> Column:
    """The advice when the rule holds, with the figure put into its reason."""
    text, reason = ADVICE[rule]
    shown = F.lit(reason)
    if figure is not None:
        head, tail = reason.split("{}")
        shown = F.concat(F.lit(head), figure, F.lit(tail))
    return F.when(holds, F.struct(F.lit(text).alias("recommendation"), shown.alias("explanation")))


def recommendations(predictions: DataFrame) -> DataFrame:
    """Adds ``advice`` (texts with reasons) and ``priority``.

    Reads forecast_avg, current_average, trend, predicted_risk and anomaly_count; null fields give no advice.
    """
    now, ahead, risk, odd = (F.col(c) for c in ("current_average", "forecast_avg", "predicted_risk", "anomaly_count"))
    # Halves are decided on the double, as SQL's round does; F.round would decide them on its decimal digits.
    shown = F.format_string("%.2f", F.floor(risk * 100 + 0.5) / 100)
    rules = [
        _advice("growth", ahead > now * 1.1),
        _advice("decline", ahead < now * 0.9),
        _advice("rising", F.col("trend") == "increasing"),
        _advice("falling", F.col("trend") == "decreasing"),
        _advice("high risk", risk > 0.7, shown),
        _advice("some risk", (risk > 0.4) & (risk <= 0.7), shown),
        _advice("anomalies", odd > 0, odd.cast("string")),
    ]
    advised = predictions.withColumn("advice", F.array_compact(F.array(*rules)))
    return advised.withColumn("priority", F.when(F.size("advice") > 2, "high").otherwise("medium"))


def recommendation_rows(advised: DataFrame, key: str) -> DataFrame:
    """One row per recommendation, text beside its explanation."""
    return advised.select(key, F.posexplode("advice").alias("place", "a")).select(
        key, "place", F.col("a.recommendation").alias("recommendation_text"), F.col("a.explanation").alias("explanation")
    )


def train_share(df: DataFrame, key: Sequence[str], percent: int = 80) -> DataFrame:
    """Adds ``is_train`` from a hash of the key: stable under any partitioning."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(*key), F.lit(100)) < percent)


def predict_risk(
    df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], trees: int = 100
) -> DataFrame:
    """Random-forest risk: mean prediction, fit and confidence on the held-out fifth, feature importance.

    One row per feature; empty when too few rows have all features.
    """
    names = [f"_x{i}" for i in range(len(features))]
    rows = train_share(df.na.drop(subset=[*features, target]), key).select(
        "is_train", F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, names)]
    )
    cuts = forest.thresholds(rows.where("is_train"), names)
    # A model sees bins only, so its work grows with the kinds of rows, not with the rows.
    counted = materialise(forest.binned_counts(rows, names, cuts, ["is_train", "y"]))
    if (counted.agg(F.sum("n")).first()[0] or 0) < RISK_MIN_ROWS:
        empty = "feature string, importance double, predicted_risk double, test_score double, confidence double"
        return df.sparkSession.createDataFrame([], empty)
    model = forest.fit(counted.where("is_train"), len(features), trees, seed=42)
    n, y = F.col("n"), F.col("y")
    held_out = counted.where("NOT is_train")
    middle = held_out.agg((F.sum(n * y) / F.sum(n)).alias("middle"))
    tested = forest.predict(held_out, model).join(middle)
    error = F.sum(n * F.pow(y - F.col("prediction"), 2))
    spread = F.when(F.min("y") < F.max("y"), F.sum(n * F.pow(y - F.col("middle"), 2)))
    r2 = 1 - F.try_divide(error, spread)
    weights = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(model.importance[i]).alias("importance"))
        for i, f in enumerate(features)
    ])
    risk = F.sum(n * F.col("prediction")) / F.sum(n)
    result = tested.agg(risk.alias("predicted_risk"), r2.alias("test_score"), clamp_confidence(r2).alias("confidence"))
    return result.select(F.inline(weights), "predicted_risk", "test_score", "confidence")
