"""Learning from quality history and feedback: statistics, weights, adjustments and strategy choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import learned
from tidewell.operators.ranking import latest_per_key, one_row, top_n_per_key
from tidewell.operators.scope import semi
from tidewell.operators.series import over_positions, with_position

HISTORY_ROWS = 200
TREND_ROWS = 20
TREND_MIN = 6
FEATURE_BACK = 5
MODEL_MIN_SCORES = 8

# Starting weights of the methods of each cleaning family.
DEFAULT_WEIGHTS = {
    "missing_value_imputation": {"mean": 0.5, "median": 0.3, "ml": 0.2},
    "outlier_detection": {"iqr": 0.6, "zscore": 0.4},
    "normalization": {"min_max": 0.7, "z_score": 0.3},
}
# Weight of a named cleaning run before any feedback.
START_WEIGHT = 0.5

SCORE_ORDER = ("scored_at", "cleaned_data_id", "score", "algorithm")


def default_weights(spark: SparkSession) -> DataFrame:
    """The starting weights as a table; writing it again resets what was learned."""
    rows = [(family, method, w) for family, methods in DEFAULT_WEIGHTS.items() for method, w in methods.items()]
    return spark.createDataFrame(rows, "family string, method string, weight double")


def weight_state(defaults: DataFrame, performance: DataFrame) -> DataFrame:
    """All weights as (version, family, method, weight): version 0 before, version 1 after feedback."""
    base = defaults.select(F.lit(0).alias("version"), "family", "method", "weight")
    runs = performance.select(F.lit("cleaning_run").alias("family"), F.col("algorithm").alias("method"), "weight")
    start = runs.select(F.lit(0).alias("version"), "family", "method", F.lit(START_WEIGHT).alias("weight"))
    learned = runs.select(F.lit(1).alias("version"), "family", "method", "weight")
    return base.unionByName(base.withColumn("version", F.lit(1))).unionByName(start).unionByName(learned)


def _ordered_scores(scores: DataFrame, newest_first: bool, n: int) -> DataFrame:
    """(i, score, algorithm, all): the first n scores in time order; n bounds the single array."""
    order = [F.desc(c) if newest_first else F.asc(c) for c in SCORE_ORDER]
    top = scores.select(*SCORE_ORDER).orderBy(*order).limit(n)
    ordered = F.sort_array(F.collect_list(F.struct(*SCORE_ORDER)), asc=not newest_first)
    listed = top.agg(ordered.alias("all"))
    return listed.select("all", F.posexplode("all").alias("i", "s")).select(
        "i", F.col("s.score").alias("score"), F.col("s.algorithm").alias("algorithm"), F.col("all.score").alias("all")
    )


def quality_history(scores: DataFrame) -> DataFrame:
    """Mean, share of high scores, recent slope and size of the latest 200 scores."""
    listed = _ordered_scores(scores, True, HISTORY_ROWS)
    recent = F.when(F.col("i") < TREND_ROWS, F.col("score"))
    slope = F.when(F.count(F.lit(1)) >= TREND_MIN, F.regr_slope(recent, -F.col("i")))
    return listed.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_quality"),
        F.coalesce(F.avg((F.col("score") >= 0.90).cast("int")), F.lit(0.0)).alias("high_rate"),
        F.coalesce(slope, F.lit(0.0)).alias("trend_slope"),
        F.count(F.lit(1)).alias("history_size"),
    )


def quality_features(scores: DataFrame) -> DataFrame:
    """Rolling features of every score but the first three: place, mean and deviation of up to five before, target."""
    placed = with_position(scores.select(*SCORE_ORDER), (), SCORE_ORDER, "i")
    total = scores.count()

    def make(window) -> dict[str, Column]:
        before = window.rowsBetween(-FEATURE_BACK, -1)
        return {"mean5": F.avg("score").over(before), "std5": F.stddev_pop("score").over(before)}

    framed = over_positions(placed, (), "i", FEATURE_BACK, 0, make).where("i >= 3")
    return framed.select("i", "score", "algorithm", (F.col("i") / F.lit(max(total, 1))).alias("place"), "mean5", "std5")


# ---- feedback ---------------------------------------------------------------------------------------------


def parse_feedback(feedback: DataFrame, rating_key: str, scale: float = 1.0) -> DataFrame:
    """Adds ``rating`` (0.5 when absent) and ``issues`` (list length, 0 when absent) from the JSON payload."""
    rating = F.get_json_object("feedback_data", f"$.{rating_key}").try_cast("double") / scale
    issues = F.json_array_length(F.get_json_object("feedback_data", "$.issues"))
    return feedback.withColumns(
        {"rating": F.coalesce(rating, F.lit(0.5)), "issues": F.coalesce(issues, F.lit(0))}
    )


def feedback_with_cleaning(feedback: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Corrections with the algorithm and quality of the latest cleaned result of their dataset."""
    newest = latest_per_key(cleaned, ["raw_data_id"], "cleaned_at", "id").select(
        "raw_data_id", F.col("cleaning_algorithm").alias("algorithm"), "quality_score"
    )
    corrections = feedback.where(F.col("feedback_type") == "correction")
    return corrections.join(newest, F.col("data_id") == F.col("raw_data_id")).drop("raw_data_id")


def algorithm_performance(rated: DataFrame) -> DataFrame:
    """Mean performance and learned weight per algorithm.

    Adjustments are summed and clamped once, so the order of the feedback does not matter.
    """
    raw = F.col("rating") * (1 - F.col("issues") * 0.1)
    performance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    weight = START_WEIGHT + F.sum((performance - 0.5) * 0.1)
    return rated.groupBy("algorithm").agg(
        F.avg(performance).alias("performance"),
        F.count(F.lit(1)).alias("feedback"),
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), weight)).alias("weight"),
    )


def feedback_predictions(feedback: DataFrame, users: DataFrame, predictions: DataFrame) -> DataFrame:
    """Validations with the five latest predictions of their user's sector."""
    homes = users.where(F.col("sector_id").isNotNull()).select(F.col("id").alias("_u"), F.col("sector_id").alias("_s"))
    validations = feedback.where(F.col("feedback_type") == "validation").join(homes, F.col("user_id") == F.col("_u"))
    # Only sectors with feedback need their top rows.
    wanted = semi(predictions, "sector_id", validations.select("_s").distinct(), "_s")
    newest = top_n_per_key(wanted, ["sector_id"], [F.desc("predicted_at"), F.desc("id")], 5).select(
        "sector_id", F.col("id").alias("prediction_id"), "prediction_type", "confidence"
    )
    return validations.join(newest, F.col("_s") == F.col("sector_id")).drop("_u", "_s")


def _adjustment() -> Column:
    return (F.col("rating") - F.col("confidence")) * 0.05


def adjusted_confidence(pairs: DataFrame, base: float) -> DataFrame:
    """Base confidence per prediction type, shifted by the mean of its last ten adjustments."""
    order = [F.desc("feedback_at"), F.desc("id"), F.desc("prediction_id")]
    last = top_n_per_key(pairs, ["prediction_type"], order, 10)
    shifted = F.avg(_adjustment()) + base
    return last.groupBy("prediction_type").agg(
        F.avg(_adjustment()).alias("adjustment"),
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), shifted)).alias("adjusted_confidence"),
        F.count(F.lit(1)).alias("used"),
    )


def learning_report(performance: DataFrame, pairs: DataFrame) -> DataFrame:
    """Learned weights and the number of adjustments per prediction type."""
    weights = performance.select(F.lit("weight").alias("kind"), F.col("algorithm").alias("name"), F.col("weight").alias("value"))
    counts = pairs.groupBy("prediction_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return weights.unionByName(counts.select(F.lit("adjustments").alias("kind"), F.col("prediction_type").alias("name"), "value"))


def process_feedback(
    feedback: DataFrame, cleaned: DataFrame, users: DataFrame, predictions: DataFrame, as_of: str, days: int = 30
) -> DataFrame:
    """Recent feedback turned into algorithm and prediction updates, as (kind, name, feedback, value) rows."""
    since = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(days)} DAYS")
    recent = feedback.where(F.col("feedback_at") >= since)
    algorithms = algorithm_performance(feedback_with_cleaning(recent, cleaned)).select(
        F.lit("algorithm").alias("kind"), F.col("algorithm").alias("name"), "feedback", F.col("performance").alias("value")
    )
    updates = feedback_predictions(recent, users, predictions).groupBy("prediction_type").agg(
        F.count(F.lit(1)).alias("feedback"), F.avg(_adjustment()).alias("value")
    )
    return algorithms.unionByName(
        updates.select(F.lit("prediction").alias("kind"), F.col("prediction_type").alias("name"), "feedback", "value")
    )


# ---- strategy ---------------------------------------------------------------------------------------------


def _base_choice(weights: Mapping[str, Mapping[str, float]]) -> tuple[Column, Column]:
    """Imputation and outlier method from ``skewness`` and ``distribution``."""
    fill, out = weights["missing_value_imputation"], weights["outlier_detection"]
    skew = F.abs("skewness")
    impute = (
        F.when(skew > 1, "median" if fill["median"] > 0.4 else "ml")
        .when(skew < 0.5, "mean" if fill["mean"] > 0.4 else "ml")
        .otherwise("ml" if fill["ml"] > 0.3 else "mean")
    )
    outlier = F.when(F.col("distribution") == "normal", "zscore" if out["zscore"] > 0.4 else "iqr").otherwise(
        "iqr" if out["iqr"] > 0.5 else "zscore"
    )
    return impute, outlier


def strategy_per_key(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Mapping[str, float]] = DEFAULT_WEIGHTS,
) -> DataFrame:
    """The same choice for many datasets at once, one row per key, from one grouped pass."""
    n = F.count(value)
    scale = F.sqrt(n * (n - 1).cast("double")) / (n - 2)
    skew = F.when(n >= 3, F.when(F.stddev_pop(value) == 0, 0.0).otherwise(F.skewness(value) * scale))
    shapes = df.groupBy(*keys).agg(skew.alias("skewness"), F.count(F.lit(1)).alias("n")).withColumn(
        "distribution", F.when(F.abs("skewness") < 0.8, "normal").otherwise("skewed")
    )
    impute, outlier = _base_choice(weights)
    return shapes.select(
        *keys, "skewness", "distribution", impute.alias("impute_strategy"), outlier.alias("outlier_method"),
        (F.col("n") > 80).alias("reduce_noise"),
    )


def cleaning_strategy(
    characteristics: DataFrame, history: DataFrame, weights: Mapping[str, Mapping[str, float]] = DEFAULT_WEIGHTS
) -> DataFrame:
    """Cleaning settings from the shape of the data, overridden by the quality history."""
    impute, outlier = _base_choice(weights)
    both = one_row(characteristics, history)
    good = (F.col("avg_quality") >= 0.90) | (F.col("high_rate") >= 0.60)
    poor = ~good & (F.col("avg_quality") < 0.75) & (F.col("history_size") > 0)
    sinking = ~good & ~poor & (F.col("trend_slope") < -0.01)
    return both.select(
        F.when(good | sinking, "ml").when(poor, "median").otherwise(impute).alias("impute_strategy"),
        F.when(good | sinking, "zscore").when(poor, "iqr").otherwise(outlier).alias("outlier_method"),
        F.when(good, False).otherwise(F.col("needs_normalization")).alias("normalize"),
        F.when(good, True).otherwise(F.col("needs_standardization")).alias("standardize"),
        F.col("has_noise").alias("reduce_noise"),
        F.when(sinking, True).otherwise(F.col("has_text")).alias("clean_text"),
    )


# The three settings a trained quality model chooses between.
CANDIDATES = (
    {"impute_strategy": "mean", "outlier_method": "iqr", "normalize": True, "standardize": False},
    {"impute_strategy": "median", "outlier_method": "iqr", "normalize": True, "standardize": False},
    {"impute_strategy": "ml", "outlier_method": "zscore", "normalize": False, "standardize": True},
)
FEATURES = ["place", "mean5", "std5", "is_second", "is_third"]
# Inputs that later scores do not change, so that learning can go on; ``place`` depends on the size of the history.
NET_INPUTS = ("mean5", "std5", "is_second", "is_third")
NET_NAME = "quality"


def _with_candidate(features: DataFrame, algorithms: tuple[str, ...]) -> DataFrame:
    """One-hot columns of the candidate an algorithm stands for."""
    return features.withColumns({
        "is_second": (F.col("algorithm") == algorithms[1]).cast("double"),
        "is_third": (F.col("algorithm") == algorithms[2]).cast("double"),
    })


def train_quality_model(features: DataFrame, algorithms: tuple[str, ...]) -> LinearRegressionModel | None:
    """Linear model of the next score; None with too little history."""
    rows = _with_candidate(features, algorithms)
    if rows.count() + 3 < MODEL_MIN_SCORES:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    return LinearRegression(featuresCol="x", labelCol="score", solver="normal").fit(assembled)


def continue_quality_net(
    features: DataFrame, algorithms: tuple[str, ...], store=None, close: bool = False
) -> learned.NetState | None:
    """The network's state after all scores that it has not seen; with a ``store`` it goes on from the newest version.

    A state that has learned something new is stored as the next version. None with too little history.
    """
    state = learned.load_state(store, NET_NAME) if store is not None else None
    if state is None:
        if features.limit(MODEL_MIN_SCORES - 3).count() + 3 < MODEL_MIN_SCORES:
            return None
        state = learned.new_state(NET_INPUTS)
    after = learned.learn(_with_candidate(features, algorithms), state, "score", "i", close)
    if store is not None and after.version > state.version:
        learned.save_state(store, NET_NAME, after)
    return after


def predicted_quality(
    features: DataFrame, algorithms: tuple[str, ...], model: LinearRegressionModel | learned.NetState
) -> DataFrame:
    """Adds the ``prediction`` of the linear model or the network."""
    if isinstance(model, learned.NetState):
        return learned.predict(_with_candidate(features, algorithms), model).drop("is_second", "is_third")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(_with_candidate(features, algorithms))
    return model.transform(rows).drop("x", "is_second", "is_third")


def rank_candidates(
    features: DataFrame, algorithms: tuple[str, ...], model: LinearRegressionModel | learned.NetState | None
) -> DataFrame:
    """Predicted quality and uncertainty of each candidate at the newest state of the history.

    Without a model the starting weights of a candidate's methods stand in for its quality, with no uncertainty.
    """
    if model is None:
        rows = []
        for i, settings in enumerate(CANDIDATES):
            impute = DEFAULT_WEIGHTS["missing_value_imputation"][settings["impute_strategy"]]
            outlier = DEFAULT_WEIGHTS["outlier_detection"][settings["outlier_method"]]
            rows.append((i, *settings.values(), (impute + outlier) / 2, 0.0))
        names = "candidate int, impute_strategy string, outlier_method string, normalize boolean, standardize boolean"
        return features.sparkSession.createDataFrame(rows, f"{names}, predicted_quality double, uncertainty double")
    state = features.agg(
        F.max_by("mean5", "i").alias("mean5"), F.max_by("std5", "i").alias("std5"), F.avg("score").alias("past")
    )
    options = F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.lit(a).alias("algorithm"), *[F.lit(v).alias(k) for k, v in c.items()])
        for i, (a, c) in enumerate(zip(algorithms, CANDIDATES))
    ])
    rows = state.select("*", F.lit(1.0).alias("place"), F.inline(options))
    scored = predicted_quality(rows, algorithms, model)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    return scored.select(
        "candidate", *CANDIDATES[0], clamped.alias("predicted_quality"),
        F.abs(F.col("prediction") - F.col("past")).alias("uncertainty"),
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Highest predicted quality, ties to the more uncertain, then to the first candidate."""
    place = F.struct("predicted_quality", "uncertainty", -F.col("candidate"))
    whole = F.struct(*candidates.columns)
    return candidates.agg(F.max_by(whole, place).alias("best")).select("best.*")
