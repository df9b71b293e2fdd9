"""Registered queries: series, forecasts, rankings, history and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import history, predict, profile, recursive, series
from tidewell.session import materialise, new_path
from tidewell.sources.store import DatasetStore
from tidewell.workloads.metadata import AS_OF
from tidewell.workloads.registry import query

KEY, ORDER = ["user_id"], ["ts", "event_id"]
RUNS = ("N", "R", "A")  # score algorithms standing for the three candidate settings


def events(data):
    return data.table("events").select("user_id", "ts", "event_id", "value")


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


# ---- series -----------------------------------------------------------------------------------------------

W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "noise_reduction",
    f"""SELECT user_id, ts, event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS value FROM events
    WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def _(data):
    return rounded(series.reduce_noise(events(data), ["value"], ORDER, KEY), "value")


@query(
    "moving_averages",
    f"""SELECT user_id, ts, event_id, value, CASE WHEN count(*) OVER s = 7 THEN round(avg(value) OVER s, 6) END AS ma_short,
    CASE WHEN count(*) OVER l = 30 THEN round(avg(value) OVER l, 6) END AS ma_long FROM events
    WINDOW s AS ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), l AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def _(data):
    return rounded(series.moving_averages(events(data), KEY, ORDER, "value"), "ma_short", "ma_long")


ANOMALY = """s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM events GROUP BY 1),
    f AS (SELECT e.user_id, e.ts, e.event_id, e.value, coalesce(abs(value - m) / nullif(d, 0) > 3, false) AS anomaly
        FROM events e JOIN s ON e.user_id = s.user_id)"""


@query("anomaly_flags", f"WITH {ANOMALY} SELECT * FROM f")
def _(data):
    return series.with_anomaly(events(data), KEY, "value")


TREND = """t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events),
    a AS (SELECT user_id, avg(value) FILTER (age <= 7) AS ma_short, CASE WHEN count(*) >= 30 THEN avg(value) FILTER (age <= 30) END
        AS ma_long FROM t GROUP BY 1 HAVING count(*) >= 10),
    l AS (SELECT *, CASE WHEN ma_short > ma_long * 1.05 THEN 'increasing' WHEN ma_short < ma_long * 0.95 THEN 'decreasing'
        ELSE 'stable' END AS trend, CASE WHEN ma_long = 0 THEN 0.0 ELSE abs(ma_short - ma_long) / ma_long END AS trend_strength FROM a)"""


@query(
    "trend_label",
    f"""WITH {TREND} SELECT user_id, trend, round(ma_short, 6) AS ma_short, round(ma_long, 6) AS ma_long,
    round(trend_strength, 6) AS trend_strength FROM l""",
)
def _(data):
    labels = series.trend_labels(events(data), KEY, ORDER, "value")
    return rounded(labels, "ma_short", "ma_long", "trend_strength")


@query(
    "trend_anomaly",
    f"""WITH {TREND}, {ANOMALY}, c AS (SELECT user_id, count(*) FILTER (anomaly) AS anomaly_count FROM f GROUP BY 1)
    SELECT l.user_id, trend, round(ma_short, 6) AS ma_short, round(ma_long, 6) AS ma_long,
    round(trend_strength, 6) AS trend_strength, anomaly_count, CAST(0.8 AS DOUBLE) AS confidence FROM l JOIN c ON l.user_id = c.user_id""",
)
def _(data):
    return rounded(series.trend_anomaly(events(data), KEY, ORDER, "value"), "ma_short", "ma_long", "trend_strength")


FIT = f"""p AS (SELECT user_id, value, row_number() OVER ({W}) - 1 AS pos FROM events),
    fit AS (SELECT user_id, count(*) AS points, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept,
        greatest(0.1, least(1.0, (regr_r2(value, pos) + 1) / 2)) AS confidence, avg(value) AS now FROM p GROUP BY 1 HAVING count(*) >= 10)"""


@query(
    "forecast_linear",
    f"""WITH {FIT}, st AS (SELECT CAST(unnest(range(1, 13)) AS INT) AS step) SELECT user_id, step,
    round(intercept + slope * (points + step - 1), 5) AS forecast, round(confidence, 6) AS confidence, points FROM fit, st""",
)
def _(data):
    return rounded(rounded(series.forecast_linear(events(data), KEY, ORDER, "value"), "forecast", places=5), "confidence")


@query("fit_confidence", f"WITH {FIT} SELECT user_id, round(confidence, 6) AS confidence, points FROM fit")
def _(data):
    placed = series.with_position(events(data), KEY, ORDER)
    fits = series.linear_fit(events(data), KEY, ORDER, "value").select("user_id", "slope", "intercept")
    fitted = placed.join(fits, "user_id").withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("_pos"))
    return rounded(series.fit_confidence(fitted, KEY, "value", "fitted"), "confidence")


@query("forecast_arima")
def _(data):
    return recursive.forecast_arima(events(data), KEY, ORDER, "value")


@query("forecast_ses")
def _(data):
    return recursive.forecast_seasonal(events(data), KEY, ORDER, "value")


# ---- ranking, recommendations, risk -----------------------------------------------------------------------

METRICS = ("l_quantity", "l_extendedprice", "l_discount")
RANKING = f"""sc AS (SELECT n_name AS sector, {', '.join(
    f'CASE WHEN max({m}) = min({m}) THEN 0.5 ELSE (avg({m}) - min({m})) / (max({m}) - min({m})) END AS {m}' for m in METRICS)}
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    rk AS (SELECT *, (l_quantity + l_extendedprice + l_discount) / 3 AS score FROM sc)"""


def ranking(data):
    names = data.table("supplier").join(data.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sectors = names.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("sector"))
    return predict.rank_sectors(data.table("lineitem"), "sector", METRICS, sectors, "l_suppkey")


@query(
    "rank_sectors",
    f"""WITH {RANKING} SELECT sector, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, round(score, 6) AS score,
    row_number() OVER (ORDER BY score DESC, sector) = 1 AS top_performer FROM rk""",
)
def _(data):
    return rounded(predict.with_top_performer(ranking(data), "sector"), *METRICS, "score")


@query(
    "ranking_insights",
    f"""WITH {RANKING}, o AS (SELECT sector, row_number() OVER (ORDER BY score DESC, sector) AS up,
    row_number() OVER (ORDER BY score, sector DESC) AS down FROM rk)
    SELECT concat(sector, ' leads in overall performance') AS insight FROM o WHERE up = 1
    UNION ALL SELECT concat(sector, ' shows potential for improvement') FROM o WHERE down = 1 """
    + " ".join(
        f"""UNION ALL SELECT concat(sector, CASE WHEN {m} > 0.8 THEN ' excels in {m}' ELSE ' needs improvement in {m}' END)
        FROM rk WHERE {m} > 0.8 OR {m} < 0.3""" for m in METRICS
    ),
)
def _(data):
    return predict.ranking_insights(ranking(data), "sector", METRICS)


ADVICE = f"""{FIT}, {TREND}, {ANOMALY}, c AS (SELECT user_id, count(*) FILTER (anomaly) AS n FROM f GROUP BY 1),
    k AS (SELECT user_id, count(*) FILTER (event_type = 'error') * 2.0 / count(*) AS risk FROM events GROUP BY 1),
    j AS (SELECT fit.user_id, intercept + slope * (points + 5.5) AS ahead, now, trend, risk, c.n AS anomalies
        FROM fit JOIN l ON l.user_id = fit.user_id JOIN c ON c.user_id = fit.user_id JOIN k ON k.user_id = fit.user_id),
    ad AS (SELECT user_id, list_filter([
        CASE WHEN ahead > now * 1.1 THEN ['Increase production capacity - strong sales growth expected',
            'Forecast shows 10%+ growth above current average'] END,
        CASE WHEN ahead < now * 0.9 THEN ['Implement cost reduction measures - sales decline expected',
            'Forecast indicates potential sales decline'] END,
        CASE trend WHEN 'increasing' THEN ['Scale up marketing efforts to capitalize on growth trend',
            'Positive trend detected in key metrics'] WHEN 'decreasing' THEN
            ['Conduct market analysis to identify decline causes', 'Negative trend detected requiring immediate attention'] END,
        CASE WHEN risk > 0.7 THEN ['Implement risk mitigation strategies immediately',
            concat('High risk score of ', printf('%.2f', round(risk, 2)), ' detected')]
            WHEN risk > 0.4 THEN ['Monitor risk indicators closely', concat('Moderate risk level of ', printf('%.2f', round(risk, 2)))] END,
        CASE WHEN anomalies > 0 THEN ['Investigate data anomalies for potential issues',
            concat(CAST(anomalies AS VARCHAR), ' anomalies detected in recent data')] END], lambda x: x IS NOT NULL) AS advice FROM j)"""


def advised(data):
    df = events(data)
    ahead = series.forecast_linear(df, KEY, ORDER, "value").groupBy("user_id").agg(F.avg("forecast").alias("forecast_avg"))
    counts = data.table("events").groupBy("user_id").agg(
        F.avg("value").alias("current_average"),
        (F.count_if(F.col("event_type") == "error") * 2.0 / F.count("*")).alias("predicted_risk"),
    )
    trends = series.trend_anomaly(df, KEY, ORDER, "value").select("user_id", "trend", "anomaly_count")
    return predict.recommendations(ahead.join(counts, "user_id").join(trends, "user_id"))


@query(
    "recommendation_rules",
    f"WITH {ADVICE} SELECT user_id, len(advice) AS advices, CASE WHEN len(advice) > 2 THEN 'high' ELSE 'medium' END AS priority FROM ad",
)
def _(data):
    return advised(data).select("user_id", F.size("advice").cast("bigint").alias("advices"), "priority")


@query(
    "recommendations_exploded",
    f"""WITH {ADVICE}, x AS (SELECT user_id, unnest(range(0, len(advice))) AS place, advice FROM ad)
    SELECT user_id, CAST(place AS INT) AS place, advice[place + 1][1] AS recommendation_text, advice[place + 1][2] AS explanation FROM x""",
)
def _(data):
    return predict.recommendation_rows(advised(data), "user_id")


@query("risk_forest")
def _(data):
    lines = data.table("lineitem").withColumn("risk", (F.col("l_returnflag") == "R").cast("double"))
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return predict.predict_risk(lines, features, "risk", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# ---- history and feedback ---------------------------------------------------------------------------------

HISTORY = """h AS (SELECT score, row_number() OVER (ORDER BY scored_at DESC, cleaned_data_id DESC, score DESC, algorithm DESC) AS r
        FROM data_quality_scores),
    hs AS (SELECT avg(score) AS avg_quality, avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END) AS high_rate,
        coalesce(regr_slope(score, -r) FILTER (r <= 20), 0.0) AS trend_slope, count(*) AS history_size FROM h WHERE r <= 200)"""


@query(
    "quality_history_stats",
    f"""WITH {HISTORY} SELECT round(avg_quality, 6) AS avg_quality, round(high_rate, 6) AS high_rate,
    round(trend_slope, 6) AS trend_slope, history_size FROM hs""",
)
def _(data):
    return rounded(history.quality_history(data.data_quality_scores), "avg_quality", "high_rate", "trend_slope")


@query(
    "quality_features",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY scored_at, cleaned_data_id, score, algorithm) - 1 AS i FROM data_quality_scores),
    f AS (SELECT i, score, algorithm, i * 1.0 / count(*) OVER () AS place, avg(score) OVER w AS mean5, stddev_pop(score) OVER w AS std5
        FROM o WINDOW w AS (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT i, score, algorithm, CAST(round(place, 6) AS DOUBLE) AS place, round(mean5, 6) AS mean5,
    round(std5, 6) AS std5 FROM f WHERE i >= 3""",
)
def _(data):
    return rounded(history.quality_features(data.data_quality_scores), "place", "mean5", "std5")


@query("quality_model")
def _(data):
    features = materialise(history.quality_features(data.data_quality_scores))  # read by the fit and by the predictions
    return history.predicted_quality(features, RUNS, history.train_quality_model(features, RUNS))


def quality_net(data):
    """Learned from the finished batches and stored, then taken up again for the rest."""
    features = materialise(history.quality_features(data.data_quality_scores))
    store = DatasetStore(data.spark, new_path(data.spark, "models"))
    history.continue_quality_net(features, RUNS, store)
    return features, history.continue_quality_net(features, RUNS, store, close=True)


@query("quality_net")
def _(data):
    features, state = quality_net(data)
    return history.predicted_quality(features, RUNS, state).withColumn("version", F.lit(state.version))


@query("best_candidate_net")
def _(data):
    features, state = quality_net(data)
    return history.best_candidate(history.rank_candidates(features, RUNS, state))


@query("best_candidate")
def _(data):
    features = materialise(history.quality_features(data.data_quality_scores))
    ranked = history.rank_candidates(features, RUNS, history.train_quality_model(features, RUNS))
    return history.best_candidate(ranked)


def rated(data):
    return history.parse_feedback(data.feedback_logs, "k", 100.0)


RATED = """rt AS (SELECT *, CAST(json_extract_string(feedback_data, '$.k') AS DOUBLE) / 100.0 AS rating, 0 AS issues FROM feedback_logs),
    fc AS (SELECT rt.*, c.cleaning_algorithm AS algorithm, c.quality_score FROM rt JOIN (SELECT * FROM cleaned_data QUALIFY
        row_number() OVER (PARTITION BY raw_data_id ORDER BY cleaned_at DESC, id DESC) = 1) c ON rt.data_id = c.raw_data_id
        WHERE feedback_type = 'correction'),
    tp AS (SELECT * FROM ai_predictions QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY predicted_at DESC, id DESC) <= 5),
    fp AS (SELECT rt.*, tp.id AS prediction_id, tp.sector_id, tp.prediction_type, tp.confidence FROM rt JOIN users u ON rt.user_id = u.id
        JOIN tp ON tp.sector_id = u.sector_id WHERE feedback_type = 'validation'),
    ap AS (SELECT algorithm, avg(greatest(0, least(1, rating * (1 - issues * 0.1)))) AS performance, count(*) AS feedback,
        greatest(0.1, least(1.0, 0.5 + sum((greatest(0, least(1, rating * (1 - issues * 0.1))) - 0.5) * 0.1))) AS weight FROM fc GROUP BY 1)"""


@query("feedback_with_cleaning", f"WITH {RATED} SELECT * FROM fc")
def _(data):
    return history.feedback_with_cleaning(rated(data), data.cleaned_data)


@query("feedback_top5_predictions", f"WITH {RATED} SELECT * FROM fp")
def _(data):
    return history.feedback_predictions(rated(data), data.users, data.ai_predictions)


def performance(data):
    return history.algorithm_performance(history.feedback_with_cleaning(rated(data), data.cleaned_data))


@query(
    "algorithm_performance",
    f"WITH {RATED} SELECT algorithm, round(performance, 6) AS performance, feedback, round(weight, 6) AS weight FROM ap",
)
def _(data):
    return rounded(performance(data), "performance", "weight")


def pairs(data):
    return history.feedback_predictions(rated(data), data.users, data.ai_predictions)


_DEFAULTS = ", ".join(
    f"('{family}', '{method}', {w})" for family, methods in history.DEFAULT_WEIGHTS.items() for method, w in methods.items()
)


@query(
    "weight_state",
    f"""WITH {RATED}, v(version) AS (VALUES (0), (1)), b(family, method, weight) AS (VALUES {_DEFAULTS})
    SELECT CAST(version AS INT) AS version, family, method, CAST(weight AS DOUBLE) AS weight FROM b, v
    UNION ALL SELECT 0, 'cleaning_run', algorithm, 0.5 FROM ap
    UNION ALL SELECT 1, 'cleaning_run', algorithm, round(weight, 6) FROM ap""",
)
def _(data):
    return rounded(history.weight_state(history.default_weights(data.spark), performance(data)), "weight")


@query(
    "adjusted_confidence",
    f"""WITH {RATED}, la AS (SELECT prediction_type, (rating - confidence) * 0.05 AS a FROM fp QUALIFY row_number() OVER (
        PARTITION BY prediction_type ORDER BY feedback_at DESC, id DESC, prediction_id DESC) <= 10)
    SELECT prediction_type, round(avg(a), 6) AS adjustment, round(greatest(0.1, least(1.0, avg(a) + 0.8)), 6) AS adjusted_confidence,
    count(*) AS used FROM la GROUP BY 1""",
)
def _(data):
    return rounded(history.adjusted_confidence(pairs(data), 0.8), "adjustment", "adjusted_confidence")


@query(
    "learning_report",
    f"""WITH {RATED} SELECT 'weight' AS kind, algorithm AS name, round(weight, 6) AS value FROM ap
    UNION ALL SELECT 'adjustments', prediction_type, count(*) FROM fp GROUP BY 2""",
)
def _(data):
    return rounded(history.learning_report(performance(data), pairs(data)), "value")


@query(
    "process_feedback",
    f"""WITH {RATED.replace('FROM feedback_logs)', f"FROM feedback_logs WHERE feedback_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS)")}
    SELECT 'algorithm' AS kind, algorithm AS name, feedback, round(performance, 6) AS value FROM ap
    UNION ALL SELECT 'prediction', prediction_type, count(*), round(avg((rating - confidence) * 0.05), 6) FROM fp GROUP BY 2""",
)
def _(data):
    updates = history.process_feedback(rated(data), data.cleaned_data, data.users, data.ai_predictions, AS_OF)
    return rounded(updates, "value")


@query(
    "cleaning_strategy",
    f"""WITH {HISTORY}, d AS (SELECT (skewness(o_orderkey) + skewness(o_custkey) + skewness(o_totalprice)) / 3 AS s, count(*) AS n FROM raw_orders),
    x AS (SELECT *, abs(s) AS a, avg_quality >= 0.9 OR high_rate >= 0.6 AS good, avg_quality < 0.75 AS poor, trend_slope < -0.01 AS sinking FROM d, hs)
    SELECT CASE WHEN good THEN 'ml' WHEN poor THEN 'median' WHEN sinking THEN 'ml' WHEN a > 1 THEN 'ml' WHEN a < 0.5 THEN 'mean' ELSE 'mean' END
        AS impute_strategy,
    CASE WHEN good THEN 'zscore' WHEN poor THEN 'iqr' WHEN sinking THEN 'zscore' ELSE 'iqr' END AS outlier_method,
    NOT good AS normalize, good AS standardize, n > 80 AS reduce_noise, true AS clean_text FROM x""",
)
def _(data):
    return history.cleaning_strategy(
        profile.data_characteristics(data.raw_orders), history.quality_history(data.data_quality_scores)
    )


@query(
    "dataset_strategy",
    """WITH d AS (SELECT user_id, skewness(value) AS s, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN abs(s) > 1 THEN 'ml' WHEN abs(s) < 0.5 THEN 'mean' ELSE 'mean' END AS impute_strategy, 'iqr' AS outlier_method,
    n > 80 AS reduce_noise FROM d""",
)
def _(data):
    return history.strategy_per_key(events(data), KEY, "value").select("user_id", "impute_strategy", "outlier_method", "reduce_noise")
