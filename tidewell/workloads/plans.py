"""Registered queries: sources, sinks, cleaning plans, analysis, keywords and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import clean, keywords, rollups, series
from tidewell.plans import analysis, cleaning, progress
from tidewell.session import materialise, new_path
from tidewell.sources.readers import read_csv, read_upload
from tidewell.sources.store import CLEANED, RAW, REPORTS, SCORES, DatasetStore, export, export_all
from tidewell.streaming import events as stream
from tidewell.workloads import learning
from tidewell.workloads.cleaning import CLEAN
from tidewell.workloads.registry import query

ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ"


# ---- sources and sinks ------------------------------------------------------------------------------------


@query("src_csv_roundtrip", "SELECT * FROM raw_orders")
def _(data):
    path = new_path(data.spark, "export") + ".csv"
    export(data.raw_orders, path, "csv")
    return read_csv(data.spark, path, ORDERS)


@query("src_json_roundtrip", "SELECT * FROM customer")
def _(data):
    path = new_path(data.spark, "export") + ".json"
    people = data.table("customer")
    export(people, path, "json")
    return read_upload(data.spark, path, schema=people.schema)


@query("scan_raw_orders", "SELECT * FROM raw_orders WHERE o_orderstatus = 'F'")
def _(data):
    # Each order status is one stored dataset; the scan opens the folder of one of them.
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    store.save_raw(data.raw_orders.withColumn("raw_data_id", F.col("o_orderstatus")))
    return store.spark.read.parquet(store.path(RAW)).where(F.col("raw_data_id") == "F").drop("raw_data_id")


@query("preview_head5", "SELECT * FROM raw_orders ORDER BY o_orderkey, o_custkey LIMIT 5")
def _(data):
    return data.raw_orders.orderBy("o_orderkey", "o_custkey").limit(5)


@query(
    "cleaned_store_roundtrip",
    """SELECT n_name AS sector_name, c_custkey, c_acctbal, concat('full_pipeline__sector__', lower(n_name)) AS cleaning_algorithm
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, c_custkey, c_acctbal, 'full_pipeline' FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(data):
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    named = data.table("customer").join(data.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    table = named.select(F.col("n_name").alias("sector_name"), "c_custkey", "c_acctbal")
    store.save_variants(table, 1, "full_pipeline", {"impute": 0.9, "outliers": 0.8}, 11)
    # A second save of the same run replaces the first.
    store.save_variants(table, 1, "full_pipeline", {"impute": 1.0}, 12)
    return store.read(CLEANED).select("sector_name", "c_custkey", "c_acctbal", "cleaning_algorithm")


@query("export_all_roundtrip", "SELECT * FROM orders")
def _(data):
    path = new_path(data.spark, "export")
    rows = data.table("orders")
    export_all(rows.withColumn("cleaned_data_id", F.col("o_orderstatus")), path, "csv")
    return read_csv(data.spark, path, rows.schema).drop("cleaned_data_id")


def _region_store(data):
    """One dataset for each region: the customers of its nations with all columns, cleaned and scored with variants."""
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    nation = data.table("nation")
    named = data.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.withColumns({"sector_name": F.col("n_name"), "raw_data_id": F.col("n_regionkey").cast("bigint")})
    store.save_raw(rows)
    store.save_many_variants(
        rows.withColumn("cleaned_data_id", F.col("raw_data_id") + 10), "run", {"impute": 0.9, "outliers": 0.8}
    )
    regions = [row[0] for row in nation.select("n_regionkey").distinct().orderBy("n_regionkey").collect()]  # a handful
    return store, regions


def _save_empty(store, region):
    """Save the region's run again, with neither rows nor scores."""
    none = store.read(CLEANED, F.col("raw_data_id") == region).where("false")
    tags = ("cleaned_data_id", "quality_score", "raw_data_id", "cleaning_algorithm")
    store.save_variants(none.drop(*tags), region, "run", {}, 10 + region)


def _store_counts(store):
    parts = [
        store.read(table).groupBy("raw_data_id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(table).alias("stored"), F.col("raw_data_id").cast("bigint").alias("raw_data_id"), "n"
        )
        for table in (RAW, CLEANED, SCORES)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


STORED = """c AS (SELECT n_regionkey, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT 'raw' AS stored, n_regionkey AS r, count(*) AS n FROM c GROUP BY 2
        UNION ALL SELECT 'cleaned', n_regionkey, 2 * count(*) FROM c GROUP BY 2
        UNION ALL SELECT 'scores', n_regionkey, 2 * (1 + count(DISTINCT n_name)) FROM c GROUP BY 2)"""


@query("store_cascade", f"WITH {STORED} SELECT stored, CAST(r AS BIGINT) AS raw_data_id, CAST(n AS BIGINT) AS n FROM k WHERE r = 2")
def _(data):
    store, regions = _region_store(data)
    for region in regions:
        if region != 2:
            store.delete_dataset(region)
    return _store_counts(store)


@query(
    "store_upsert_empty",
    f"""WITH {STORED} SELECT stored, CAST(r AS BIGINT) AS raw_data_id, CAST(n AS BIGINT) AS n FROM k
    WHERE r = 2 OR (r = 1 AND stored = 'raw')""",
)
def _(data):
    store, regions = _region_store(data)
    _save_empty(store, 1)
    for region in regions:
        if region not in (1, 2):
            store.delete_dataset(region)
    return _store_counts(store)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_nationkey", "n_name", "n_regionkey"]


def _store_rows(store):
    """Stored rows with all columns, and the scores in the place of the balance."""
    score = {"stored": F.lit(SCORES), "c_name": F.col("algorithm"), "c_acctbal": F.col("score")}
    kept = [*CUSTOMER, "cleaning_algorithm"]
    raw = store.read(RAW).withColumns({"stored": F.lit(RAW), "cleaning_algorithm": F.lit("")})
    cleaned = store.read(CLEANED).withColumn("stored", F.lit(CLEANED))
    scores = store.read(SCORES).withColumns(score)
    parts = [raw.select("stored", F.col("raw_data_id").cast("bigint").alias("raw_data_id"), *kept)]
    parts.append(cleaned.select("stored", F.col("raw_data_id").cast("bigint").alias("raw_data_id"), *kept))
    known = ["stored", F.col("raw_data_id").cast("bigint").alias("raw_data_id"), "c_name", "c_acctbal", "cleaning_algorithm"]
    return parts[0].unionByName(parts[1]).unionByName(scores.select(*known), allowMissingColumns=True)


STORED_ROWS = f"""c AS (SELECT {', '.join(CUSTOMER)} FROM customer JOIN nation ON c_nationkey = n_nationkey),
    v AS (SELECT DISTINCT n_regionkey AS r, 'run' AS name FROM c
        UNION SELECT n_regionkey, concat('run__sector__', lower(n_name)) FROM c),
    s AS (SELECT 'impute' AS kind, CAST(0.9 AS DOUBLE) AS score UNION ALL SELECT 'outliers', CAST(0.8 AS DOUBLE)),
    k AS (SELECT 'raw' AS stored, CAST(n_regionkey AS BIGINT) AS raw_data_id, c.*, '' AS cleaning_algorithm FROM c
        UNION ALL SELECT 'cleaned', n_regionkey, c.*, 'run' FROM c
        UNION ALL SELECT 'cleaned', n_regionkey, c.*, concat('run__sector__', lower(n_name)) FROM c
        UNION ALL SELECT 'scores', r, NULL, kind, NULL, score, NULL, NULL, NULL, NULL, name FROM v, s)"""


@query("store_cascade_rows", f"WITH {STORED_ROWS} SELECT * FROM k WHERE raw_data_id <> 1")
def _(data):
    store, _ = _region_store(data)
    store.delete_dataset(1)
    return _store_rows(store)


@query("store_upsert_empty_rows", f"WITH {STORED_ROWS} SELECT * FROM k WHERE raw_data_id <> 1 OR stored = 'raw'")
def _(data):
    store, _ = _region_store(data)
    _save_empty(store, 1)
    return _store_rows(store)


@query(
    "store_delete_history",
    f"""WITH {STORED_ROWS}, h AS (SELECT k.*, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS BIGINT) AS gone FROM k
        WHERE stored = 'raw' OR raw_data_id NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'ASIA')),
    g AS (SELECT * FROM k WHERE stored <> 'raw' AND raw_data_id IN (SELECT r_regionkey FROM region WHERE r_name < 'ASIA'))
    SELECT * FROM h UNION ALL BY NAME SELECT 'result' AS stored, part, gone FROM (
        SELECT 'results' AS part, count(DISTINCT raw_data_id) AS gone FROM g UNION ALL SELECT stored, count(*) FROM g GROUP BY 1)""",
)
def _(data):
    # The history of the regions in scope goes, raw data stays; what went is counted.
    store, _ = _region_store(data)
    gone = store.delete_history(data.table("region").where("r_name < 'ASIA'").select("r_regionkey"))
    counts = data.spark.createDataFrame([("result", part, n) for part, n in gone.items()], "stored string, part string, gone bigint")
    return _store_rows(store).unionByName(counts, allowMissingColumns=True)


@query("store_saved_again", f"WITH {STORED_ROWS} SELECT * FROM k WHERE stored <> 'scores' OR raw_data_id <> 2")
def _(data):
    # A dataset is deleted whole and saved again under its id, this time without scores.
    store, _ = _region_store(data)
    kept = {table: materialise(store.read(table, F.col("raw_data_id") == 2)) for table in (RAW, CLEANED)}
    store.delete_dataset(2)
    store.save_raw(kept[RAW])
    whole = kept[CLEANED].where("cleaning_algorithm = 'run'").drop("quality_score", "cleaning_algorithm")
    store.save_many_variants(whole, "run", {})
    return _store_rows(store)


@query(
    "predictions_append",
    """SELECT user_id, concat('{"total":', CAST(CAST(count(*) AS BIGINT) AS VARCHAR), ',"last":', CAST(max(event_id) AS VARCHAR), '}')
        AS prediction_data, event_type AS prediction_type FROM events GROUP BY user_id, event_type""",
)
def _(data):
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    made = data.table("events").groupBy("user_id", F.col("event_type").alias("prediction_type")).agg(
        F.count("*").alias("total"), F.max("event_id").alias("last")
    )
    store.append_predictions(made, ["total", "last"])
    return data.spark.read.parquet(store.path("predictions"))


@query("feedback_append", "SELECT id, user_id, data_id, feedback_data, feedback_at, feedback_type FROM feedback_logs")
def _(data):
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    store.append(data.feedback_logs, "feedback", ["feedback_type"])
    return data.spark.read.parquet(store.path("feedback"))


@query(
    "report_store",
    """SELECT CAST(2 AS BIGINT) AS report_id, 'Monthly' AS title, 'quality' AS report_type, CAST(0 AS BIGINT) AS created_by, '' AS notes,
    concat('{"datasets":', count(*), ',"total_rows":', CAST(sum(row_count) AS BIGINT), ',"cleaned_rows":',
        CAST(sum(CASE WHEN has_cleaned_data THEN row_count ELSE 0 END) AS BIGINT), '}') AS payload FROM dataset_catalogue""",
)
def _(data):
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    catalogue = rollups.dataset_catalogue(data.raw_data, data.sectors, data.products, data.cleaned_data)
    metrics = rollups.dataset_kpis(catalogue).drop("avg_quality")
    store.append_report(metrics, 1, "Draft", "quality", 0)
    store.append_report(metrics, 2, "Monthly", "quality", 0)
    store.delete_report(1)
    return store.read(REPORTS)


# ---- cleaning plans ---------------------------------------------------------------------------------------

CONFIG = dict(id_columns=("o_orderkey", "o_custkey"), order_by=("o_orderkey",))
FULL = f"""d AS (SELECT DISTINCT * FROM raw_orders),
    i AS (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM d)) AS p,
        coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL GROUP BY 1
            ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority, o_orderstatus, o_orderdate FROM d),
    b AS (SELECT quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM i),
    c AS (SELECT i.* EXCLUDE (p), least(greatest(p, lo), hi) AS p FROM i, b),
    m AS (SELECT min(p) AS lo, max(p) AS hi FROM c),
    n AS (SELECT c.* EXCLUDE (p), (p - lo) / (hi - lo) AS p FROM c, m),
    full_clean AS (SELECT o_orderkey, o_custkey, CASE WHEN count(*) OVER w = 5 THEN round(avg(p) OVER w, 6) END AS o_totalprice,
        {CLEAN.format(c='o_orderpriority')} AS o_orderpriority, {CLEAN.format(c='o_orderstatus')} AS o_orderstatus, o_orderdate
        FROM n WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query("full_cleaning", f"WITH {FULL} SELECT * FROM full_clean")
def _(data):
    cleaned = cleaning.clean_table(data.raw_orders, "full_pipeline", cleaning.CleaningConfig(**CONFIG))
    return cleaned.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "full_cleaning_rules",
    f"""WITH d AS (SELECT DISTINCT * FROM raw_orders),
    i AS (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM d)) AS p,
        coalesce(o_orderpriority, (SELECT o_orderpriority FROM d WHERE o_orderpriority IS NOT NULL GROUP BY 1
            ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority, o_orderstatus, o_orderdate FROM d),
    b AS (SELECT quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM i),
    c AS (SELECT i.* EXCLUDE (p), least(greatest(p, lo), hi) AS p FROM i, b),
    z AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM c)
    SELECT o_orderkey, o_custkey, round(least(greatest((p - m) / s, -1.5), 1.5), 6) AS o_totalprice,
        regexp_replace(o_orderpriority, '[0-9]', '', 'g') AS o_orderpriority, o_orderstatus, o_orderdate
    FROM c, z WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(data):
    config = cleaning.CleaningConfig(
        impute_strategy="median", normalize=False, standardize=True, reduce_noise=False, clean_text=False,
        rules={"o_totalprice": clean.RangeRule(-1.5, 1.5), "o_orderpriority": clean.RegexRule("[0-9]")},
        reference_data={"o_custkey": data.table("customer").where("c_acctbal > 0").select("c_custkey")},
        **CONFIG,
    )
    cleaned = cleaning.clean_table(data.raw_orders, "full_pipeline", config)
    return cleaned.withColumn("o_totalprice", F.round("o_totalprice", 6))


NULLS = "(count(*) * 6.0 - count(o_totalprice) - count(o_orderpriority) - count(*) * 4) / (count(*) * 6.0)"


@query(
    "step_log",
    f"""WITH d AS (SELECT DISTINCT * FROM raw_orders), r AS (SELECT count(*) AS n, 1 - {NULLS} AS c FROM raw_orders),
    u AS (SELECT count(*) AS n, 1 - {NULLS} AS c FROM d), f AS (SELECT 1 - 4 / (count(*) * 6.0) AS c FROM d),
    s(seq, step_id, stage, progress) AS (VALUES (0, 'remove_duplicates', 'cleaning', 10), (1, 'impute_values', 'ml', 20),
        (2, 'cap_outliers', 'ml', 30), (3, 'apply_types', 'cleaning', 40), (4, 'apply_normalize', 'ml', 50), (5, 'standardize', 'ml', 60),
        (6, 'noise_reduction', 'ml', 70), (7, 'apply_text_cleaning', 'nlp', 80), (8, 'rules', 'validation', 90),
        (9, 'references', 'validation', 100), (10, 'structuring', 'structuring', 100))
    SELECT CAST(seq AS INT) AS seq, step_id, stage, CAST(progress AS INT) AS progress, u.n AS row_count,
        CASE WHEN seq IN (5, 8, 9, 10) THEN NULL WHEN seq = 0 THEN round(CAST(least(1.0, u.c / r.c) AS DOUBLE), 6)
             WHEN seq = 6 THEN round(CAST(f.c AS DOUBLE), 6) ELSE 1.0 END AS quality_score FROM s, r, u, f""",
)
def _(data):
    _, log = cleaning.clean_with_log(data.raw_orders, "full_pipeline", cleaning.CleaningConfig(**CONFIG))
    return log.select("seq", "step_id", "stage", "progress", "row_count", F.round("quality_score", 6).alias("quality_score"))


AT = dt.datetime(2024, 1, 31)


@query(
    "audit_log",
    """WITH gone AS (SELECT (SELECT count(*) FROM raw_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_orders)) AS n),
    s(seq, step_id, technique, status, columns_affected) AS (VALUES (0, 'remove_duplicates', 'exact row match', 'completed', 6),
        (1, 'impute_values', 'auto imputation', 'completed', 3), (2, 'cap_outliers', 'iqr outlier detection', 'completed', 1),
        (3, 'apply_types', 'type coercion', 'completed', 2), (4, 'apply_normalize', 'min-max scaling', 'completed', 1),
        (5, 'standardize', 'z-score scaling', 'skipped', 0), (6, 'noise_reduction', 'moving mean', 'completed', 1),
        (7, 'apply_text_cleaning', 'text normalisation', 'completed', 2), (8, 'rules', 'range and pattern rules', 'skipped', 0),
        (9, 'references', 'reference tables', 'skipped', 0), (10, 'structuring', 'column flattening', 'completed', 6))
    SELECT CAST(seq AS INT) AS seq, step_id, technique, status, CAST(columns_affected AS INT) AS columns_affected,
        CAST(CASE WHEN seq = 0 THEN n ELSE 0 END AS BIGINT) AS rows_removed, TIMESTAMP '2024-01-31 00:00:00' AS at FROM s, gone""",
)
def _(data):
    _, log = cleaning.clean_with_log(data.raw_orders, "full_pipeline", cleaning.CleaningConfig(**CONFIG), AT)
    return log.select("seq", "step_id", "technique", "status", "columns_affected", "rows_removed", "at")


@query(
    "audit_parameters",
    f"""WITH {FULL}, lines(step_id, "column", name, value, said) AS (
        SELECT 'impute_values', 'o_totalprice', 'fill', (SELECT avg(o_totalprice) FROM d), NULL
        UNION ALL SELECT 'impute_values', 'o_orderpriority', 'fill', NULL, (SELECT o_orderpriority FROM d
            WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        UNION ALL SELECT 'impute_values', 'o_orderstatus', 'fill', NULL, (SELECT o_orderstatus FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        UNION ALL SELECT 'cap_outliers', 'o_totalprice', 'low', lo, NULL FROM b
        UNION ALL SELECT 'cap_outliers', 'o_totalprice', 'high', hi, NULL FROM b
        UNION ALL SELECT 'apply_normalize', 'o_totalprice', 'low', lo, NULL FROM m
        UNION ALL SELECT 'apply_normalize', 'o_totalprice', 'high', hi, NULL FROM m
        UNION ALL SELECT 'noise_reduction', 'o_totalprice', 'window', 5.0, NULL)
    SELECT step_id, "column", name, round(CAST(value AS DOUBLE), 4) AS value, said FROM lines""",
)
def _(data):
    # Every value that a step of the run was fitted with, read back from its log.
    _, log = cleaning.clean_with_log(data.raw_orders, "full_pipeline", cleaning.CleaningConfig(**CONFIG), AT)
    lines = log.select("step_id", F.explode(F.from_json("parameters", "map<string,map<string,string>>")).alias("column", "fitted"))
    lines = lines.select("step_id", "column", F.explode("fitted").alias("name", "said"))
    value = F.col("said").try_cast("double")
    return lines.select("step_id", "column", "name", F.round(value, 4).alias("value"), F.when(value.isNull(), F.col("said")).alias("said"))


@query(
    "prediction_log",
    f"""WITH {learning.FIT} SELECT 'forecast_linear' AS prediction_type, 'completed' AS status, count(*) * 12 AS predictions,
    round(avg(confidence), 6) AS confidence, '{{"periods": 12}}' AS parameters, TIMESTAMP '2024-01-31 00:00:00' AS at FROM fit
    UNION ALL SELECT 'trend', 'completed', (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 10)), 0.8,
    '{{"long": 30, "short": 7}}', TIMESTAMP '2024-01-31 00:00:00'""",
)
def _(data):
    # One entry for each prediction run over all series.
    rows, log = learning.events(data), progress.RunLog(data.spark, at=AT)
    forecast = series.forecast_linear(rows, learning.KEY, learning.ORDER, "value", 12)
    progress.log_prediction(log, 0, "forecast_linear", forecast, {"periods": 12})
    trends = series.trend_anomaly(rows, learning.KEY, learning.ORDER, "value")
    progress.log_prediction(log, 1, "trend", trends, {"short": series.SHORT, "long": series.LONG})
    runs = log.latest().where(F.col("kind") == progress.PREDICTION)
    return runs.select(
        F.col("step_id").alias("prediction_type"), "status", F.col("row_count").alias("predictions"),
        F.round("quality_score", 6).alias("confidence"), "parameters", "at",
    )


@query(
    "scan_and_validate",
    """WITH u AS (SELECT count(*) AS n, count(*) - count(o_totalprice) + count(*) - count(o_orderpriority) AS missing,
        count(*) FILTER (NOT o_totalprice BETWEEN 0 AND 1) AS unscaled FROM raw_orders),
    d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM raw_orders))
    SELECT 'scan_missing' AS step_id, 'profiling' AS stage, missing AS issues, n AS row_count FROM u
    UNION ALL SELECT 'validate_missing', 'validation', 0, n FROM u
    UNION ALL SELECT 'scan_duplicates', 'profiling', u.n - d.n, u.n FROM u, d
    UNION ALL SELECT 'validate_dedup', 'validation', 0, n FROM d
    UNION ALL SELECT 'profile_scale', 'profiling', unscaled, n FROM u
    UNION ALL SELECT 'validate_scale', 'validation', 0, n FROM u""",
)
def _(data):
    logs = [
        cleaning.clean_with_log(data.raw_orders, name, cleaning.CleaningConfig(**CONFIG))[1]
        for name in ("missing_values", "duplicates", "normalization")
    ]
    both = logs[0].unionByName(logs[1]).unionByName(logs[2])
    return both.where("issues IS NOT NULL").select("step_id", "stage", "issues", "row_count")


@query("adaptive_cleaning")
def _(data):
    # Settings from the shape of the orders and the history of scores, then the improvement; the result is stored.
    store = DatasetStore(data.spark, new_path(data.spark, "store"))
    config = cleaning.CleaningConfig(**CONFIG)
    _, _, summary = cleaning.adaptive_cleaning(data.raw_orders, data.data_quality_scores, store, 1, 11, config=config, at=AT)
    return summary


ANALYSED = f"""{learning.FIT}, {learning.TREND}, {learning.ANOMALY}, c AS (SELECT user_id, count(*) FILTER (anomaly) AS n FROM f GROUP BY 1),
    e AS (SELECT user_id, count(*) AS rows, count(value) / count(*) AS completeness, avg(value) AS now FROM events GROUP BY 1),
    sp AS (SELECT user_id, sqrt(var_pop(value) * (1 - coalesce(regr_r2(value, pos), 1))) AS off FROM p GROUP BY 1),
    aj AS (SELECT e.*, trend, trend_strength, c.n AS anomaly_count, intercept + slope * (points + 5.5) AS ahead, confidence, off
        FROM e LEFT JOIN l ON l.user_id = e.user_id LEFT JOIN c ON c.user_id = l.user_id LEFT JOIN fit ON fit.user_id = e.user_id
        LEFT JOIN sp ON sp.user_id = fit.user_id),
    ak AS (SELECT *, CASE WHEN rows > 20 THEN ahead END AS fa,
        CASE WHEN rows > 20 THEN CASE WHEN off > 0 THEN 1 / (1 + exp(1.702 * (ahead - now) / off)) ELSE CAST(ahead < now AS INT) END END AS risk FROM aj),
    an AS (SELECT *, CASE WHEN fa > now * 1.1 OR fa < now * 0.9 THEN 1 ELSE 0 END + CASE WHEN trend IN ('increasing', 'decreasing') THEN 1 ELSE 0 END
        + CASE WHEN anomaly_count > 0 THEN 1 ELSE 0 END + CASE WHEN risk > 0.4 THEN 1 ELSE 0 END AS advices FROM ak)
    SELECT user_id, rows, CAST(completeness AS DOUBLE) AS completeness, round(now, 6) AS current_average, trend,
    round(trend_strength, 6) AS trend_strength, anomaly_count, round(fa, 5) AS forecast_avg,
    round(CASE WHEN rows > 20 THEN confidence END, 6) AS forecast_confidence, round(risk, 6) AS predicted_risk,
    CAST(advices AS BIGINT) AS advices, CASE WHEN advices > 2 THEN 'high' ELSE 'medium' END AS priority FROM an"""
CLEAN_EVENTS = """ed AS (SELECT DISTINCT event_id, user_id, ts, value FROM events),
    ei AS (SELECT * REPLACE (coalesce(value, (SELECT avg(value) FROM ed)) AS value) FROM ed),
    eb AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ei),
    ev AS (SELECT ei.* REPLACE (least(greatest(value, lo), hi) AS value) FROM ei, eb)"""


def shown(found):
    rounded = learning.rounded(found, "current_average", "trend_strength", "forecast_confidence", "predicted_risk")
    return learning.rounded(rounded, "forecast_avg", places=5)


@query("analyze_full", f"WITH {CLEAN_EVENTS}, {ANALYSED.replace('FROM events', 'FROM ev')}")
def _(data):
    # The upload is cleaned, and trend, forecast, risk and advice of every series are taken from the cleaned table.
    config = cleaning.CleaningConfig(
        normalize=False, reduce_noise=False, clean_text=False, id_columns=("event_id", "user_id", "ts"), order_by=learning.ORDER
    )
    found, _ = analysis.analyse_upload(learning.events(data), learning.KEY, learning.ORDER, "value", config)
    return shown(found)


@query("analyze_raw", f"WITH {ANALYSED}")
def _(data):
    return shown(analysis.analyse(learning.events(data), learning.KEY, learning.ORDER, "value"))


TERMS = """w AS (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents),
    c AS (SELECT doc_id, lang, term, count(*) AS uses FROM w WHERE length(term) >= 3 GROUP BY ALL),
    z AS (SELECT lang, count(DISTINCT doc_id) AS n FROM c GROUP BY 1),
    t AS (SELECT lang, term, count(*) AS texts FROM c GROUP BY ALL),
    q AS (SELECT t.*, n, texts / n >= 0.25 AS stop FROM t JOIN z ON t.lang IS NOT DISTINCT FROM z.lang)"""


@query(
    "doc_keywords",
    f"""WITH {TERMS}, k AS (SELECT doc_id, c.term, uses, round(uses * ln((n + 1) / (texts + 1)), 9) AS weight FROM c
        JOIN q ON c.term = q.term AND c.lang IS NOT DISTINCT FROM q.lang WHERE NOT stop)
    SELECT doc_id, term, uses, round(weight, 6) AS weight FROM k
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5""",
)
def _(data):
    found = keywords.keywords(data.table("documents"), "doc_id", "text", language="lang")
    return found.withColumn("weight", F.round("weight", 6))


@query("learned_stop_words", f"WITH {TERMS} SELECT lang, term, texts FROM q WHERE stop")
def _(data):
    return keywords.stop_words(data.table("documents"), "doc_id", "text", "lang")


# ---- streams ----------------------------------------------------------------------------------------------


def _stream(data):
    return stream.read_events(data.spark, data.folder, data.table("events").schema, "events.parquet")


@query(
    "hourly_event_stats",
    """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value,
    max(value) AS max_value FROM events GROUP BY 1, 2""",
)
def _(data):
    found = stream.batch_statistics(data.table("events"), "ts", "event_type", "value", "1 hour")
    return found.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "stream_hourly_event_stats",
    """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value,
    max(value) AS max_value FROM events GROUP BY 1, 2
    HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(data):
    # Append mode leaves out the windows still open at the end of the stream.
    target = new_path(data.spark, "hourly")
    closed = stream.windowed_statistics(_stream(data), "ts", "event_type", "value", "1 hour", "1 hour")
    stream.run_to_table(closed, target, new_path(data.spark, "hourly-state"))
    return data.spark.read.parquet(target).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "stream_anomaly_counts",
    """WITH v AS (SELECT event_type, date_trunc('hour', ts) AS window_start, value FROM events),
    w AS (SELECT event_type, window_start, count(*) AS events, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM v GROUP BY ALL),
    b AS (SELECT event_type, window_start, events, coalesce(sum(n) OVER p, 0) AS n, sum(s) OVER p / sum(n) OVER p AS m,
        sqrt(greatest(sum(q) OVER p / sum(n) OVER p - (sum(s) OVER p / sum(n) OVER p) ** 2, 0)) AS d
        FROM w WINDOW p AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT b.window_start, b.event_type, b.events, count(*) FILTER (b.n >= 10 AND abs(value - m) > 3 * d) AS anomalies,
        round(m + 1e-9, 6) AS mean_before, CAST(b.n AS BIGINT) AS seen_before
    FROM b JOIN v ON v.event_type = b.event_type AND v.window_start = b.window_start
    WHERE b.window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""",
)
def _(data):
    target = new_path(data.spark, "anomalies")
    found = stream.anomaly_counts(_stream(data), "ts", "event_type", "value", 3600, "1 hour")
    stream.run_to_table(found, target, new_path(data.spark, "anomalies-state"))
    return data.spark.read.parquet(target).withColumn("mean_before", F.round(F.col("mean_before") + 1e-9, 6))


@query(
    "stream_cleaned_events",
    """SELECT event_id, ts, user_id, regexp_replace(lower(event_type), '[^a-z_]', '', 'g') AS event_type,
    least(greatest(value, 1.0), 100.0) AS value, props FROM events""",
)
def _(data):
    target = new_path(data.spark, "events")
    cleaned = stream.clean_stream(
        _stream(data), ["event_id"], "ts", "1 hour", ["event_type"], {"value": clean.RangeRule(1.0, 100.0)}
    )
    stream.run_to_table(cleaned, target, new_path(data.spark, "events-state"))
    return data.spark.read.parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
