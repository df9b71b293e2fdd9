"""Registered queries: scope, catalogues, dashboards, reports, top-k and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ranking, rollups, scope
from tidewell.operators.scope import Principal
from tidewell.workloads.registry import query

CEO = Principal(1, "ceo")
HEAD = Principal(2, "sector_head", 7)
AS_OF = "2024-02-10 00:00:00"


def scoped_sql(who: Principal = CEO) -> str:
    own = f" AND id = {who.sector_id}" if who.role == "sector_head" else ""
    return f"""SELECT * FROM raw_data WHERE sector_id IN (SELECT id FROM sectors WHERE company_id = {who.company_id}{own})
        AND uploaded_by IN (SELECT id FROM users WHERE company_id = {who.company_id} AND role = '{who.role}')"""


SCOPED = f"scoped AS ({scoped_sql()})"
MINE = f"{SCOPED}, mine AS (SELECT * FROM cleaned_data WHERE raw_data_id IN (SELECT id FROM scoped))"


def scoped(data, who: Principal = CEO):
    return scope.scoped_raw(data.raw_data, data.sectors, data.users, who)


def catalogue(data):
    return rollups.dataset_catalogue(data.raw_data, data.sectors, data.products, data.cleaned_data)


# ---- filters and scope ------------------------------------------------------------------------------------


@query("scoped_raw_data", f"SELECT 'ceo' AS who, * FROM ({scoped_sql()}) UNION ALL SELECT 'head', * FROM ({scoped_sql(HEAD)})")
def _(data):
    ceo = scoped(data).select(F.lit("ceo").alias("who"), "*")
    return ceo.unionByName(scoped(data, HEAD).select(F.lit("head").alias("who"), "*"))


@query("feedback_last_30d", f"SELECT * FROM feedback_logs WHERE feedback_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS")
def _(data):
    return data.feedback_logs.where(F.col("feedback_at") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 30 DAYS"))


@query("filter_pending", "SELECT id, sector_name FROM dataset_catalogue WHERE NOT has_cleaned_data AND sector_name = 'NATION_3'")
def _(data):
    found = rollups.with_status(catalogue(data))
    return found.where((F.col("status") == "Pending") & (F.col("sector_name") == "NATION_3")).select("id", "sector_name")


@query("filter_in_set", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(data):
    wanted = data.table("customer").where("c_mktsegment = 'BUILDING'")
    return scope.semi(data.table("orders"), "o_custkey", wanted, "c_custkey")


@query("base_cleaned_only", "SELECT * FROM cleaned_data WHERE NOT contains(cleaning_algorithm, '__sector__')")
def _(data):
    return data.cleaned_data.where(~F.col("cleaning_algorithm").contains("__sector__"))


@query(
    "dataset_search",
    """SELECT id, name, sector_name, CASE WHEN has_cleaned_data THEN 'Cleaned' ELSE 'Pending' END AS status
    FROM dataset_catalogue WHERE contains(lower(name), 'n_1') OR contains(lower(sector_name), 'n_1')""",
)
def _(data):
    return rollups.search(catalogue(data), "  N_1 ").select("id", "name", "sector_name", "status")


@query(
    "coalesce_defaults",
    """SELECT id, name, coalesce(product_name, sector_name, 'General') AS sector, row_count AS records,
    round(coalesce(quality_score, 0.0), 2) AS quality, has_cleaned_data AS cleaned FROM dataset_catalogue""",
)
def _(data):
    return rollups.with_defaults(catalogue(data))


@query("dataset_status", "SELECT id, CASE WHEN has_cleaned_data THEN 'Cleaned' ELSE 'Pending' END AS status FROM dataset_catalogue")
def _(data):
    return rollups.with_status(catalogue(data)).select("id", "status")


@query(
    "sectors_in_company",
    """SELECT s.id AS sector_id, s.name AS sector, p.id AS product_id, p.name AS product
    FROM sectors s JOIN products p ON p.sector_id = s.id WHERE s.company_id = 1""",
)
def _(data):
    homes = scope.allowed_sectors(data.sectors, CEO).select(F.col("id").alias("sector_id"), F.col("name").alias("sector"))
    goods = data.products.select("sector_id", F.col("id").alias("product_id"), F.col("name").alias("product"))
    return homes.join(goods, "sector_id")


@query("distinct_sectors", f"WITH {SCOPED} SELECT DISTINCT sector_id FROM scoped")
def _(data):
    return scoped(data).select("sector_id").distinct()


# ---- joins ------------------------------------------------------------------------------------------------


@query(
    "cleaned_join_raw",
    """SELECT c.*, r.sector_id, r.uploaded_by, r.uploaded_at, r.row_count FROM cleaned_data c JOIN raw_data r
    ON c.raw_data_id = r.id""",
)
def _(data):
    return rollups.cleaned_with_raw(data.cleaned_data, data.raw_data)


@query("predictions_in_scope", f"WITH {SCOPED} SELECT * FROM ai_predictions WHERE sector_id IN (SELECT sector_id FROM scoped)")
def _(data):
    return scope.predictions_in_scope(data.ai_predictions, scoped(data), data.sectors)


@query(
    "recommendations_in_scope",
    f"""WITH {SCOPED} SELECT * FROM ai_recommendations WHERE prediction_id IN (SELECT id FROM ai_predictions
    WHERE sector_id IN (SELECT sector_id FROM scoped))""",
)
def _(data):
    return scope.recommendations_in_scope(data.ai_recommendations, data.ai_predictions, scoped(data), data.sectors)


@query(
    "feedback_by_role",
    """SELECT * FROM feedback_logs WHERE user_id IN (SELECT id FROM users WHERE company_id = 1 AND role = 'ceo')""",
)
def _(data):
    return scope.semi(data.feedback_logs, "user_id", scope.allowed_uploaders(data.users, CEO))


@query(
    "reports_by_role",
    """SELECT * FROM company_reports WHERE company_id = 1 AND created_by IN (SELECT id FROM users WHERE role = 'ceo')""",
)
def _(data):
    authors = data.users.where(F.col("role") == CEO.role)
    return scope.semi(data.company_reports.where(F.col("company_id") == CEO.company_id), "created_by", authors).orderBy(
        F.desc("id")
    )


@query("latest_predictions", f"""WITH {SCOPED} SELECT * FROM ai_predictions WHERE sector_id IN (SELECT sector_id FROM scoped)
    ORDER BY predicted_at DESC, id DESC LIMIT 10""")
def _(data):
    return ranking.latest(scope.predictions_in_scope(data.ai_predictions, scoped(data), data.sectors), "predicted_at", "id", 10)


@query(
    "latest_cleaned_per_sector",
    """SELECT sector_id, id, quality_score, cleaned_at FROM (SELECT c.*, r.sector_id, row_number() OVER (
    PARTITION BY r.sector_id ORDER BY cleaned_at DESC, c.id DESC) AS rn FROM cleaned_data c JOIN raw_data r
    ON c.raw_data_id = r.id) WHERE rn = 1""",
)
def _(data):
    joined = rollups.cleaned_with_raw(data.cleaned_data, data.raw_data)
    return ranking.latest_per_key(joined, ["sector_id"], "cleaned_at", "id").select(
        "sector_id", "id", "quality_score", "cleaned_at"
    )


@query(
    "top5_predictions_per_sector",
    """SELECT * FROM ai_predictions QUALIFY row_number() OVER (PARTITION BY sector_id ORDER BY predicted_at DESC, id DESC) <= 5""",
)
def _(data):
    return ranking.top_n_per_key(data.ai_predictions, ["sector_id"], [F.desc("predicted_at"), F.desc("id")], 5)


# ---- catalogues and charts --------------------------------------------------------------------------------


@query("dataset_catalog", "SELECT * FROM dataset_catalogue")
def _(data):
    return catalogue(data)


@query(
    "cleaned_catalog",
    f"""WITH {SCOPED} SELECT c.id AS cleaned_data_id, raw_data_id, cleaning_algorithm AS algorithm,
    CASE WHEN contains(cleaning_algorithm, '__sector__') THEN split_part(cleaning_algorithm, '__sector__', 2) ELSE 'all' END
        AS sector_label, row_count, quality_score, cleaned_at FROM cleaned_data c JOIN scoped s ON c.raw_data_id = s.id""",
)
def _(data):
    return rollups.cleaned_catalogue(data.cleaned_data, scoped(data))


KPIS = """k AS (SELECT count(*) AS datasets, CAST(sum(row_count) AS BIGINT) AS total_rows,
    CAST(sum(CASE WHEN has_cleaned_data THEN row_count ELSE 0 END) AS BIGINT) AS cleaned_rows,
    round(avg(coalesce(quality_score, 0) * 100), 4) AS avg_quality FROM dataset_catalogue)"""


@query("dataset_kpis", f"WITH {KPIS} SELECT * FROM k")
def _(data):
    return rollups.dataset_kpis(catalogue(data))


DEPARTMENTS = """d AS (SELECT sector_name AS department,
    CAST(sum(CASE WHEN has_cleaned_data THEN row_count ELSE 0 END) AS BIGINT) AS cleaned,
    CAST(sum(CASE WHEN has_cleaned_data THEN 0 ELSE row_count END) AS BIGINT) AS pending,
    CAST(sum(row_count) AS BIGINT) AS total, round(avg(coalesce(quality_score, 0) * 100)) AS quality, count(*) AS datasets
    FROM dataset_catalogue GROUP BY 1)"""


@query("department_performance", f"WITH {DEPARTMENTS} SELECT * FROM d")
def _(data):
    return rollups.department_performance(catalogue(data))


@query(
    "monthly_trend",
    """SELECT CAST(date_trunc('month', uploaded_at) AS DATE) AS month, CAST(sum(row_count) AS BIGINT) AS rows,
    count(*) AS datasets, round(avg(coalesce(quality_score, 0) * 100), 4) AS quality,
    strftime(date_trunc('month', uploaded_at), '%b') AS label FROM dataset_catalogue GROUP BY 1, 5""",
)
def _(data):
    return rollups.monthly_trend(catalogue(data))


@query(
    "quality_bands",
    """SELECT 'High (>=85%)' AS band, count(*) FILTER (q >= 85) AS datasets FROM (SELECT coalesce(quality_score, 0.0) * 100 AS q FROM dataset_catalogue)
    UNION ALL SELECT 'Medium (70-84%)', count(*) FILTER (q >= 70 AND q < 85) FROM (SELECT coalesce(quality_score, 0.0) * 100 AS q FROM dataset_catalogue)
    UNION ALL SELECT 'Low (<70%)', count(*) FILTER (q < 70) FROM (SELECT coalesce(quality_score, 0.0) * 100 AS q FROM dataset_catalogue)""",
)
def _(data):
    return rollups.quality_bands(catalogue(data))


@query(
    "flow_links",
    f"""WITH {DEPARTMENTS} SELECT department AS source, 'Cleaned' AS target, greatest(1, cleaned) AS value FROM d
    UNION ALL SELECT department, 'Pending', greatest(1, pending) FROM d""",
)
def _(data):
    return rollups.flow_links(catalogue(data))


@query(
    "metric_targets",
    f"""WITH {KPIS}, m AS (SELECT 'Quality Score' AS metric, round(avg_quality) AS value, 95.0 AS target FROM k
    UNION ALL SELECT 'Cleaned Coverage', round(cleaned_rows * 100.0 / greatest(total_rows, 1)), 90.0 FROM k
    UNION ALL SELECT 'Dataset Volume', round(datasets / 25.0 * 100), 100.0 FROM k
    UNION ALL SELECT 'Pipeline Throughput', least(100.0, round(total_rows / 75000.0 * 100)), 85.0 FROM k
    UNION ALL SELECT 'Consistency', greatest(55.0, least(99.0, round(avg_quality + 6))), 92.0 FROM k)
    SELECT metric, CAST(value AS DOUBLE) AS value, CAST(target AS DOUBLE) AS target,
        CAST(greatest(target - value, 0) AS DOUBLE) AS remaining FROM m""",
)
def _(data):
    return rollups.metric_targets(catalogue(data))


@query(
    "load_index",
    f"""WITH {DEPARTMENTS} SELECT department, round(CAST(total AS DOUBLE) / 1000, 1) AS rows_k, quality, least(100, datasets * 20) AS load_index FROM d""",
)
def _(data):
    return rollups.load_index(catalogue(data))


@query(
    "dataset_points",
    """SELECT concat('DS-', CAST(id AS VARCHAR)) AS name, row_count AS x, round(coalesce(quality_score, 0) * 100) AS y,
    CASE WHEN has_cleaned_data THEN 12 ELSE 8 END AS z FROM dataset_catalogue""",
)
def _(data):
    return rollups.dataset_points(catalogue(data))


@query(
    "box_plot_by_sector",
    """WITH q AS (SELECT sector_name AS category, min(row_count) AS low, quantile_cont(row_count, 0.25) AS q1,
    quantile_cont(row_count, 0.5) AS median, quantile_cont(row_count, 0.75) AS q3, max(row_count) AS high
    FROM dataset_catalogue GROUP BY 1)
    SELECT category, round(low / 1000.0, 1) AS low, round(q1 / 1000, 1) AS q1, round(median / 1000, 1) AS median,
    round(q3 / 1000, 1) AS q3, round(high / 1000.0, 1) AS high, round((q3 - q1) / 1000, 1) AS iqr FROM q""",
)
def _(data):
    return rollups.box_plot(catalogue(data))


# ---- dashboards and reports -------------------------------------------------------------------------------

SCORES = """cs AS (SELECT cleaned_data_id, sum(score) AS s, count(score) AS n FROM data_quality_scores GROUP BY 1),
    pr AS (SELECT raw_data_id, count(*) AS cleaned, sum(s) AS s, sum(n) AS n FROM cleaned_data c
        LEFT JOIN cs ON cs.cleaned_data_id = c.id GROUP BY 1)"""


SEEN = """seen AS (SELECT r.*, u.company_id, u.role, CASE WHEN u.role = 'sector_head' THEN r.sector_id END AS scope_sector
    FROM raw_data r JOIN users u ON r.uploaded_by = u.id JOIN sectors s ON r.sector_id = s.id AND s.company_id = u.company_id)"""


def seen(data):
    return scope.with_principal(data.raw_data, data.sectors, data.users)


@query(
    "sector_comparison",
    f"""WITH {SCORES}, {SEEN} SELECT r.company_id, r.role, r.sector_id, s.name AS sector, count(*) AS uploads,
    round(coalesce(sum(pr.s) / nullif(sum(pr.n), 0), 0), 10) AS avg_quality FROM seen r JOIN sectors s ON r.sector_id = s.id
    LEFT JOIN pr ON pr.raw_data_id = r.id GROUP BY 1, 2, 3, 4""",
)
def _(data):
    return rollups.sector_comparison(seen(data), data.cleaned_data, data.data_quality_scores, data.sectors)


@query(
    "prediction_summary",
    f"""WITH {SCOPED} SELECT prediction_type, round(avg(confidence), 4) AS avg_confidence, count(*) AS predictions
    FROM ai_predictions WHERE sector_id IN (SELECT sector_id FROM scoped) GROUP BY 1""",
)
def _(data):
    return rollups.prediction_summary(scope.predictions_in_scope(data.ai_predictions, scoped(data), data.sectors))


@query(
    "users_by_role",
    """SELECT company_id, role, count(*) AS users, CAST(sum(count(*)) OVER (PARTITION BY company_id) AS BIGINT) AS total
    FROM users GROUP BY 1, 2""",
)
def _(data):
    roles = data.users.groupBy("company_id", "role").agg(F.count("*").alias("users"))
    totals = roles.groupBy("company_id").agg(F.sum("users").alias("total"))
    return roles.join(totals, "company_id")


@query(
    "system_health",
    f"""WITH {MINE} SELECT (SELECT count(*) FROM scoped) AS raw_entries, (SELECT count(*) FROM mine) AS cleaned_entries,
    round((SELECT count(*) FROM mine) * 1.0 / greatest((SELECT count(*) FROM scoped), 1), 6) AS processing_rate,
    round((SELECT avg(score) FROM data_quality_scores WHERE cleaned_data_id IN (SELECT id FROM mine)), 4) AS avg_quality""",
)
def _(data):
    return rollups.system_health(scoped(data), data.cleaned_data, data.data_quality_scores)


@query(
    "sector_summary",
    f"""WITH {SCORES}, {SEEN}, p AS (SELECT sector_id, count(*) AS n FROM ai_predictions GROUP BY 1)
    SELECT r.company_id, r.role, r.sector_id, count(*) AS uploads, CAST(coalesce(sum(cleaned), 0) AS BIGINT) AS cleaned_datasets,
    round(coalesce(sum(pr.s) / nullif(sum(pr.n), 0), 0), 10) AS avg_quality, coalesce(max(p.n), 0) AS predictions
    FROM seen r LEFT JOIN pr ON pr.raw_data_id = r.id LEFT JOIN p ON p.sector_id = r.sector_id GROUP BY 1, 2, 3""",
)
def _(data):
    return rollups.sector_summary(seen(data), data.cleaned_data, data.data_quality_scores, data.ai_predictions)


@query(
    "recent_uploads_per_sector",
    f"""WITH {SEEN} SELECT company_id, role, sector_id, id, uploaded_at, row_count FROM seen
    QUALIFY row_number() OVER (PARTITION BY company_id, role, sector_id ORDER BY uploaded_at DESC, id DESC) <= 5""",
)
def _(data):
    principal = ["company_id", "role", "sector_id"]
    newest = ranking.top_n_per_key(seen(data), principal, [F.desc("uploaded_at"), F.desc("id")], 5)
    return newest.select(*principal, "id", "uploaded_at", "row_count")


@query(
    "company_overview",
    f"""WITH {SEEN}, k AS (SELECT company_id, role, scope_sector, sector_id, count(*) AS n FROM seen GROUP BY 1, 2, 3, 4)
    SELECT company_id, role, scope_sector, count(*) AS sectors, CAST(sum((SELECT count(*) FROM products p WHERE p.sector_id = k.sector_id))
    AS BIGINT) AS products, CAST(sum(n) AS BIGINT) AS uploads FROM k GROUP BY 1, 2, 3""",
)
def _(data):
    return rollups.company_overview(seen(data), data.products)


@query(
    "admin_quick_stats",
    f"""WITH f AS (SELECT user_id, count(*) FILTER (feedback_type = 'correction') AS c,
    count(*) FILTER (feedback_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS n FROM feedback_logs GROUP BY 1)
    SELECT company_id, role, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS) AS new_users,
    CAST(coalesce(sum(c), 0) AS BIGINT) AS corrections, CAST(coalesce(sum(n), 0) AS BIGINT) AS recent_feedback
    FROM users LEFT JOIN f ON f.user_id = users.id GROUP BY 1, 2""",
)
def _(data):
    return rollups.admin_quick_stats(data.users, data.feedback_logs, AS_OF)


REPORT = """o AS (SELECT r.*, u.company_id, u.role, CASE WHEN u.role = 'sector_head' THEN r.sector_id END AS scope_sector
    FROM raw_data r JOIN users u ON r.uploaded_by = u.id JOIN sectors s ON r.sector_id = s.id AND s.company_id = u.company_id),
    pr AS (SELECT raw_data_id, count(*) AS n, sum(quality_score) AS q FROM cleaned_data GROUP BY 1),
    g AS (SELECT company_id, role, scope_sector, count(*) AS total_uploads, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_cleaned,
    (SELECT count(*) FROM ai_predictions p WHERE p.sector_id IN (SELECT o2.sector_id FROM o o2 WHERE o2.company_id = o.company_id
        AND o2.role = o.role AND o2.scope_sector IS NOT DISTINCT FROM o.scope_sector)) AS total_predictions,
    round(coalesce(sum(q) / nullif(sum(n), 0) * 100, 0), 4) AS avg_quality, CAST(sum(row_count) AS BIGINT) AS total_rows
    FROM o LEFT JOIN pr ON pr.raw_data_id = o.id GROUP BY 1, 2, 3)"""


def report(data):
    owned = scope.with_principal(data.raw_data, data.sectors, data.users)
    return rollups.report_metrics(owned, data.cleaned_data, data.ai_predictions)


@query("report_metrics", f"WITH {REPORT} SELECT * FROM g")
def _(data):
    return report(data)


def _kpi_sql() -> str:
    pair = "CASE role " + " ".join(f"WHEN '{r}' THEN '{{}}'" for r in rollups.ROLE_KPIS) + " END"
    first = pair.format(*[p[0] for p in rollups.ROLE_KPIS.values()])
    second = pair.format(*[p[1] for p in rollups.ROLE_KPIS.values()])
    key = "company_id, role, scope_sector"
    return f"""WITH {REPORT} SELECT {key}, {first} AS title, CASE WHEN role = 'sales_manager' THEN CAST(total_cleaned AS DOUBLE)
        ELSE round(total_cleaned * 100.0 / greatest(total_uploads, 1), 4) END AS value,
        CASE WHEN role = 'sales_manager' THEN 'datasets' ELSE '%' END AS unit FROM g
    UNION ALL SELECT {key}, {second}, avg_quality, '%' FROM g
    UNION ALL SELECT {key}, 'Processed Volume', CAST(total_rows AS DOUBLE), 'rows' FROM g"""


@query("role_kpis", _kpi_sql())
def _(data):
    return rollups.role_kpis(report(data))


TOTALS = """SELECT (SELECT count(*) FROM scoped) AS total_raw, (SELECT id FROM scoped ORDER BY uploaded_at DESC, id DESC LIMIT 1)
    AS latest_raw, (SELECT count(*) FROM mine) AS total_cleaned, round(coalesce((SELECT quality_score FROM mine
    ORDER BY cleaned_at DESC, id DESC LIMIT 1), 0) * 100, 2) AS latest_quality"""


@query("scope_totals", f"WITH {MINE} {TOTALS}")
def _(data):
    return rollups.scope_totals(scoped(data), data.cleaned_data)


@query("empty_scope_totals", f"WITH {MINE.replace('company_id = 1', 'company_id = 99')} {TOTALS}")
def _(data):
    return rollups.scope_totals(scoped(data, Principal(99, "ceo")), data.cleaned_data)


@query(
    "visible_schema",
    """WITH d AS (SELECT event_id, ts, list_concat(['event_id', 'ts', event_type], json_keys(props)) AS cols FROM events
        ORDER BY ts DESC, event_id DESC LIMIT 20)
    SELECT DISTINCT unnest(cols) AS "column" FROM d ORDER BY 1 LIMIT 8""",
)
def _(data):
    # Each event stands for a dataset whose columns are its fields and the keys of its JSON payload.
    fields = F.array(F.lit("event_id"), F.lit("ts"), F.col("event_type"))
    listings = data.table("events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("uploaded_at"),
        F.concat(fields, F.json_object_keys("props")).alias("columns"),
    )
    return rollups.visible_columns(listings)


@query(
    "cleaning_stats",
    f"WITH {MINE} SELECT count(*) AS total_cleaned, round(coalesce(avg(quality_score), 0), 2) AS avg_quality FROM mine",
)
def _(data):
    return rollups.cleaning_stats(scope.semi(data.cleaned_data, "raw_data_id", scoped(data)))


@query("recent_cleaning_jobs", f"WITH {MINE} SELECT * FROM mine ORDER BY cleaned_at DESC, id DESC LIMIT 5")
def _(data):
    return ranking.latest(scope.semi(data.cleaned_data, "raw_data_id", scoped(data)), "cleaned_at", "id", 5)


@query(
    "distinct_predictions",
    """SELECT s.company_id, count(*) AS predictions, count(DISTINCT p.sector_id) AS sectors FROM ai_predictions p
    JOIN sectors s ON p.sector_id = s.id WHERE p.sector_id IN (SELECT sector_id FROM raw_data) GROUP BY 1""",
)
def _(data):
    known = scope.predictions_in_scope(data.ai_predictions, data.raw_data, data.sectors)
    per_sector = known.groupBy("sector_id").agg(F.count("*").alias("n"))
    homes = data.sectors.select(F.col("id").alias("sector_id"), "company_id")
    return per_sector.join(homes, "sector_id").groupBy("company_id").agg(
        F.sum("n").alias("predictions"), F.count("*").alias("sectors")
    )


# ---- deletes ----------------------------------------------------------------------------------------------


@query(
    "delete_history_survivors",
    f"""WITH {MINE} SELECT 'cleaned' AS part, id, NULL AS score FROM cleaned_data WHERE id NOT IN (SELECT id FROM mine)
    UNION ALL SELECT 'score', cleaned_data_id, score FROM data_quality_scores WHERE cleaned_data_id NOT IN (SELECT id FROM mine)""",
)
def _(data):
    gone = scope.semi(data.cleaned_data, "raw_data_id", scoped(data))
    kept = scope.anti(data.cleaned_data, "id", gone).select(
        F.lit("cleaned").alias("part"), "id", F.lit(None).cast("double").alias("score")
    )
    scores = scope.anti(data.data_quality_scores, "cleaned_data_id", gone).select(
        F.lit("score").alias("part"), F.col("cleaned_data_id").alias("id"), "score"
    )
    return kept.unionByName(scores)


@query(
    "cascade_delete_survivors",
    f"""WITH {SCOPED}, gone AS (SELECT id FROM cleaned_data WHERE raw_data_id IN (SELECT id FROM scoped))
    SELECT 'raw' AS part, count(*) AS n FROM raw_data WHERE id NOT IN (SELECT id FROM scoped)
    UNION ALL SELECT 'cleaned', count(*) FROM cleaned_data WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'scores', count(*) FROM data_quality_scores WHERE cleaned_data_id NOT IN (SELECT id FROM gone)""",
)
def _(data):
    doomed = scoped(data)
    gone = scope.semi(data.cleaned_data, "raw_data_id", doomed)
    parts = {
        "raw": scope.anti(data.raw_data, "id", doomed),
        "cleaned": scope.anti(data.cleaned_data, "id", gone),
        "scores": scope.anti(data.data_quality_scores, "cleaned_data_id", gone),
    }
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
