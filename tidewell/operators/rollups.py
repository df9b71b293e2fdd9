"""Roll-ups over the dataset metadata: catalogues, dashboards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import sector_label
from tidewell.operators.quantiles import grouped_quantiles
from tidewell.operators.ranking import latest_per_key, one_row
from tidewell.operators.scope import semi


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    return part * scale / F.greatest(whole, F.lit(1))


# ---- catalogues -------------------------------------------------------------------------------------------


def dataset_catalogue(raw: DataFrame, sectors: DataFrame, products: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row per dataset with names, size and the latest cleaned result."""
    newest = latest_per_key(cleaned, ["raw_data_id"], "cleaned_at", "id").select(
        F.col("raw_data_id").alias("_r"), F.col("id").alias("cleaned_data_id"), "quality_score"
    )
    sector_names = sectors.select(F.col("id").alias("_s"), F.col("name").alias("_sector"))
    product_names = products.select(F.col("id").alias("_p"), F.col("name").alias("product_name"))
    joined = (
        raw.join(sector_names, F.col("sector_id") == F.col("_s"), "left")
        .join(product_names, F.col("product_id") == F.col("_p"), "left")
        .join(newest, F.col("id") == F.col("_r"), "left")
    )
    return joined.select(
        "id",
        F.concat(F.lit("dataset_"), F.col("id").cast("string"), F.lit(".csv")).alias("name"),
        "sector_id",
        F.coalesce("_sector", F.lit("Unknown")).alias("sector_name"),
        "product_id",
        "product_name",
        "uploaded_by",
        "uploaded_at",
        "row_count",
        F.col("cleaned_data_id").isNotNull().alias("has_cleaned_data"),
        "cleaned_data_id",
        "quality_score",
    )


def cleaned_with_raw(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Cleaned results with the raw dataset they come from."""
    source = raw.select(F.col("id").alias("_r"), "sector_id", "uploaded_by", "uploaded_at", "row_count")
    return cleaned.join(source, F.col("raw_data_id") == F.col("_r")).drop("_r")


def cleaned_catalogue(cleaned: DataFrame, scoped: DataFrame) -> DataFrame:
    """Cleaned results in scope, newest first, with the sector label of variants."""
    rows = cleaned_with_raw(cleaned, scoped)
    algorithm = F.coalesce("cleaning_algorithm", F.lit("unknown"))
    return rows.select(
        F.col("id").alias("cleaned_data_id"),
        "raw_data_id",
        algorithm.alias("algorithm"),
        sector_label(algorithm).alias("sector_label"),
        "row_count",
        "quality_score",
        "cleaned_at",
    ).orderBy(F.desc("cleaned_at"), F.desc("cleaned_data_id"))


def with_status(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("status", F.when(F.col("has_cleaned_data"), "Cleaned").otherwise("Pending"))


def search(catalogue: DataFrame, text: str) -> DataFrame:
    """Datasets whose name or sector contains the text, pending first, then newest id."""
    wanted = text.strip().lower()
    found = with_status(catalogue)
    if wanted:
        found = found.where(F.lower("name").contains(wanted) | F.lower("sector_name").contains(wanted))
    return found.orderBy(F.when(F.col("status") == "Pending", 0).otherwise(1), F.desc("id"))


def with_defaults(catalogue: DataFrame) -> DataFrame:
    """Missing fields replaced by the defaults the dashboards expect."""
    return catalogue.select(
        "id",
        F.coalesce("name", F.concat(F.lit("dataset_"), F.col("id").cast("string"), F.lit(".csv"))).alias("name"),
        F.coalesce("product_name", "sector_name", F.lit("General")).alias("sector"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("records"),
        F.round(F.coalesce("quality_score", F.lit(0.0)), 2).alias("quality"),
        F.coalesce("has_cleaned_data", F.lit(False)).alias("cleaned"),
    )


# ---- catalogue charts -------------------------------------------------------------------------------------

def quality_percent() -> Column:
    return F.coalesce(F.col("quality_score"), F.lit(0.0)) * 100


def dataset_kpis(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("has_cleaned_data"), F.col("row_count"))), F.lit(0))
        .cast("bigint")
        .alias("cleaned_rows"),
        F.round(F.coalesce(F.avg(quality_percent()), F.lit(0.0)), 4).alias("avg_quality"),
    )


def department_performance(catalogue: DataFrame) -> DataFrame:
    """Cleaned and pending rows, quality and dataset count per sector, in one grouped pass."""
    cleaned = F.coalesce(F.sum(F.when(F.col("has_cleaned_data"), F.col("row_count"))), F.lit(0)).cast("bigint")
    pending = F.coalesce(F.sum(F.when(~F.col("has_cleaned_data"), F.col("row_count"))), F.lit(0)).cast("bigint")
    return catalogue.groupBy(F.col("sector_name").alias("department")).agg(
        cleaned.alias("cleaned"),
        pending.alias("pending"),
        F.sum("row_count").cast("bigint").alias("total"),
        F.round(F.avg(quality_percent()), 0).alias("quality"),
        F.count(F.lit(1)).alias("datasets"),
    )


def monthly_trend(catalogue: DataFrame) -> DataFrame:
    return (
        catalogue.groupBy(F.trunc("uploaded_at", "month").alias("month"))
        .agg(
            F.sum("row_count").cast("bigint").alias("rows"),
            F.count(F.lit(1)).alias("datasets"),
            F.round(F.avg(quality_percent()), 4).alias("quality"),
        )
        .withColumn("label", F.date_format("month", "MMM"))
    )


# Quality bands in percent.
BANDS = (("High (>=85%)", 85.0), ("Medium (70-84%)", 70.0), ("Low (<70%)", None))


def quality_bands(catalogue: DataFrame) -> DataFrame:
    """Datasets per band; an empty band counts 0."""
    high, medium = BANDS[0][1], BANDS[1][1]
    counts = catalogue.agg(
        F.count_if(quality_percent() >= high).alias("high"),
        F.count_if((quality_percent() >= medium) & (quality_percent() < high)).alias("medium"),
        F.count_if(quality_percent() < medium).alias("low"),
    )
    rows = [F.struct(F.lit(BANDS[i][0]).alias("band"), F.col(c).alias("datasets")) for i, c in enumerate(("high", "medium", "low"))]
    return counts.select(F.inline(F.array(*rows)))


def flow_links(catalogue: DataFrame) -> DataFrame:
    """Sector to status links with at least weight 1."""
    links = [
        F.struct(F.lit(status).alias("target"), F.greatest(F.lit(1), F.col(c)).cast("bigint").alias("value"))
        for status, c in (("Cleaned", "cleaned"), ("Pending", "pending"))
    ]
    return department_performance(catalogue).select(F.col("department").alias("source"), F.inline(F.array(*links)))


def metric_targets(catalogue: DataFrame) -> DataFrame:
    """Five headline metrics beside their targets, highest value first."""
    kpis = dataset_kpis(catalogue)
    quality = F.col("avg_quality")
    values = [
        ("Quality Score", F.round(quality, 0), 95),
        ("Cleaned Coverage", F.round(share(F.col("cleaned_rows"), F.col("total_rows")), 0), 90),
        ("Dataset Volume", F.round(F.col("datasets") / 25 * 100, 0), 100),
        ("Pipeline Throughput", F.least(F.lit(100.0), F.round(F.col("total_rows") / 75000 * 100, 0)), 85),
        ("Consistency", F.greatest(F.lit(55.0), F.least(F.lit(99.0), F.round(quality + 6, 0))), 92),
    ]
    rows = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(float(target)).alias("target"))
        for name, value, target in values
    ]
    long = kpis.select(F.inline(F.array(*rows)))
    gap = F.greatest(F.col("target") - F.col("value"), F.lit(0.0))
    return long.withColumn("remaining", gap).orderBy(F.desc("value"), "metric")


def load_index(catalogue: DataFrame) -> DataFrame:
    return department_performance(catalogue).select(
        "department",
        F.round(F.col("total") / 1000, 1).alias("rows_k"),
        "quality",
        F.least(F.lit(100), F.col("datasets") * 20).cast("bigint").alias("load_index"),
    )


def dataset_points(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        F.concat(F.lit("DS-"), F.col("id").cast("string")).alias("name"),
        F.col("row_count").alias("x"),
        F.round(quality_percent(), 0).alias("y"),
        F.when(F.col("has_cleaned_data"), 12).otherwise(8).alias("z"),
    )


def box_plot(catalogue: DataFrame) -> DataFrame:
    """Five-number summary of dataset sizes per sector, in thousands."""
    found = grouped_quantiles(
        catalogue, ["sector_name"], "row_count", (0.0, 0.25, 0.5, 0.75, 1.0), ("low", "q1", "median", "q3", "high")
    )
    thousands = [F.round(F.col(c) / 1000, 1).alias(c) for c in ("low", "q1", "median", "q3", "high")]
    return found.select(
        F.col("sector_name").alias("category"), *thousands, F.round((F.col("q3") - F.col("q1")) / 1000, 1).alias("iqr")
    )


# ---- dashboards -------------------------------------------------------------------------------------------


def scored_raw(raw: DataFrame, cleaned: DataFrame, scores: DataFrame) -> DataFrame:
    """Datasets with the score sum and count of all their cleaned results.

    Scores are summed per cleaned result before the join, so the join never fans out.
    """
    summed = scores.groupBy("cleaned_data_id").agg(F.sum("score").alias("_sum"), F.count("score").alias("_n"))
    per_raw = (
        cleaned.select(F.col("id").alias("_c"), "raw_data_id")
        .join(summed, F.col("_c") == F.col("cleaned_data_id"), "left")
        .groupBy("raw_data_id")
        .agg(F.count("_c").alias("cleaned"), F.sum("_sum").alias("score_sum"), F.sum("_n").alias("score_n"))
    )
    return raw.join(per_raw, F.col("id") == F.col("raw_data_id"), "left").drop("raw_data_id")


def avg_score() -> Column:
    return F.coalesce(F.try_divide(F.sum("score_sum"), F.sum("score_n")), F.lit(0.0))


def sector_comparison(seen: DataFrame, cleaned: DataFrame, scores: DataFrame, sectors: DataFrame) -> DataFrame:
    """Uploads and mean quality per company, role and sector of the datasets that ``scope.with_principal`` gives."""
    stats = scored_raw(seen, cleaned, scores).groupBy("company_id", "role", "sector_id").agg(
        F.count(F.lit(1)).alias("uploads"), F.round(avg_score(), 10).alias("avg_quality")
    )
    names = sectors.select(F.col("id").alias("_s"), F.col("name").alias("sector"))
    return stats.join(names, F.col("sector_id") == F.col("_s")).drop("_s")


def prediction_summary(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("prediction_type").agg(
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count(F.lit(1)).alias("predictions")
    )


def system_health(scoped: DataFrame, cleaned: DataFrame, scores: DataFrame) -> DataFrame:
    mine = semi(cleaned, "raw_data_id", scoped)
    quality = semi(scores, "cleaned_data_id", mine).agg(F.avg("score").alias("avg_quality"))
    merged = one_row(
        scoped.agg(F.count(F.lit(1)).alias("raw_entries")),
        mine.agg(F.count(F.lit(1)).alias("cleaned_entries")),
        quality,
    )
    return merged.select(
        "raw_entries",
        "cleaned_entries",
        F.round(share(F.col("cleaned_entries"), F.col("raw_entries"), 1.0), 6).alias("processing_rate"),
        F.round(F.coalesce("avg_quality", F.lit(0.0)), 4).alias("avg_quality"),
    )


def sector_summary(seen: DataFrame, cleaned: DataFrame, scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """Uploads, cleaned results, mean quality and predictions per company, role and sector of the datasets seen."""
    stats = scored_raw(seen, cleaned, scores).groupBy("company_id", "role", "sector_id").agg(
        F.count(F.lit(1)).alias("uploads"),
        F.coalesce(F.sum("cleaned"), F.lit(0)).cast("bigint").alias("cleaned_datasets"),
        F.round(avg_score(), 10).alias("avg_quality"),
    )
    counts = predictions.groupBy(F.col("sector_id").alias("_s")).agg(F.count(F.lit(1)).alias("predictions"))
    return (
        stats.join(counts, F.col("sector_id") == F.col("_s"), "left").drop("_s").na.fill(0, ["predictions"])
    )


def company_overview(seen: DataFrame, products: DataFrame) -> DataFrame:
    """Per principal: sectors with uploads, products of those sectors, uploads."""
    principal = ["company_id", "role", "scope_sector"]
    uploads = seen.groupBy(*principal, "sector_id").agg(F.count(F.lit(1)).alias("uploads"))
    goods = products.groupBy(F.col("sector_id").alias("_p")).agg(F.count(F.lit(1)).alias("products"))
    return (
        uploads.join(goods, F.col("sector_id") == F.col("_p"), "left")
        .groupBy(*principal)
        .agg(
            F.count(F.lit(1)).alias("sectors"),
            F.coalesce(F.sum("products"), F.lit(0)).cast("bigint").alias("products"),
            F.sum("uploads").cast("bigint").alias("uploads"),
        )
    )


def admin_quick_stats(users: DataFrame, feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per company and role: new users, corrections and recent feedback."""
    since = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(days)} DAYS")
    logs = feedback.groupBy(F.col("user_id").alias("_u")).agg(
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
        F.count_if(F.col("feedback_at") >= since).alias("recent"),
    )
    return (
        users.join(logs, F.col("id") == F.col("_u"), "left")
        .groupBy("company_id", "role")
        .agg(
            F.count_if(F.col("created_at") >= since).alias("new_users"),
            F.coalesce(F.sum("corrections"), F.lit(0)).cast("bigint").alias("corrections"),
            F.coalesce(F.sum("recent"), F.lit(0)).cast("bigint").alias("recent_feedback"),
        )
    )


PRINCIPAL = ["company_id", "role", "scope_sector"]


def report_metrics(owned: DataFrame, cleaned: DataFrame, predictions: DataFrame) -> DataFrame:
    """Uploads, cleaned results, predictions and mean quality of every principal at once.

    ``owned`` holds the datasets with their principal columns.
    """
    per_raw = cleaned.groupBy(F.col("raw_data_id").alias("_r")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality_score").alias("q")
    )
    per_sector = predictions.groupBy(F.col("sector_id").alias("_s")).agg(F.count(F.lit(1)).alias("p"))
    by_sector = (
        owned.join(per_raw, F.col("id") == F.col("_r"), "left")
        .groupBy(*PRINCIPAL, "sector_id")
        .agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("row_count").alias("rows"))
    )
    return (
        by_sector.join(per_sector, F.col("sector_id") == F.col("_s"), "left")
        .groupBy(*PRINCIPAL)
        .agg(
            F.sum("u").cast("bigint").alias("total_uploads"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_cleaned"),
            F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("total_predictions"),
            F.round(F.coalesce(F.try_divide(F.sum("q"), F.sum("n")) * 100, F.lit(0.0)), 4).alias("avg_quality"),
            F.sum("rows").cast("bigint").alias("total_rows"),
        )
    )


# The two headline figures each role sees.
ROLE_KPIS = {
    "ceo": ("Company Data Readiness", "Expected Reporting Confidence"),
    "admin": ("Company Data Readiness", "Expected Reporting Confidence"),
    "data_analyst": ("Cleaning Coverage Forecast", "Model Feature Reliability"),
    "sales_manager": ("Usable Dataset Count", "Sales Insight Readiness"),
    "sector_head": ("Sector Pipeline Health", "Sector Data Quality Forecast"),
}


def role_kpis(metrics: DataFrame) -> DataFrame:
    """Titled figures per principal, derived from the report metrics."""
    titles = F.create_map(*[x for role, pair in ROLE_KPIS.items() for x in (F.lit(role), F.array(*map(F.lit, pair)))])
    coverage = F.round(share(F.col("total_cleaned"), F.col("total_uploads")), 4)
    first = F.when(F.col("role") == "sales_manager", F.col("total_cleaned").cast("double")).otherwise(coverage)
    title = titles[F.col("role")]
    rows = F.array(
        F.struct(
            title[0].alias("title"), first.alias("value"),
            F.when(F.col("role") == "sales_manager", "datasets").otherwise("%").alias("unit"),
        ),
        F.struct(title[1].alias("title"), F.col("avg_quality").alias("value"), F.lit("%").alias("unit")),
        F.struct(
            F.lit("Processed Volume").alias("title"), F.col("total_rows").cast("double").alias("value"),
            F.lit("rows").alias("unit"),
        ),
    )
    return metrics.select(*PRINCIPAL, F.inline(rows))


def scope_totals(scoped: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Counts, latest upload and latest quality of a scope; an empty scope gives zeros and nulls."""
    mine = semi(cleaned, "raw_data_id", scoped)
    return one_row(
        scoped.agg(
            F.count(F.lit(1)).alias("total_raw"), F.max_by("id", F.struct("uploaded_at", "id")).alias("latest_raw")
        ),
        mine.agg(
            F.count(F.lit(1)).alias("total_cleaned"),
            F.round(
                F.coalesce(F.max_by("quality_score", F.struct("cleaned_at", "id")) * 100, F.lit(0.0)), 2
            ).alias("latest_quality"),
        ),
    )


def visible_columns(listings: DataFrame, n: int = 8) -> DataFrame:
    """First n column names, sorted, over the newest 20 datasets' column lists."""
    newest = listings.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(20)
    return newest.select(F.explode("columns").alias("column")).distinct().orderBy("column").limit(n)


def cleaning_stats(mine: DataFrame) -> DataFrame:
    return mine.agg(
        F.count(F.lit(1)).alias("total_cleaned"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 2).alias("avg_quality"),
    )
