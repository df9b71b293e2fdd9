"""Registered queries: profiling and before/after comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import clean, profile
from tidewell.session import materialise
from tidewell.workloads.registry import query

COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
MISSING = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in COLUMNS)
TOKENS = "('', 'na', 'n/a', 'null', 'none', 'nan', 'undefined')"
INVALID = " + ".join(
    f"count(*) FILTER (lower(trim({c})) IN {TOKENS})" for c in ("o_orderpriority", "o_orderstatus")
)
FENCES = "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)
OUTLIERS = " + ".join(
    f"count(*) FILTER ({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")
)
# The imputed and de-duplicated table of the comparison queries.
IMPUTED = """imputed AS (
    SELECT DISTINCT o_orderkey, o_custkey,
        coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM (SELECT DISTINCT * FROM raw_orders))) AS o_totalprice,
        coalesce(o_orderpriority, (SELECT o_orderpriority FROM (SELECT DISTINCT * FROM raw_orders)
            WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
        o_orderstatus, o_orderdate FROM raw_orders)"""


def counts_sql(table: str) -> str:
    return f"""SELECT count(*) AS n, {MISSING} AS missing, count(*) - (SELECT count(*) FROM
        (SELECT DISTINCT * FROM {table})) AS dups FROM {table}"""


@query("missing_pct", f"SELECT round(({MISSING}) / (count(*) * 6.0), 8) AS missing_pct FROM raw_orders")
def _(data):
    df = data.raw_orders
    return df.agg(F.round(profile.missing_share(df), 8).alias("missing_pct"))


@query(
    "duplicate_count",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_orders)) AS duplicate_rows FROM raw_orders",
)
def _(data):
    return profile.duplicate_count(data.raw_orders)


@query(
    "iqr_outlier_count",
    f"WITH q AS ({FENCES} FROM raw_orders) SELECT {OUTLIERS} AS outlier_count FROM raw_orders, q",
)
def _(data):
    return profile.iqr_outlier_count(data.raw_orders)


@query("invalid_token_count", f"SELECT {INVALID} AS invalid_count FROM raw_orders")
def _(data):
    df = data.raw_orders
    return df.agg(profile.invalid_total(df).alias("invalid_count"))


def _null_rows(table: str, alias: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS {alias} FROM {table}" for c in COLUMNS
    )


@query(
    "column_missing_top12",
    f"""SELECT * FROM ({_null_rows('raw_orders', 'missing')}) ORDER BY missing DESC, "column" LIMIT 12""",
)
def _(data):
    return profile.top_missing_columns(data.raw_orders)


@query(
    "column_profile",
    f"""SELECT "column", CASE WHEN "column" IN ('o_orderkey', 'o_custkey') THEN 'bigint'
        WHEN "column" = 'o_totalprice' THEN 'double' WHEN "column" = 'o_orderdate' THEN 'timestamp_ntz'
        ELSE 'string' END AS dtype, nulls FROM ({_null_rows('raw_orders', 'nulls')})""",
)
def _(data):
    return profile.column_profile(data.raw_orders)


ERROR_PROFILE = f"""WITH q AS ({FENCES} FROM raw_orders), c AS (
    SELECT count(*) AS n, {MISSING} AS missing, {OUTLIERS} AS outliers, {INVALID} AS invalid FROM raw_orders, q),
    d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM raw_orders)),
    m AS (SELECT 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM c
    UNION ALL SELECT 'columns', 6.0 UNION ALL SELECT 'total_cells', n * 6.0 FROM c
    UNION ALL SELECT 'quality_score', round((n * 6 - missing) * 100.0 / (n * 6), 2) FROM c
    UNION ALL SELECT 'Missing Values', missing FROM c UNION ALL SELECT 'Outliers', outliers FROM c
    UNION ALL SELECT 'Invalid Formats', invalid FROM c
    UNION ALL SELECT 'Duplicate Rows', c.n - d.n FROM c, d)
    SELECT metric, CAST(value AS DOUBLE) AS value FROM m"""


@query("error_profile", ERROR_PROFILE)
def error_profile(data):
    return profile.error_profile(data.raw_orders)


@query("dotted_profile", ERROR_PROFILE)
def _(data):
    # The same table with dots in its column names.
    return profile.error_profile(data.raw_orders.toDF(*[c.replace("_", ".", 1) for c in data.raw_orders.columns]))


def cleaned_orders(data):
    """Dirty orders without repeats and with gaps filled, written once as a stored result would be."""
    distinct = materialise(clean.remove_duplicates(data.raw_orders))
    return clean.impute(distinct, exclude=("o_orderkey", "o_custkey"))


@query(
    "quality_score_impute",
    f"""WITH {IMPUTED}, b AS (SELECT 1 - ({MISSING}) / (count(*) * 6.0) AS c FROM raw_orders),
    a AS (SELECT 1 - ({MISSING}) / (count(*) * 6.0) AS c FROM imputed)
    SELECT round(CAST(least(1.0, a.c / greatest(b.c, 0.01)) AS DOUBLE), 6) AS quality_score FROM a, b""",
)
def _(data):
    score = profile.quality_score(data.raw_orders, cleaned_orders(data))
    return score.select(F.round("quality_score", 6).alias("quality_score"))


@query(
    "cleaning_improvement",
    f"""WITH {IMPUTED}, b AS ({counts_sql('raw_orders')}), a AS ({counts_sql('imputed')}),
    r AS (SELECT b.missing / (b.n * 6.0) AS mb, a.missing / (a.n * 6.0) AS ma, b.dups AS db, a.dups AS da,
        least(a.n * 1.0 / b.n, 1.0) AS kept FROM a, b)
    SELECT round(CAST(100 * (0.5 * greatest(0, mb - ma) + 0.3 * greatest(0, (db - da) * 1.0 / greatest(db, 1))
        + 0.2 * kept) AS DOUBLE), 2) AS cleaned_percent, round(CAST(mb * 100 AS DOUBLE), 2) AS missing_before_percent,
        round(CAST(ma * 100 AS DOUBLE), 2) AS missing_after_percent, db AS duplicates_before, da AS duplicates_after FROM r""",
)
def _(data):
    return profile.cleaning_improvement(data.raw_orders, cleaned_orders(data))


@query(
    "clean_compare",
    f"""WITH {IMPUTED}, qb AS ({FENCES} FROM raw_orders), qa AS ({FENCES} FROM imputed),
    b AS ({counts_sql('raw_orders')}), a AS ({counts_sql('imputed')}),
    ob AS (SELECT {OUTLIERS} AS n FROM raw_orders, qb), oa AS (SELECT {OUTLIERS} AS n FROM imputed, qa),
    m AS (SELECT 'rows' AS metric, b.n * 1.0 AS before, a.n * 1.0 AS after FROM a, b
    UNION ALL SELECT 'columns', 6, 6 UNION ALL SELECT 'Missing %', b.missing * 100 / (b.n * 6.0), a.missing * 100 / (a.n * 6.0) FROM a, b
    UNION ALL SELECT 'Duplicate Rows', b.dups, a.dups FROM a, b UNION ALL SELECT 'Outlier Count', ob.n, oa.n FROM ob, oa
    UNION ALL SELECT 'quality', 100 - round(b.missing * 100 / (b.n * 6.0), 2), 90.0 FROM b)
    SELECT metric, round(CAST(before AS DOUBLE), 2) AS before, round(CAST(after AS DOUBLE), 2) AS after FROM m""",
)
def _(data):
    return profile.clean_compare(data.raw_orders, cleaned_orders(data), stored_quality=0.9)


@query(
    "missing_by_column_compare",
    f"""WITH {IMPUTED}, b AS ({_null_rows('raw_orders', 'before')}), a AS ({_null_rows('imputed', 'after')})
    SELECT coalesce(a."column", b."column") AS "column", coalesce(before, 0) AS before, coalesce(after, 0) AS after
    FROM b FULL JOIN a ON a."column" = b."column" ORDER BY before + after DESC, "column" LIMIT 10""",
)
def _(data):
    return profile.missing_by_column(data.raw_orders, cleaned_orders(data))


@query(
    "data_characteristics",
    """SELECT round(s, 6) AS skewness, CASE WHEN abs(s) < 0.8 THEN 'normal' ELSE 'skewed' END AS distribution,
    true AS needs_normalization, false AS needs_standardization, n > 80 AS has_noise, true AS has_text
    FROM (SELECT (skewness(o_orderkey) + skewness(o_custkey) + skewness(o_totalprice)) / 3 AS s, count(*) AS n
    FROM raw_orders)""",
)
def _(data):
    return profile.data_characteristics(data.raw_orders)
