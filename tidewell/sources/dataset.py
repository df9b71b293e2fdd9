"""The base tables and the logical views (metadata star, dirty orders) the queries read."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same views as portable SQL, for checking results on another engine.
VIEW_SQL = {
    "sectors": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS company_id FROM nation",
    "products": "SELECT p_partkey AS id, p_name AS name, CAST(p_partkey % 25 AS INT) AS sector_id FROM part",
    "users": """SELECT c_custkey AS id, c_name AS username,
        CASE c_custkey % 5 WHEN 0 THEN 'ceo' WHEN 1 THEN 'admin' WHEN 2 THEN 'data_analyst'
             WHEN 3 THEN 'sales_manager' ELSE 'sector_head' END AS role,
        n_regionkey AS company_id, CASE WHEN c_custkey % 5 = 4 THEN c_nationkey END AS sector_id,
        TIMESTAMP '2023-12-01 00:00:00' + CAST(c_custkey % 60 AS INT) * INTERVAL 1 DAY AS created_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw_data": """SELECT o_orderkey AS id, c_nationkey AS sector_id, o_custkey AS uploaded_by,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % (SELECT count(*) FROM part) END AS product_id, o_orderdate AS uploaded_at,
        CAST(floor(o_totalprice / 10) AS BIGINT) AS row_count
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cleaned_data": """SELECT o_orderkey AS id, o_orderkey AS raw_data_id,
        CASE WHEN o_orderkey % 4 = 1 THEN concat('full_pipeline__sector__s', CAST(o_orderkey % 7 AS VARCHAR))
             ELSE 'full_pipeline' END AS cleaning_algorithm,
        0.5 + CAST(o_orderkey % 50 AS DOUBLE) / 100 AS quality_score, o_orderdate AS cleaned_at
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "data_quality_scores": """SELECT l_orderkey AS cleaned_data_id, 1.0 - l_discount AS score,
        l_returnflag AS algorithm, l_shipdate AS scored_at FROM lineitem""",
    "ai_predictions": """SELECT event_id AS id, CAST(user_id % 25 AS INT) AS sector_id,
        event_type AS prediction_type, value / 500 AS confidence, ts AS predicted_at FROM events""",
    "ai_recommendations": """SELECT conv_id * 10 + turn AS id, conv_id AS prediction_id,
        text AS recommendation_text, role AS explanation FROM conversations""",
    "feedback_logs": """SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM orders) AS data_id,
        CASE WHEN event_type = 'error' THEN 'correction' ELSE 'validation' END AS feedback_type,
        props AS feedback_data, ts AS feedback_at FROM events WHERE event_type IN ('error', 'click')""",
    "company_reports": """SELECT doc_id AS id, doc_id % (SELECT count(*) FROM customer) AS created_by, n_regionkey AS company_id,
        source AS title, lang AS report_type
        FROM documents JOIN customer ON doc_id % (SELECT count(*) FROM customer) = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "orders_clean_src": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 97 = 5 THEN o_totalprice * 20
             ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 13 = 4 THEN NULL WHEN o_orderkey % 17 = 6 THEN ' N/A '
             ELSE o_orderpriority END AS o_orderpriority,
        o_orderstatus, o_orderdate FROM orders""",
    "raw_orders": """SELECT * FROM orders_clean_src
        UNION ALL SELECT * FROM orders_clean_src WHERE o_orderkey % 20 = 3""",
    "dataset_catalogue": """SELECT r.id, concat('dataset_', CAST(r.id AS VARCHAR), '.csv') AS name, r.sector_id,
        coalesce(s.name, 'Unknown') AS sector_name, r.product_id, p.name AS product_name, r.uploaded_by,
        r.uploaded_at, r.row_count, c.id IS NOT NULL AS has_cleaned_data, c.id AS cleaned_data_id, c.quality_score
        FROM raw_data r LEFT JOIN sectors s ON r.sector_id = s.id LEFT JOIN products p ON r.product_id = p.id
        LEFT JOIN (SELECT * FROM cleaned_data QUALIFY row_number() OVER (
            PARTITION BY raw_data_id ORDER BY cleaned_at DESC, id DESC) = 1) c ON c.raw_data_id = r.id""",
}


class Dataset:
    """Lazily opened tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cache
    def rows(self, name: str) -> int:
        """Rows of a table, from its footers; views that spread ids over a table take its size from here."""
        return self.table(name).count()

    @cached_property
    def sectors(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("company_id")
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            (F.col("p_partkey") % 25).cast("int").alias("sector_id"),
        )

    @cached_property
    def users(self) -> DataFrame:
        turn = F.col("c_custkey") % 5
        role = (
            F.when(turn == 0, "ceo")
            .when(turn == 1, "admin")
            .when(turn == 2, "data_analyst")
            .when(turn == 3, "sales_manager")
            .otherwise("sector_head")
        )
        joined = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("username"),
            role.alias("role"),
            F.col("n_regionkey").alias("company_id"),
            F.when(turn == 4, F.col("c_nationkey")).alias("sector_id"),
            F.expr(
                "TIMESTAMP_NTZ '2023-12-01 00:00:00' + make_dt_interval(CAST(c_custkey % 60 AS INT), 0, 0, 0)"
            ).alias("created_at"),
        )

    @cached_property
    def raw_data(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_nationkey").alias("sector_id"),
            F.col("o_custkey").alias("uploaded_by"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % self.rows("part")).alias("product_id"),
            F.col("o_orderdate").alias("uploaded_at"),
            F.floor(F.col("o_totalprice") / 10).cast("bigint").alias("row_count"),
        )

    @cached_property
    def cleaned_data(self) -> DataFrame:
        key = F.col("o_orderkey")
        variant = F.concat(F.lit("full_pipeline__sector__s"), (key % 7).cast("string"))
        return (
            self.table("orders")
            .where(key % 3 != 0)
            .select(
                key.alias("id"),
                key.alias("raw_data_id"),
                F.when(key % 4 == 1, variant).otherwise("full_pipeline").alias("cleaning_algorithm"),
                (F.lit(0.5) + (key % 50).cast("double") / 100).alias("quality_score"),
                F.col("o_orderdate").alias("cleaned_at"),
            )
        )

    @cached_property
    def data_quality_scores(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("cleaned_data_id"),
            (F.lit(1.0) - F.col("l_discount")).alias("score"),
            F.col("l_returnflag").alias("algorithm"),
            F.col("l_shipdate").alias("scored_at"),
        )

    @cached_property
    def ai_predictions(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % 25).cast("int").alias("sector_id"),
            F.col("event_type").alias("prediction_type"),
            (F.col("value") / 500).alias("confidence"),
            F.col("ts").alias("predicted_at"),
        )

    @cached_property
    def ai_recommendations(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 10 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("prediction_id"),
            F.col("text").alias("recommendation_text"),
            F.col("role").alias("explanation"),
        )

    @cached_property
    def feedback_logs(self) -> DataFrame:
        return (
            self.table("events")
            .where(F.col("event_type").isin("error", "click"))
            .select(
                F.col("event_id").alias("id"),
                "user_id",
                (F.col("event_id") % self.rows("orders")).alias("data_id"),
                F.when(F.col("event_type") == "error", "correction").otherwise("validation").alias("feedback_type"),
                F.col("props").alias("feedback_data"),
                F.col("ts").alias("feedback_at"),
            )
        )

    @cached_property
    def company_reports(self) -> DataFrame:
        return (
            self.table("documents")
            .join(self.table("customer"), F.col("doc_id") % self.rows("customer") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("doc_id").alias("id"),
                (F.col("doc_id") % self.rows("customer")).alias("created_by"),
                F.col("n_regionkey").alias("company_id"),
                F.col("source").alias("title"),
                F.col("lang").alias("report_type"),
            )
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        """Orders made dirty in a fixed way: missing prices and priorities, junk tokens, outliers, repeats."""
        key = F.col("o_orderkey")
        price = F.col("o_totalprice")
        dirty = self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            F.when(key % 10 == 3, None).when(key % 97 == 5, price * 20).otherwise(price).alias("o_totalprice"),
            F.when(key % 13 == 4, None)
            .when(key % 17 == 6, " N/A ")
            .otherwise(F.col("o_orderpriority"))
            .alias("o_orderpriority"),
            "o_orderstatus",
            "o_orderdate",
        )
        # One scan: each repeated order is emitted twice by exploding a short array.
        copies = F.when(key % 20 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return dirty.withColumn("_copy", F.explode(copies)).drop("_copy")
