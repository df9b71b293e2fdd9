"""Registered queries: cleaning steps, projections and structuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns, text
from tidewell.operators import clean, structure
from tidewell.workloads.registry import query

IDS = ("o_orderkey", "o_custkey")
OTHER = "o_orderkey, o_custkey, o_orderstatus, o_orderdate"
FILLED_PRIORITY = """coalesce(o_orderpriority, (SELECT o_orderpriority FROM raw_orders WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority"""


def rounded(df, *names, places=4):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("remove_duplicates", "SELECT DISTINCT * FROM raw_orders")
def _(data):
    return clean.remove_duplicates(data.raw_orders)


for _strategy in ("mean", "median"):
    _stat = "avg" if _strategy == "mean" else "median"

    @query(
        f"impute_{_strategy}",
        f"""SELECT {OTHER}, round(coalesce(o_totalprice, (SELECT {_stat}(o_totalprice) FROM raw_orders)), 4)
            AS o_totalprice, {FILLED_PRIORITY} FROM raw_orders""",
    )
    def _(data, strategy=_strategy):
        return rounded(clean.impute(data.raw_orders, strategy, exclude=IDS), "o_totalprice")


@query("impute_mode", f"SELECT {OTHER}, o_totalprice, {FILLED_PRIORITY} FROM raw_orders")
def _(data):
    return clean.impute(data.raw_orders, exclude=[*IDS, "o_totalprice"])


@query(
    "outlier_clip",
    f"""WITH b AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM raw_orders)
    SELECT {OTHER}, o_orderpriority, CASE WHEN o_totalprice IS NOT NULL THEN
        round(least(greatest(o_totalprice, lo), hi), 4) END AS o_totalprice FROM raw_orders, b""",
)
def _(data):
    return rounded(clean.clip_outliers(data.raw_orders, exclude=IDS), "o_totalprice")


@query(
    "outlier_flags_iqr",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM raw_orders)
    SELECT r.*, coalesce(o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1), false)
        AS o_totalprice_outlier FROM raw_orders r, q""",
)
def _(data):
    return clean.flag_outliers(data.raw_orders, "iqr", ["o_totalprice"])


@query(
    "outlier_flags_z",
    """WITH q AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM raw_orders)
    SELECT r.*, coalesce(abs(o_totalprice - m) / s > 3, false) AS o_totalprice_outlier FROM raw_orders r, q""",
)
def _(data):
    return clean.flag_outliers(data.raw_orders, "zscore", ["o_totalprice"])


@query(
    "normalize_minmax",
    f"""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM raw_orders)
    SELECT {OTHER}, o_orderpriority, round((o_totalprice - lo) / (hi - lo), 8) AS o_totalprice FROM raw_orders, b""",
)
def _(data):
    return rounded(clean.normalise(data.raw_orders, exclude=IDS), "o_totalprice", places=8)


@query(
    "standardize_z",
    f"""WITH b AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM raw_orders)
    SELECT {OTHER}, o_orderpriority, round((o_totalprice - m) / s, 7) AS o_totalprice FROM raw_orders, b""",
)
def _(data):
    return rounded(clean.standardise(data.raw_orders, exclude=IDS), "o_totalprice", places=7)


@query(
    "correct_types",
    """SELECT o_orderkey AS key_text, o_totalprice AS price_text, o_orderdate AS date_text,
        o_orderpriority AS mixed_text FROM raw_orders""",
)
def _(data):
    as_text = data.raw_orders.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("key_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date_text"),
        F.col("o_orderpriority").alias("mixed_text"),
    )
    return clean.correct_types(as_text)


CLEAN = r"""regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\p{{Z}}\x09-\x0d\x1c-\x1f\x85]', '', 'g'),
    '^[\p{{Z}}\x09-\x0d\x1c-\x1f\x85]+|[\p{{Z}}\x09-\x0d\x1c-\x1f\x85]+$', '', 'g')"""


@query("clean_text", f"SELECT doc_id, {CLEAN.format(c='text')} AS text, {CLEAN.format(c='source')} AS source FROM documents")
def _(data):
    return clean.clean_text(data.table("documents").select("doc_id", "text", "source"))


@query(
    "rule_range",
    """SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN least(greatest(o_totalprice, 50000.0), 250000.0) END
        AS o_totalprice FROM raw_orders""",
)
def _(data):
    return clean.apply_rules(
        data.raw_orders.select("o_orderkey", "o_totalprice"), {"o_totalprice": clean.RangeRule(50000.0, 250000.0)}
    )


@query(
    "rule_regex",
    "SELECT o_orderkey, regexp_replace(o_orderpriority, '^[0-9]-', '', 'g') AS o_orderpriority FROM raw_orders",
)
def _(data):
    return clean.apply_rules(
        data.raw_orders.select("o_orderkey", "o_orderpriority"), {"o_orderpriority": clean.RegexRule("^[0-9]-")}
    )


@query(
    "ref_check_keep",
    """SELECT * FROM raw_orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        AND o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders)""",
)
def _(data):
    return clean.keep_referenced(data.raw_orders, _references(data))


def _references(data):
    return {
        "o_custkey": data.table("customer").where("c_acctbal > 0").select("c_custkey"),
        "o_orderpriority": data.table("orders").select("o_orderpriority"),
    }


@query(
    "ref_check_violations",
    """SELECT * FROM (SELECT *, concat_ws(',',
        CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'o_custkey' END,
        CASE WHEN o_orderpriority IS NULL OR o_orderpriority NOT IN (SELECT o_orderpriority FROM orders)
            THEN 'o_orderpriority' END) AS violations FROM raw_orders) WHERE violations <> ''""",
)
def _(data):
    return clean.reference_violations(data.raw_orders, _references(data))


@query(
    "integrate_sources",
    """WITH a AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY 1),
    b AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_custkey + 5 END AS k, min(c_name) AS name, count(*) AS n
        FROM customer GROUP BY 1),
    c AS (SELECT s_suppkey AS k, s_acctbal AS total FROM supplier),
    ab AS (SELECT coalesce(a.k, b.k) AS k, a.n, a.total, b.name, b.n AS n_2 FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
    SELECT coalesce(ab.k, c.k) AS k, n, ab.total, name, n_2, c.total AS total_3
    FROM ab FULL JOIN c ON ab.k IS NOT DISTINCT FROM c.k""",
)
def _(data):
    spent = (
        data.table("orders")
        .groupBy(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k"))
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    people = (
        data.table("customer")
        .groupBy(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") + 5).alias("k"))
        .agg(F.min("c_name").alias("name"), F.count("*").alias("n"))
    )
    balances = data.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("total"))
    return clean.integrate([spent, people, balances], "k")


# ---- projections and structuring ---------------------------------------------------------------------------


@query("json_expand", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events""")
def _(data):
    return structure.expand_json(data.table("events").select("event_id", "props"))


@query(
    "json_maps",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(len(json_keys(props)) AS INT) AS keys FROM events",
)
def _(data):
    maps = structure.json_maps(data.table("events").select("event_id", "props"), ["props"])
    return maps.select("event_id", F.col("props")["k"].alias("k"), F.size("props").alias("keys"))


def dotted(df):
    """The same table with dots in its column names."""
    return df.toDF(*[c.replace("_", ".", 1) for c in df.columns])


@query("dotted_json_expand", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events""")
def _(data):
    found = structure.expand_json(dotted(data.table("events").select("event_id", F.col("props").alias("pro_ps"))))
    return found.toDF("event_id", "props_k")


@query("dotted_impute", f"""SELECT {OTHER}, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM raw_orders)), 4)
    AS o_totalprice, {FILLED_PRIORITY} FROM raw_orders""")
def _(data):
    df = data.raw_orders
    filled = clean.impute(dotted(df), "mean", exclude=("o.orderkey", "o.custkey"))
    return rounded(filled.toDF(*df.columns), "o_totalprice")


@query("json_key_union", "SELECT DISTINCT 'props' AS \"column\", unnest(json_keys(props)) AS key FROM events")
def _(data):
    return structure.json_keys(data.table("events"), ["props"])


@query("array_to_json", "SELECT p_partkey, to_json(string_split(p_name, ' ')) AS words FROM part")
def _(data):
    return columns.arrays_to_json(data.table("part").select("p_partkey", F.split("p_name", " ").alias("words")))


@query("iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events")
def _(data):
    return columns.iso_timestamps(data.table("events").select("event_id", "ts"))


@query(
    "json_safe_projection",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL
        ELSE l_extendedprice END AS price, [l_discount, NULL] AS parts FROM lineitem""",
)
def _(data):
    ratio = (
        F.when(F.col("l_discount") == 0, float("nan"))
        .when(F.col("l_tax") == 0, float("inf"))
        .otherwise(F.col("l_extendedprice"))
    )
    loose = data.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio.alias("price"),
        F.array(F.col("l_discount"), F.lit(float("-inf"))).alias("parts"),
    )
    return columns.json_safe(loose)


@query(
    "normalized_columns",
    """SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS part_name_2, p_type AS "column", p_size AS size_mm,
        p_retailprice AS part_name_3 FROM part""",
)
def _(data):
    messy = data.table("part").toDF(" Part-Key ", "Part Name", "part_name", "***", "Size (mm)", "PART  NAME!")
    return columns.with_normalised_names(messy)


@query(
    "sector_key",
    """SELECT DISTINCT p_type AS raw_value, coalesce(nullif(trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_'), ''),
        'unknown') AS sector_key FROM (SELECT concat(' ', p_type, '/', p_brand, ' ') AS p_type FROM part)""",
)
def _(data):
    value = F.concat(F.lit(" "), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit(" "))
    named = data.table("part").select(value.alias("raw_value")).distinct()
    return named.withColumn("sector_key", text.sector_key(F.col("raw_value")))


@query(
    "sector_label",
    """SELECT id, cleaning_algorithm, CASE WHEN contains(cleaning_algorithm, '__sector__')
        THEN split_part(cleaning_algorithm, '__sector__', 2) ELSE 'all' END AS sector_label FROM cleaned_data""",
)
def _(data):
    return data.cleaned_data.select(
        "id", "cleaning_algorithm", text.sector_label(F.col("cleaning_algorithm")).alias("sector_label")
    )


@query(
    "normalize_role",
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN ' Data-Analyst ' WHEN 1 THEN 'SALES MANAGER' WHEN 2 THEN 'ceo'
        WHEN 3 THEN 'Admin' WHEN 4 THEN 'sector-Head' WHEN 5 THEN 'owner' END AS role FROM customer),
    n AS (SELECT *, replace(replace(lower(trim(coalesce(role, ''))), '-', '_'), ' ', '_') AS x FROM r)
    SELECT c_custkey, role, CASE WHEN x IN ('ceo', 'admin', 'data_analyst', 'sales_manager', 'sector_head') THEN x ELSE '' END
        AS normalized FROM n""",
)
def _(data):
    turn = F.col("c_custkey") % 7
    role = F.when(turn == 0, " Data-Analyst ").when(turn == 1, "SALES MANAGER").when(turn == 2, "ceo")
    role = role.when(turn == 3, "Admin").when(turn == 4, "sector-Head").when(turn == 5, "owner")
    return data.table("customer").select("c_custkey", role.alias("role")).withColumn(
        "normalized", text.normalise_role(F.col("role"))
    )


@query(
    "company_code",
    r"""WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat(' Company_0', CAST(c_nationkey AS VARCHAR), ' ')
        WHEN 1 THEN concat('company_', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS code FROM customer)
    SELECT c_custkey, code, CAST(nullif(regexp_extract(trim(code), '(?i)^company_(\d+)$', 1), '') AS INT) AS company_id FROM r""",
)
def _(data):
    turn = F.col("c_custkey") % 3
    code = (
        F.when(turn == 0, F.concat(F.lit(" Company_0"), F.col("c_nationkey").cast("string"), F.lit(" ")))
        .when(turn == 1, F.concat(F.lit("company_"), F.col("c_custkey").cast("string")))
        .otherwise(F.col("c_name"))
    )
    return data.table("customer").select("c_custkey", code.alias("code")).withColumn(
        "company_id", text.company_code(F.col("code"))
    )


def _tag_sql(table, default="help"):
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for words, label in table
    )
    return f"CASE {cases} ELSE '{default}' END"


@query(
    "query_intent",
    f"""SELECT conv_id, turn, {_tag_sql(text.QUERY_INTENTS)} AS intent, {_tag_sql(text.CHAT_TOPICS)} AS topic FROM conversations
    UNION ALL SELECT doc_id, -1, {_tag_sql(text.QUERY_INTENTS)}, {_tag_sql(text.CHAT_TOPICS)} FROM documents""",
)
def _(data):
    said = data.table("conversations").select("conv_id", "turn", "text")
    written = data.table("documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "text"
    )
    return said.unionByName(written).select(
        "conv_id", "turn", text.query_intent(F.col("text")).alias("intent"), text.chat_topic(F.col("text")).alias("topic")
    )


@query("json_array_size", """SELECT vec_id, json_array_length(to_json(embedding)) AS n FROM embeddings
    UNION ALL SELECT event_id, 0 FROM events""")
def _(data):
    lists = data.table("embeddings").select("vec_id", F.to_json("embedding").alias("doc"))
    none = data.table("events").select(F.col("event_id").alias("vec_id"), F.lit(None).cast("string").alias("doc"))
    size = F.coalesce(F.json_array_length("doc"), F.lit(0)).cast("bigint")
    return lists.unionByName(none).select("vec_id", size.alias("n"))


@query(
    "dropna_features",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM raw_orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def _(data):
    return data.raw_orders.select("o_orderkey", "o_totalprice", "o_orderpriority").na.drop(
        subset=["o_totalprice", "o_orderpriority"]
    )


@query(
    "sector_variants",
    """WITH s AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS label, count(*) AS row_count
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    u AS (SELECT 'all' AS label, CAST(sum(row_count) AS BIGINT) AS row_count FROM s UNION ALL SELECT * FROM s)
    SELECT label, CASE label WHEN 'all' THEN 'full_pipeline' ELSE concat('full_pipeline__sector__', label) END AS algorithm,
        row_count, 0.9 AS quality_score FROM u""",
)
def _(data):
    named = data.table("customer").join(data.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return structure.sector_variants(
        named.select("c_custkey", "c_acctbal", F.col("n_name").alias("sector_name")), "full_pipeline", 0.9
    )
