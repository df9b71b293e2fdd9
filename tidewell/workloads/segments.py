"""Registered queries: segments, density outliers and nearest-neighbour imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import neighbours, segment
from tidewell.workloads.registry import query

EPS = 2.0
NEAR = """(a.p_size - b.p_size) * (a.p_size - b.p_size)
        + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)"""


def parts(data):
    return data.table("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


@query("kmeans_segments")
def _(data):
    return segment.kmeans_segments(parts(data), 3, ["p_size", "p_retailprice"])


@query(
    "kmeans_all_rows",
    """SELECT p_partkey % 7 = 0 AS lacks_size, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS in_cluster
    FROM part GROUP BY 1""",
)
def _(data):
    gaps = parts(data).withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    found = segment.kmeans_segments(gaps, 3, ["p_size", "p_retailprice"])
    placed = F.count_if(F.col("cluster").between(0, 2)).alias("in_cluster")
    return found.groupBy(F.col("p_size").isNull().alias("lacks_size")).agg(F.count("*").alias("n"), placed)


@query(
    "dbscan_core",
    f"""SELECT a.p_partkey FROM part a JOIN part b ON {NEAR} <= {EPS} * {EPS}
    GROUP BY a.p_partkey HAVING count(*) >= 5""",
)
def _(data):
    return segment.core_points(parts(data), "p_partkey", ["p_size", "p_retailprice"], EPS, 5)


@query(
    "dbscan_labels",
    f"""WITH RECURSIVE near AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON {NEAR} <= {EPS} * {EPS}),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 5),
    edge AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
    reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
    label AS (SELECT a, min(b) AS l FROM reach GROUP BY 1),
    best AS (SELECT n.a, coalesce(max(own.l), min(l.l)) AS l FROM near n JOIN label l ON l.a = n.b
        LEFT JOIN label own ON own.a = n.a GROUP BY 1)
    SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, coalesce(l, -1) AS outlier FROM part LEFT JOIN best ON a = p_partkey""",
)
def _(data):
    return segment.dbscan(parts(data), "p_partkey", ["p_size", "p_retailprice"], EPS, 5)


WIDE = """p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(p_partkey % 7 AS DOUBLE) AS c,
    CAST(p_partkey % 3 AS DOUBLE) AS d, CAST(p_partkey % 11 AS DOUBLE) AS e FROM part)"""
WIDE_NEAR = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in "abcde")


@query(
    "dbscan_five_columns",
    f"""WITH RECURSIVE {WIDE}, near AS (SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON {WIDE_NEAR} <= 81),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 4),
    edge AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
    reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
    label AS (SELECT a, min(b) AS l FROM reach GROUP BY 1),
    best AS (SELECT n.a, coalesce(max(own.l), min(l.l)) AS l FROM near n JOIN label l ON l.a = n.b
        LEFT JOIN label own ON own.a = n.a GROUP BY 1)
    SELECT k, p.a, p.b, c, d, e, coalesce(l, -1) AS outlier FROM p LEFT JOIN best ON best.a = k""",
)
def _(data):
    key = F.col("p_partkey")
    wide = parts(data).select(
        key.alias("k"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"),
        *[(key % n).cast("double").alias(name) for n, name in ((7, "c"), (3, "d"), (11, "e"))],
    )
    return segment.dbscan(wide, "k", eps=9.0, min_points=4)


@query(
    "impute_knn",
    """WITH d AS (SELECT * FROM raw_orders WHERE o_totalprice IS NOT NULL),
    r AS (SELECT DISTINCT o_orderkey, o_custkey FROM raw_orders WHERE o_totalprice IS NULL),
    n AS (SELECT r.o_orderkey, d.o_totalprice FROM r, d QUALIFY row_number() OVER (PARTITION BY r.o_orderkey ORDER BY
        (r.o_orderkey - d.o_orderkey) * (r.o_orderkey - d.o_orderkey) + (r.o_custkey - d.o_custkey) * (r.o_custkey - d.o_custkey),
        d.o_orderkey, d.o_custkey, d.o_totalprice) <= 5),
    f AS (SELECT o_orderkey, avg(o_totalprice) AS fill FROM n GROUP BY 1)
    SELECT r.o_orderkey, r.o_custkey, round(coalesce(o_totalprice, fill), 4) AS o_totalprice
    FROM raw_orders r LEFT JOIN f ON f.o_orderkey = r.o_orderkey""",
)
def _(data):
    df = data.raw_orders.select("o_orderkey", "o_custkey", "o_totalprice")
    filled = neighbours.impute_knn(df, ["o_orderkey", "o_custkey", "o_totalprice"])
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


def _gap_sql(column: str) -> str:
    """The five nearest values for the gaps of one column of t, by brute force."""
    shared = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in "xyz")
    apart = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in "xyz")
    place = ", ".join(f"CASE WHEN a.{c} IS NOT NULL THEN b.{c} END" for c in "xyz")
    return f"""SELECT k, '{column}' AS j, avg(v) AS v FROM (SELECT a.k, b.{column} AS v FROM t a, t b
        WHERE a.{column} IS NULL AND b.{column} IS NOT NULL AND ({shared}) > 0
        QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY ({apart}) * 3.0 / ({shared}),
            list_filter([{place}], lambda e: e IS NOT NULL), b.{column}) <= 5) GROUP BY 1"""


@query(
    "impute_knn_three_columns",
    f"""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS x,
        CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS y, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 50 AS DOUBLE) END AS z FROM part),
    f AS ({_gap_sql('x')} UNION ALL {_gap_sql('y')} UNION ALL {_gap_sql('z')})
    SELECT k, {', '.join(f"round(coalesce(t.{c}, (SELECT v FROM f WHERE f.k = t.k AND j = '{c}'), (SELECT avg({c}) FROM t)), 4) AS {c}" for c in 'xyz')} FROM t""",
)
def _(data):
    key = F.col("p_partkey")
    gaps = parts(data).select(
        key.alias("k"), F.when(key % 5 != 0, F.col("p_size")).alias("x"), F.when(key % 7 != 0, F.col("p_retailprice")).alias("y"),
        F.when(key % 11 != 0, (key % 50).cast("double")).alias("z"),
    )
    filled = neighbours.impute_knn(gaps, ["x", "y", "z"])
    return filled.withColumns({c: F.round(c, 4) for c in "xyz"})
