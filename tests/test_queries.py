import pytest

import __spark_entry__ as entry
from tests.oracle import compare, open_duckdb
from tidewell.workloads.registry import query

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, name, FOLDER, entry.queries(), entry.oracle_sql())
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_names_are_unique():
    with pytest.raises(ValueError):
        query("error_profile")(lambda data: None)


CHEAP = [
    "impute_mean", "outlier_clip", "duplicate_count", "scoped_raw_data", "predictions_in_scope", "trend_anomaly",
    "top5_predictions_per_sector", "report_metrics", "moving_averages", "forecast_linear", "rank_sectors",
]


@pytest.mark.parametrize("name", CHEAP)
def test_plans_stay_distributed(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    for unwanted in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:  # only the merge of partial aggregates
            assert not any(" Window " in above for above in lines[max(0, i - 3) : i])


def test_top_n_limits_before_the_shuffle(spark):
    df = entry.queries()["top5_predictions_per_sector"](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert plan.index("WindowGroupLimit") > 0 and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["sectors_in_company"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
