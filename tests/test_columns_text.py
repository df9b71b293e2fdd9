
import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns, text
from tidewell.operators import structure
from tidewell.operators.keywords import keywords


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_selectors(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert columns.numeric_columns(df) == ["i", "d"]
    assert columns.numeric_columns(df, ("i",)) == ["d"]
    assert columns.text_columns(df) == ["s"]


def test_normalise_names():
    assert columns.normalise_names([" A-b ", "a b", "***", "A__B", "é1"]) == ["a_b", "a_b_2", "column", "a_b_3", "1"]


@pytest.mark.parametrize("value, want", [("Héllo, Wörld! ", "héllo wörld"), (" A_1\t", "a_1"), ("  !! ", ""), (None, None)])
def test_clean_text(spark, value, want):
    assert one(spark, value, text.clean_text) == want


@pytest.mark.parametrize("value, want", [(" R&D / Ops ", "r_d_ops"), ("---", "unknown"), (None, "unknown")])
def test_sector_key(spark, value, want):
    assert one(spark, value, text.sector_key) == want


@pytest.mark.parametrize("value, want", [(" Data-Analyst", "data_analyst"), ("SALES MANAGER", "sales_manager"), ("boss", ""), (None, "")])
def test_role(spark, value, want):
    assert one(spark, value, text.normalise_role) == want


@pytest.mark.parametrize("value, want", [("Company_07 ", 7), ("company_", None), ("xcompany_1", None), (None, None)])
def test_company_code(spark, value, want):
    assert one(spark, value, text.company_code) == want


@pytest.mark.parametrize("value, want", [("a__sector__b__sector__c", "b__sector__c"), ("plain", "all"), ("x__sector__", "")])
def test_sector_label(spark, value, want):
    assert one(spark, value, text.sector_label) == want


def test_intent_takes_the_first_match(spark):
    assert one(spark, "Forecast the TREND", text.query_intent) == "trend_analysis"
    assert one(spark, "predict risk", text.query_intent) == "forecasting"
    assert one(spark, "hello", text.query_intent) == "help"
    assert one(spark, "clean the chart", text.chat_topic) == "cleaning"


def test_json_safe_reaches_nested_values(spark):
    df = spark.sql(
        "SELECT double('NaN') AS a, array(1D, double('Infinity')) AS b, named_struct('x', double('-Infinity'), 'y', 'k') AS c,"
        " map('m', double('NaN'), 'n', 2D) AS d, 3 AS e"
    )
    row = columns.json_safe(df).first()
    assert row["a"] is None and row["b"] == [1.0, None] and tuple(row["c"]) == (None, "k")
    assert row["d"] == {"m": None, "n": 2.0} and row["e"] == 3


def test_clamp_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "v double")
    assert [r[0] for r in rows.select(columns.clamp(F.col("v"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


def test_structure(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 1, "b": "x"}', ["u"], "t"), (2, "junk", [], "{}"), (3, None, None, '{"a": ')],
        "Id int, Info string, Tags array<string>, Other string",
    )
    out = structure.structure(df)
    assert out.columns == ["id", "tags", "info_a", "info_b"]  # Other holds an empty object, so it expands to nothing
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, '["u"]', 1, "x"), (2, "[]", None, None), (3, None, None, None)]
    assert dict(out.dtypes)["info_a"] == "bigint"


def test_structs_expand(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 2, 'b', 'z') AS s")
    assert structure.structure(df).columns == ["id", "s_a", "s_b"]


def test_sector_split(spark):
    many = spark.createDataFrame([("North ", 1), (None, 2), ("", 3)], "department string, v int")
    got = {r["v"]: r["sector_key"] for r in structure.with_sector_key(many).collect()}
    assert got == {1: "north", 2: "unknown", 3: "unknown"}
    single = spark.createDataFrame([("a", 1), ("a", 2)], "my_sector string, v int")
    assert {r["sector_key"] for r in structure.with_sector_key(single).collect()} == {"all"}
    assert {r["sector_key"] for r in structure.with_sector_key(spark.range(2)).collect()} == {"all"}
    rows = structure.sector_variants(many, "x", 0.5).collect()
    assert {(r["label"], r["algorithm"], r["row_count"]) for r in rows} == {
        ("all", "x", 3), ("north", "x__sector__north", 1), ("unknown", "x__sector__unknown", 2)
    }


def test_keywords(spark):
    texts = [(1, "Data data; the DATA of sales, sales! naïve the")] + [(k, f"the w{k} w{k + 1}") for k in range(2, 12)] + [(12, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    rows = keywords(df, "id", "t", 2).where("id = 1").collect()
    assert {(r["term"], r["uses"]) for r in rows} == {("data", 3), ("sales", 2)}
