import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import clean, profile, quantiles, structure


@pytest.fixture
def dirty(spark):
    rows = [(1, 1.0, "a"), (2, None, " N/A "), (3, 3.0, None), (3, 3.0, None), (4, 100.0, "a"), (5, 2.0, "b"), (6, 2.5, "a")]
    return spark.createDataFrame(rows, "id int, v double, t string")


def test_error_profile(dirty):
    got = {r["metric"]: r["value"] for r in profile.error_profile(dirty).collect()}
    assert got == {
        "rows": 7, "columns": 3, "total_cells": 21, "quality_score": round(18 / 21 * 100, 2),
        "Missing Values": 3, "Outliers": 1, "Invalid Formats": 1, "Duplicate Rows": 1,
    }


def test_profiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    got = {r["metric"]: r["value"] for r in profile.error_profile(empty).collect()}
    assert got["rows"] == 0 and got["quality_score"] == 0 and got["Duplicate Rows"] == 0
    assert profile.cleaning_improvement(empty, empty).first()["cleaned_percent"] == 0
    assert clean.impute(empty).count() == 0 and clean.clip_outliers(empty).count() == 0
    assert clean.normalise(empty).count() == 0 and clean.correct_types(empty).count() == 0


def test_duplicates(spark, dirty):
    assert profile.duplicate_count(dirty).first()[0] == 1
    nulls = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None), (None, None)], "x string, y string")
    assert profile.duplicate_count(nulls).first()[0] == 2


def test_skew_matches_pandas(spark):
    v = np.random.default_rng(0).gamma(2, 1, 50)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "c": 1.0}))
    want = pd.DataFrame({"v": v, "c": 1.0}).skew().mean()
    assert profile.data_characteristics(df).first()["skewness"] == pytest.approx(want, abs=1e-5)


def test_impute(dirty):
    rows = {r["id"]: r for r in clean.impute(dirty, "median", exclude=("id",)).collect()}
    assert rows[2]["v"] == pytest.approx(2.75) and rows[3]["t"] == "a"
    with pytest.raises(ValueError):
        clean.impute(dirty, "guess")


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert clean.column_modes(df, ["t"]) == {"t": "a"}


def test_clip_and_scale(spark):
    v = np.random.default_rng(1).normal(0, 1, 101)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "c": 7.0}))
    clipped = clean.clip_outliers(df)
    got = np.sort(clipped.toPandas()["v"])
    np.testing.assert_allclose(got, np.sort(np.clip(v, np.quantile(v, 0.05), np.quantile(v, 0.95))))
    scaled = clean.normalise(df).agg(F.min("v"), F.max("v"), F.max("c")).first()
    assert tuple(scaled) == (0.0, 1.0, 0.0)
    z = clean.standardise(df).toPandas()
    assert abs(z["v"].mean()) < 1e-9 and z["v"].std(ddof=0) == pytest.approx(1) and (z["c"] == 0).all()


def test_correct_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2024-01-02 03:04:05", "x", None), (" 2", "-2e3", "2024-01-03", "1", None)],
        "i string, d string, t string, m string, n string",
    )
    assert [t for _, t in clean.correct_types(df).dtypes] == ["bigint", "double", "timestamp_ntz", "string", "string"]


def test_every_value_decides_the_type(spark):
    df = spark.createDataFrame([("1",), ("2",), ("oops",)], "v string").coalesce(1)
    assert clean.correct_types(df).dtypes == [("v", "string")]


def test_rules_keep_null(dirty):
    out = clean.apply_rules(dirty, {"v": clean.RangeRule(0.0, 5.0), "t": clean.RegexRule("[/N]"), "zz": clean.RangeRule(0, 1)})
    rows = {r["id"]: r for r in out.collect()}
    assert rows[2]["v"] is None and rows[4]["v"] == 5.0 and rows[2]["t"] == " A " and rows[3]["t"] is None


def test_reference_checks(spark, dirty):
    listed = spark.createDataFrame([("a",), ("a",)], "x string")
    assert clean.keep_referenced(dirty, {"t": listed, "none": listed}).count() == 3
    bad = clean.reference_violations(dirty, {"t": listed})
    assert bad.count() == 4 and {r["violations"] for r in bad.collect()} == {"t"}
    with_null = spark.createDataFrame([("a",), (None,)], "x string")
    assert clean.keep_referenced(dirty, {"t": with_null}).count() == 5


def test_integrate_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(None, "m"), (2, "y"), (1, "z"), (1, "w")], "k int, v string")
    got = {tuple(r) for r in clean.integrate([a, b], "k").collect()}
    assert got == {(1, "x", "z"), (1, "x", "w"), (None, "n", "m"), (2, None, "y")}
    assert clean.integrate([a], "k") is a


def values(kind):
    rng = np.random.default_rng(2)
    if kind == "smooth":
        return rng.normal(0, 1, 5000)
    if kind == "ties":  # one value holds most rows
        return np.concatenate([np.full(4000, 3.0), rng.uniform(0, 10, 1000)])
    return np.repeat([1.0, 2.0], [2500, 2500])


@pytest.mark.parametrize("kind", ["smooth", "ties", "two"])
def test_narrowed_quantiles_are_exact(spark, monkeypatch, kind):
    v = values(kind)
    monkeypatch.setattr(quantiles, "RANKED_VALUES", 20)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 200)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": -v * 2, "g": np.arange(len(v)) % 3})).repartition(4)
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = quantiles.column_quantiles(df, ["v", "w"], probs)
    np.testing.assert_allclose(got["v"], np.quantile(v, probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(-v * 2, probs), rtol=1e-12)
    names = [f"q{i}" for i in range(len(probs))]
    grouped = quantiles.grouped_quantiles(df, ["g"], "v", probs, names).collect()
    for row in grouped:
        np.testing.assert_allclose(list(row)[1:], np.quantile(v[np.arange(len(v)) % 3 == row["g"]], probs), rtol=1e-12)
    assert len(grouped) == 3


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, "x", '{"a.b": 1}'), (None, "x", None), (3.0, None, "{}"), (3.0, None, "{}")], "`p.q` double, `t``x` string, `j.s` string")
    assert profile.duplicate_count(df).first()[0] == 1
    assert {r["metric"]: r["value"] for r in profile.error_profile(df).collect()}["Missing Values"] == 4
    filled = clean.impute(df.drop("j.s"), "median")
    assert [tuple(r) for r in filled.orderBy("`p.q`").collect()][0] == (1.0, "x") and filled.where("`p.q` IS NULL").isEmpty()
    assert clean.normalise(df).agg({"`p.q`": "max"}).first()[0] == 1.0
    assert clean.standardise(df).columns == df.columns and clean.clip_outliers(df).columns == df.columns
    assert clean.flag_outliers(df, "zscore", ["p.q"]).columns[-1] == "p.q_outlier"
    out = structure.expand_json(df)
    assert out.columns == ["p.q", "t`x", "j.s_a.b"] and out.agg(F.sum("`j.s_a.b`")).first()[0] == 1


def test_json_types_come_from_the_merged_schema(spark):
    cells = [
        '{"n": 1, "d": 1.5, "s": "12", "t": "2024-01-02", "mix": 1, "o": {"x": [1, 2], "y": null}, "b": true, "z": null}',
        ' {"n": 20, "d": 2, "s": "7", "t": "2024-01-03 04:05:06", "mix": "a", "l": [1, {"q": "w"}], "big": 123456789012345678901}',
        "{broken", "no object", None, "{}", '["list"]',
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    out = structure.expand_json(df)
    assert dict(out.dtypes) == {
        "c_n": "bigint", "c_d": "double", "c_s": "bigint", "c_t": "timestamp_ntz", "c_mix": "string", "c_o": "string",
        "c_b": "string", "c_z": "string", "c_l": "string", "c_big": "double",
    }
    rows = out.collect()
    assert len(rows) == 7 and [r["c_n"] for r in rows][:2] == [1, 20] and rows[0]["c_mix"] == "1" and rows[0]["c_b"] == "true"
    assert json.loads(rows[0]["c_o"]) == {"x": [1, 2], "y": None} and json.loads(rows[1]["c_l"]) == [1, {"q": "w"}]
    assert all(v is None for r in rows[2:] for v in r)
    raw = structure.expand_json(df, typed=False)
    assert {t for _, t in raw.dtypes} == {"string"} and raw.first()["c_d"] == "1.5"
    assert structure.expand_json(df.where("c = 'no object'")).columns == ["c"]


def test_objects_that_name_a_key_twice(spark):
    df = spark.createDataFrame([('{"a": 1, "a": 2, "only": "x"}',), ('{"a": 3}',)], "c string")
    out = structure.expand_json(df)
    assert out.columns == ["c_a", "c_only"] and sorted((r[0], r[1]) for r in out.collect()) == [(1, "x"), (3, None)]


def test_types_of_text_columns(spark):
    rows = [(" 12 ", "1e3", "2024", "2024-01-02T03:04:05", "", "12", "+5", "\u30001.5", "x"), ("-7", ".5", "2024-02-03", "1999-12-31", None, "1,2", "05", "2", "1")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    kinds = dict(clean.correct_types(df).dtypes)
    assert kinds == {"a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "timestamp_ntz", "e": "string", "f": "string", "g": "bigint", "h": "double", "i": "string"}


def test_a_json_key_takes_the_place_of_a_column_of_its_name(spark):
    df = spark.createDataFrame([('{"k": 5}', "old")], "p string, p_k string")
    assert [tuple(r) for r in structure.expand_json(df).collect()] == [(5,)]
    maps = structure.json_maps(df, ["p"]).first()
    assert maps["p"] == {"k": "5"} and maps["p_k"] == "old"


def test_integrate_reads_each_source_in_proportion(spark):
    frames = [spark.createDataFrame([(i, i * k) for i in range(k, k + 3)], "id bigint, v bigint") for k in range(1, 5)]
    out = clean.integrate(frames, "id")
    assert out.columns == ["id", "v", "v_2", "v_3", "v_4"] and sorted(r["id"] for r in out.collect()) == [1, 2, 3, 4, 5, 6]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4  # both sides of the last join, twice


@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_narrowed_quantiles_are_confirmed(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "RANKED_VALUES", 50)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in (1, 2, None) for v in np.round(rng.normal(size=600 if k == 1 else 40), 1)]
    df = spark.createDataFrame(rows, "k int, `v.x` double")
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    names = ["a", "b", "c", "d", "e"]
    for row in quantiles.grouped_quantiles(df, ["k"], "v.x", probs, names).collect():
        want = np.quantile([v for k, v in rows if k == row["k"]], probs)
        np.testing.assert_allclose([row[n] for n in names], want, atol=1e-9)
    got = quantiles.column_quantiles(df, ["v.x"], probs)["v.x"]
    np.testing.assert_allclose(got, np.quantile([v for _, v in rows], probs), atol=1e-9)


def test_a_poor_sketch_is_found_out(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED_VALUES", 10)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    poor = lambda column, shares, accuracy: F.array(*[F.max(column) + 1e6] * len(shares))
    monkeypatch.setattr(quantiles.F, "percentile_approx", poor)
    df = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in range(101)], "k int, v double")
    found = quantiles.grouped_quantiles(df, ["k"], "v", (0.25, 0.5), ("q", "m")).collect()
    assert sorted((r["k"], r["q"], r["m"]) for r in found) == [(1, 25.0, 50.0), (2, 25.0, 50.0)]
    assert quantiles.column_quantiles(df, ["v"], (0.25, 0.501))["v"] == [25.0, 50.0]


def test_brackets_keep_ranked_groups_small(spark, monkeypatch):
    """Every ranked group holds the values of one narrowed bracket, whatever the size of the column or group."""
    monkeypatch.setattr(quantiles, "RANKED_VALUES", 200)
    rng = np.random.default_rng(5)
    v = np.where(rng.random(20_000) < 0.4, 7.25, rng.normal(7, 3, 20_000))  # one value holds two fifths of the rows
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": rng.integers(0, 9, 20_000), "k": rng.random(20_000) < 0.9}))
    df = df.withColumn("e", F.lit(None).cast("double"))
    probs = (0.01, 0.25, 0.5, 0.9)
    spans = []
    real = quantiles._rank
    monkeypatch.setattr(quantiles, "_rank", lambda values, spots: (spans.extend(s.inside for s in spots.values()), real(values, spots)))
    got = quantiles.column_quantiles(df, ["v", "w", "e"], probs)
    np.testing.assert_allclose(got["v"], np.quantile(v, probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], df.agg(F.percentile("w", list(probs))).first()[0])
    assert got["e"] is None and max(spans, default=0) <= 200
    frame = df.toPandas()
    for row in quantiles.grouped_quantiles(df, ["k"], "v", probs, list("abcd")).collect():
        np.testing.assert_allclose(list(row)[1:], np.quantile(frame.v[frame.k == row["k"]], probs), rtol=1e-12)
    whole = quantiles.grouped_quantiles(df, [], "v", probs, list("abcd")).collect()
    np.testing.assert_allclose(list(whole[0]), np.quantile(v, probs), rtol=1e-12)
