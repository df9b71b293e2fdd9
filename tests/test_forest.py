"""The forest on counted rows, beside MLlib's on plain rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidewell.operators import predict


def risks(spark, rows: int):
    """A step in a, a slope in b, nothing in c."""
    rng = np.random.default_rng(7)
    a, b, c = rng.integers(0, 6, rows), rng.uniform(0, 1, rows), rng.uniform(0, 1, rows)
    y = (a >= 3) * 2.0 + b + rng.normal(0, 0.2, rows)
    data = [(k, *map(float, r)) for k, r in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double")


def test_forest_is_as_good_as_the_library(spark):
    df = risks(spark, 4000)
    got = predict.predict_risk(df, ["a", "b", "c"], "y", ["id"]).collect()
    split = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(predict.train_share(df, ["id"]))
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=100, seed=42, subsamplingRate=1.0).fit(split.where("is_train"))
    error = F.sum(F.pow(F.col("y") - F.col("prediction"), 2))
    want = model.transform(split.where("NOT is_train")).agg(F.avg("prediction"), 1 - error / (F.var_pop("y") * F.count("y"))).first()
    assert [r["feature"] for r in got] == ["a", "b", "c"]
    np.testing.assert_allclose([r["importance"] for r in got], model.featureImportances.toArray(), atol=0.06)
    assert sum(r["importance"] for r in got) == pytest.approx(1)
    assert got[0]["predicted_risk"] == pytest.approx(want[0], abs=0.02)
    assert got[0]["test_score"] == pytest.approx(want[1], abs=0.03) and want[1] > 0.8


def test_forest_work_does_not_grow_with_equal_rows(spark, monkeypatch):
    seen, fit = [], predict.forest.fit

    def counting(counted, *args, **kwargs):
        seen.append(counted.agg(F.count("*"), F.sum("n")).first())
        return fit(counted, *args, **kwargs)

    monkeypatch.setattr(predict.forest, "fit", counting)
    few = risks(spark, 300).withColumn("y", (F.col("y") > 2).cast("double")).withColumn("b", F.round("b", 1)).withColumn("c", F.lit(1.0))
    many = few.crossJoin(spark.range(20).select(F.col("id").alias("again")))
    # The same rows train in every copy.
    for df in (few, many):
        found = predict.predict_risk(df, ["a", "b", "c"], "y", ["id"], trees=10).collect()
        assert found[2]["importance"] == 0 and found[0]["test_score"] > 0.5
    assert seen[1][0] == seen[0][0] and seen[1][1] == 20 * seen[0][1]


def test_forest_on_one_target_value(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(0.1).alias("y"))
    found = predict.predict_risk(df, ["x"], "y", ["id"], trees=3).first()
    assert found["predicted_risk"] == pytest.approx(0.1) and found["test_score"] is None and found["importance"] == 0
