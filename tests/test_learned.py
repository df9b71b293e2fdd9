import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewell.operators import history, learned
from tidewell.session import new_path
from tidewell.sources.store import DatasetStore
from tidewell.workloads import QUERIES


def curved(n, seed=0):
    """A target that no linear model can follow."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + 0.2 * x[:, 0] + rng.normal(0, 0.05, n)
    return pd.DataFrame({"at": np.arange(n), "a": x[:, 0] * 3 + 5, "b": x[:, 1], "y": y})


@pytest.fixture(autouse=True)
def small_batches(monkeypatch):
    monkeypatch.setattr(learned, "FIRST", 128)
    monkeypatch.setattr(learned, "LARGEST", 1024)


def plain_batch(frame, state):
    """One batch in one array, with the same rules."""
    x, y = frame[list(state.inputs)].to_numpy(), frame["y"].to_numpy()
    means, scales = (x.mean(axis=0), x.std(axis=0)) if not state.rows else (state.means, state.scales)
    x = (x - means) / scales
    anchor, prior = state.weights, learned.FORGET * state.precision

    def at(weights):
        guess, slopes = learned.forward(weights, x)
        off, pull = y - guess, weights - anchor
        return off @ off + pull @ prior @ pull, slopes.T @ off - prior @ pull, slopes.T @ slopes

    weights, damping = anchor, 1e-3
    now, uphill, curve = at(weights)
    for _ in range(learned.STEPS - 1):
        full = curve + prior
        tried = weights + np.linalg.solve(full + damping * np.diag(np.diag(full)), uphill)
        then, tried_uphill, tried_curve = at(tried)
        if then < now:
            done = now - then <= learned.ENOUGH * now
            weights, now, uphill, curve, damping = tried, then, tried_uphill, tried_curve, damping / 10
            if done:
                break
        else:
            damping *= 10
    return learned.NetState(
        state.inputs, int(frame["at"].max()) + 1, state.rows + len(y), means, scales, weights, prior + curve
    )


def test_slopes_are_derivatives():
    state = learned.new_state(("a", "b", "c"), hidden=4)
    rng = np.random.default_rng(1)
    weights, x = state.weights + rng.normal(0, 0.3, len(state.weights)), rng.normal(size=(5, 3))
    _, slopes = learned.forward(weights, x)
    for k in range(len(weights)):
        step = np.zeros(len(weights))
        step[k] = 1e-6
        near = (learned.forward(weights + step, x)[0] - learned.forward(weights - step, x)[0]) / 2e-6
        np.testing.assert_allclose(slopes[:, k], near, atol=1e-7)


def test_learning_equals_plain_batches_and_goes_on(spark):
    frame = curved(1400)
    rows = spark.createDataFrame(frame).repartition(5)
    whole = learned.learn(rows, learned.new_state(("a", "b")), "y", "at")
    plain = learned.new_state(("a", "b"))
    while plain.position + learned.batch_size(plain.position) <= 1400:
        stop = plain.position + learned.batch_size(plain.position)
        plain = plain_batch(frame[(frame["at"] >= plain.position) & (frame["at"] < stop)], plain)
    assert whole.position == plain.position == 1024 and whole.rows == 1024 and whole.version == 1
    np.testing.assert_allclose(whole.weights, plain.weights, rtol=1e-6, atol=1e-8)
    first = learned.learn(rows.where("at < 600"), learned.new_state(("a", "b")), "y", "at")
    assert first.position == 512  # the rest of the second batch waits
    again = learned.learn(rows.where("at >= 300"), first, "y", "at")
    assert again.position == 1024 and again.version == 2
    np.testing.assert_allclose(again.weights, whole.weights, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(again.precision, whole.precision, rtol=1e-6, atol=1e-6)
    closed = learned.learn(rows, again, "y", "at", close=True)
    assert closed.position == 1400 and learned.learn(rows, closed, "y", "at") is closed


def test_a_batch_reads_its_own_folder(spark, monkeypatch):
    seen = []

    def look(batch, state):
        plan = batch._jdf.queryExecution().executedPlan().toString()
        seen.append(("PartitionFilters: [isnotnull(_batch" in plan, batch.count()))
        return state

    monkeypatch.setattr(learned, "_learn_batch", look)
    rows = spark.createDataFrame(curved(4000))
    learned.learn(rows, learned.new_state(("a", "b")), "y", "at", close=True)
    position, sizes = 0, []
    while position < 4000:
        sizes.append(min(learned.batch_size(position), 4000 - position))
        position += sizes[-1]
    assert seen == [(True, n) for n in sizes]


def test_the_hidden_layer_beats_a_linear_model_on_unseen_rows(spark):
    rows = spark.createDataFrame(curved(4000))
    train, test = rows.where("at < 3200"), rows.where("at >= 3200")
    state = learned.learn(train, learned.new_state(("a", "b")), "y", "at", close=True)
    parts = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    linear = LinearRegression(featuresCol="x", labelCol="y").fit(parts.transform(train)).transform(parts.transform(test))
    error = lambda df: df.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    found = learned.predict(test, state)
    assert error(found) < 0.05 * error(linear)
    pandas = found.toPandas()
    want, _ = learned.forward(state.weights, (pandas[["a", "b"]].to_numpy() - state.means) / state.scales)
    np.testing.assert_allclose(pandas["prediction"], want, rtol=1e-9, atol=1e-9)


def test_gaps_and_constant_inputs(spark):
    rows = [(k, 1.0, None if k % 5 == 0 else float(k % 3), 2.0 * (k % 3)) for k in range(300)] + [(300, None, None, None)]
    df = spark.createDataFrame(rows, "`a.t` bigint, same double, v double, y double")
    state = learned.learn(df, learned.new_state(("same", "v")), "y", "a.t", close=True)
    assert state.rows == 240 and state.position == 301
    found = learned.predict(df, state).where("v IS NOT NULL").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert found < 0.2 and learned.predict(df.where("v IS NULL"), state).agg(F.count("prediction")).first()[0] == 0
    empty = learned.new_state(("same", "v"))
    assert learned.learn(df.where("false"), empty, "y", "a.t") is empty


def test_quality_net_is_stored_by_version(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(rng.uniform(0.4, 1)), "NRA"[k % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(500)]
    scores = spark.createDataFrame(rows, "cleaned_data_id bigint, score double, algorithm string, scored_at timestamp_ntz")
    store = DatasetStore(spark, new_path(spark, "models"))
    assert learned.load_state(store, "quality") is None
    early = history.quality_features(scores.where("cleaned_data_id < 300"))
    assert history.continue_quality_net(history.quality_features(scores.limit(7)), ("N", "R", "A"), store) is None
    first = history.continue_quality_net(early, ("N", "R", "A"), store)
    later = history.quality_features(scores)
    last = history.continue_quality_net(later, ("N", "R", "A"), store, close=True)
    assert (first.version, first.position, last.version, last.position) == (1, 256, 2, 500)
    again = learned.load_state(store, "quality")
    assert again.version == 2 and np.array_equal(again.weights, last.weights)
    assert learned.load_state(store, "quality", version=1).position == 256
    once = history.continue_quality_net(later, ("N", "R", "A"), close=True)
    np.testing.assert_allclose(once.weights, last.weights, rtol=1e-6, atol=1e-8)
    ranked = history.rank_candidates(later, ("N", "R", "A"), last).collect()
    assert len(ranked) == 3 and all(0 <= r["predicted_quality"] <= 1 for r in ranked)


def test_quality_model_reads_stored_features(spark):
    out = QUERIES["quality_model"](spark, "/root/testdata/sf0.001")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
