import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import arima, descent, recursive, series, smoothing


def frame(spark, seed=1, sizes=((1, 400), (2, 90), (None, 60), (4, 5))):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in sizes:
        y = 50 + np.cumsum(rng.normal(0, 1, n)) + 8 * np.sin(np.arange(n) * np.pi / 6)
        rows += [(key, int(t), float(v)) for t, v in enumerate(y)]
    rng.shuffle(rows)
    return spark.createDataFrame(
        [(None if k is None else int(k), int(t), float(v)) for k, t, v in rows], "k bigint, t bigint, v double"
    )


def small_limits(monkeypatch, rows=50, chunk=40):
    monkeypatch.setattr(series, "SERIES_ROWS", rows)
    monkeypatch.setattr(series, "CHUNK_ROWS", chunk)


def sorted_rows(df):
    return sorted(df.collect(), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def test_position_by_range_equals_window(spark, monkeypatch):
    df = frame(spark)
    plain = sorted_rows(series.with_position(df, ["k"], ["t"]))
    small_limits(monkeypatch)
    assert sorted_rows(series.with_position(df, ["k"], ["t"])) == plain
    assert all(r["_pos"] == r["t"] for r in plain)


@pytest.mark.parametrize("keys", [["k"], []])
def test_chunked_frames_equal_window(spark, monkeypatch, keys):
    df = frame(spark).withColumn("o", F.coalesce("k", F.lit(0)) * 10_000 + F.col("t"))
    one = df.withColumn("all", F.lit(1))  # a table without keys is one series
    plain = sorted_rows(series.reduce_noise(one, ["v"], ["o"], keys or ["all"]).drop("all"))
    trailing = sorted_rows(series.moving_averages(one, keys or ["all"], ["o"], "v").drop("all"))
    small_limits(monkeypatch)
    assert sorted_rows(series.reduce_noise(df, ["v"], ["o"], keys)) == plain
    assert sorted_rows(series.moving_averages(df, keys, ["o"], "v")) == trailing


def test_noise_reduction_matches_pandas(spark):
    df = frame(spark, sizes=((1, 40),))
    got = series.reduce_noise(df, ["v"], ["t"], ["k"]).toPandas().sort_values("t")["v"].to_numpy()
    want = df.toPandas().sort_values("t")["v"].rolling(5, center=True).mean().to_numpy()
    np.testing.assert_allclose(got, want)


def test_trend_matches_pandas(spark):
    df = frame(spark)
    got = {r["k"]: r for r in series.trend_anomaly(df, ["k"], ["t"], "v").collect()}
    pdf = df.toPandas().sort_values("t")
    for key, n in ((1, 400), (2, 90)):
        v = pdf[pdf["k"] == key]["v"].reset_index(drop=True)
        assert got[key]["ma_short"] == pytest.approx(v.rolling(7).mean().iloc[-1])
        assert got[key]["ma_long"] == pytest.approx(v.rolling(30).mean().iloc[-1])
        z = np.abs((v - v.mean()) / v.std(ddof=0))
        assert got[key]["anomaly_count"] == int((z > 3).sum())
    assert 4 not in got  # five values are too few


def test_linear_forecast(spark):
    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") * 3.0 + 2).alias("v"))
    rows = series.forecast_linear(df, ["k"], ["t"], "v", 3).orderBy("step").collect()
    assert [round(r["forecast"], 9) for r in rows] == [62.0, 65.0, 68.0]
    assert rows[0]["confidence"] == pytest.approx(1.0)


def filtered(y, phi, theta):
    """(twice the negative log likelihood, squared error, last error over its variance) by a filter row by row."""
    w = np.diff(y)
    r, hat = (1 + 2 * phi * theta + theta**2) / (1 - phi**2), 0.0
    weighted = logs = plain = 0.0
    for x in w:
        u = x - hat
        weighted, logs, plain, last = weighted + u * u / r, logs + np.log(r), plain + u * u, u / r
        hat, r = phi * x + theta / r * u, 1 + theta**2 - theta**2 / r
    return len(w) * np.log(weighted / len(w)) + logs, plain, last


def arima_path(y, phi, theta):
    w, out, level = np.diff(y), [], y[-1]
    dw = phi * w[-1] + theta * filtered(y, phi, theta)[2]
    for _ in range(4):
        level += dw
        out.append(level)
        dw *= phi
    return out


@pytest.mark.parametrize("chunk", [10_000, 30])
def test_arima_is_the_exact_likelihood(spark, monkeypatch, chunk):
    monkeypatch.setattr(arima.Arima, "chunk_rows", chunk)
    monkeypatch.setattr(descent, "FAN_IN", 4)
    if chunk < 100:
        small_limits(monkeypatch)
        monkeypatch.setattr(descent, "STEPS", 8)
    df = frame(spark)
    got = recursive.forecast_arima(df, ["k"], ["t"], "v", 4).toPandas()
    pdf = df.toPandas().sort_values("t")
    grid = np.tanh(np.linspace(-2.2, 2.2, 15))
    for key in (1, 2, None):
        mine = (got[got["k"].isna()] if key is None else got[got["k"] == key]).sort_values("step")
        y = (pdf[pdf["k"].isna()] if key is None else pdf[pdf["k"] == key])["v"].to_numpy()
        phi, theta = mine["phi"].iloc[0], mine["theta"].iloc[0]
        best, error, _ = filtered(y, phi, theta)
        assert best <= min(filtered(y, a, b)[0] for a in grid for b in grid) + 1e-2
        np.testing.assert_allclose(mine["forecast"], arima_path(y, phi, theta), rtol=1e-7)
        sure = max(0.1, min(1.0, (1 - error / ((y[1:] - y[1:].mean()) ** 2).sum() + 1) / 2))
        assert mine["confidence"].iloc[0] == pytest.approx(sure, rel=1e-6)
    assert set(got["k"].dropna()) == {1, 2}


def test_summaries_equal_the_filter_row_by_row():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=190))
    pos, w = np.arange(190), np.append(np.nan, np.diff(y))
    before = np.append(np.nan, w[:-1])
    pairs = [(0.5, 0.3), (-0.7, 0.9), (0.0, 0.0), (0.99, -0.99), (0.2, -0.95)]
    free = np.arctanh(np.array([pairs]))
    parts = arima.summarise(pos, w, before, np.arange(0, 190, 40), np.repeat(free, 5, axis=0))
    total = parts[:, :, :1]
    for k in range(1, 5):
        total = arima.merge(total, parts[:, :, k : k + 1])
    found = arima.Arima().objective(total.transpose(1, 2, 0), np.array([190]))[:, 0]
    np.testing.assert_allclose(found, [filtered(y, *pair)[0] for pair in pairs], rtol=1e-9)
    np.testing.assert_allclose(total[5, :, 0], [filtered(y, *pair)[1] for pair in pairs], rtol=1e-9)


def smoothed(y, alpha, gamma):
    """(squared error, next season) of the recursion row by row."""
    level = np.mean(y[:12])
    season = list(np.array(y[:12]) - level)
    sse = 0.0
    for t in range(12, len(y)):
        e = y[t] - level - season[t % 12]
        sse += e * e
        level += alpha * e
        season[t % 12] += gamma * e
    return sse, [level + season[(len(y) + h) % 12] for h in range(4)]


@pytest.mark.parametrize("chunk", [9_996, 36])
def test_seasonal_smoothing_is_never_worse_than_the_grid(spark, monkeypatch, chunk):
    monkeypatch.setattr(smoothing.Smoothing, "chunk_rows", chunk)
    monkeypatch.setattr(descent, "FAN_IN", 4)
    if chunk < 100:
        small_limits(monkeypatch)
        monkeypatch.setattr(descent, "STEPS", 8)
    df = frame(spark)
    got = recursive.forecast_seasonal(df, ["k"], ["t"], "v", 4).toPandas()
    pdf = df.toPandas().sort_values("t")
    grid = [k / 10 for k in range(1, 10)]
    for key in (1, 2, None):
        mine = (got[got["k"].isna()] if key is None else got[got["k"] == key]).sort_values("step")
        y = (pdf[pdf["k"].isna()] if key is None else pdf[pdf["k"] == key])["v"].to_numpy()
        error, path = smoothed(y, mine["alpha"].iloc[0], mine["gamma"].iloc[0])
        assert error <= min(smoothed(y, a, g)[0] for a in grid for g in grid) * (1 + 1e-9)
        np.testing.assert_allclose(mine["forecast"], path, rtol=1e-8)
        sure = max(0.1, min(1.0, (1 - error / ((y[12:] - y[12:].mean()) ** 2).sum() + 1) / 2))
        assert mine["confidence"].iloc[0] == pytest.approx(sure, rel=1e-6)
    assert set(got["k"].dropna()) == {1, 2}


def test_stretches_of_smoothing_merge_to_the_whole():
    rng = np.random.default_rng(5)
    y = 5 + rng.normal(size=131) + np.tile(np.arange(12), 11)[:131]
    model, free = smoothing.Smoothing(), np.array([[(0.3, -1.0), (-2.0, 2.0), (5.0, -5.0)]])
    pos = np.arange(131)
    total = None
    for at in range(0, 131, 36):
        part = model.stretch(pos[at : at + 36], [y[at : at + 36]], free)
        total = part if total is None else model.merge(total, part)
    np.testing.assert_allclose(model.total(total), model.whole(pos, [y], free), rtol=1e-9, atol=1e-9)
    for (a, g), found in zip(smoothing.logistic(free[0]), model.whole(pos, [y], free)[:, 0, 0]):
        assert found == pytest.approx(smoothed(y, a, g)[0], rel=1e-9)


def test_arima_recovers_known_parameters(spark):
    rng = np.random.default_rng(7)
    n, phi, theta = 4000, 0.6, 0.3
    e = rng.normal(0, 1, n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(n), "v": np.cumsum(w)}))
    row = recursive.forecast_arima(df, ["k"], ["t"], "v", 1).first()
    assert abs(row["phi"] - phi) < 0.06 and abs(row["theta"] - theta) < 0.06
