"""Fitting two parameters of a recursion over each of many series.

A model says how to run candidates over whole series, or over stretches of a long one whose summaries merge. The search
begins on a coarse grid and goes on by damped Newton steps; derivatives are differences over a stencil of nine candidates
that share one pass. It never leaves a point for a worse one. Series that fit a stretch are fitted inside a task, many at
once; if a series is longer, every pass is a job whose summaries merge in a tree, and no task holds more than a stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.keyed import join_on, semi_on
from tidewell.session import materialise

STEPS = 11
STENCIL = 1e-3
AROUND = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) * STENCIL
FAN_IN = 200
SMALL = 1e-300


class Model:
    """What a recursion must tell. Totals are arrays of (candidates, series, ...)."""

    columns: tuple[str, ...]  # of a row, in its position's order
    least_rows: int
    chunk_rows: int  # of a stretch
    block_rows: int  # whose series run together
    limit: float  # of the free parameters
    start: np.ndarray  # first candidates, (any, 2)

    def whole(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        """Totals of consecutive whole series; ``free`` is (series, candidates, 2)."""
        raise NotImplementedError

    def stretch(self, pos: np.ndarray, values: list[np.ndarray], free: np.ndarray) -> np.ndarray:
        """The summary of one stretch; ``free`` is (1, candidates, 2), and candidates come first in the result."""
        raise NotImplementedError

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def total(self, summary: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def objective(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What is minimised: (candidates, series)."""
        raise NotImplementedError

    def result(self, point: np.ndarray, total: np.ndarray, rows: np.ndarray) -> list[list[float]]:
        raise NotImplementedError


def newton_step(values: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """The steps (series, 2) that nine values around each point (9, series) suggest."""
    f = values.reshape(3, 3, -1)
    slope = np.stack([f[2, 1] - f[0, 1], f[1, 2] - f[1, 0]]) / (2 * STENCIL)
    aa = (f[2, 1] - 2 * f[1, 1] + f[0, 1]) / STENCIL**2
    bb = (f[1, 2] - 2 * f[1, 1] + f[1, 0]) / STENCIL**2
    ab = (f[2, 2] - f[2, 0] - f[0, 2] + f[0, 0]) / (4 * STENCIL**2)
    # lift the curvature until it is positive, so that steps lead down
    middle, apart = (aa + bb) / 2, np.hypot((aa - bb) / 2, ab)
    lift = np.maximum(0.0, 1e-3 * (np.abs(middle) + apart) + 1e-9 - (middle - apart)) + damping
    aa, bb = aa + lift, bb + lift
    determinant = aa * bb - ab * ab
    step = np.stack([bb * slope[0] - ab * slope[1], aa * slope[1] - ab * slope[0]]) / determinant
    size = np.maximum(np.abs(step).max(axis=0), SMALL)
    return -(step * np.minimum(1.0, 0.4 / size)).T


class Search:
    """The points of many series on their way to the optimum; ``ask`` names the candidates of the next pass."""

    def __init__(self, series: int, start: np.ndarray, limit: float):
        self.start, self.limit = start, limit
        self.point = np.zeros((series, 2))
        self.value = np.full(series, np.inf)
        self.damping = np.zeros(series)
        self.begun = False

    def ask(self) -> np.ndarray:
        """(series, candidates, 2)"""
        if not self.begun:
            return np.broadcast_to(self.start, (len(self.point), *self.start.shape))
        return self.trial[:, None, :] + AROUND

    def tell(self, values: np.ndarray) -> None:
        """The objective at the candidates asked for: (candidates, series)."""
        if not self.begun:
            self.trial, self.begun = self.start[values.argmin(axis=0)].copy(), True
            return
        now = values[4]
        better = now <= self.value
        self.point[better], self.value[better] = self.trial[better], now[better]
        step = newton_step(values, self.damping)
        scale = np.abs(self.value) + 1.0
        self.damping = np.where(better, self.damping / 10, np.maximum(10 * self.damping, 0.1 * scale))
        # a point that got worse goes half the way back
        self.trial = np.where(better[:, None], self.trial + step, (self.point + self.trial) / 2)
        self.trial = np.clip(self.trial, -self.limit, self.limit)

    def pack(self) -> bytes:
        trial = self.trial[0] if self.begun else [np.nan, np.nan]
        return np.array([*self.point[0], self.value[0], self.damping[0], float(self.begun), *trial]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, model: Model) -> "Search":
        a, b, value, damping, begun, *trial = np.frombuffer(raw)
        search = cls(1, model.start, model.limit)
        search.point, search.value, search.damping = np.array([[a, b]]), np.array([value]), np.array([damping])
        if begun:
            search.begun, search.trial = True, np.array([trial])
        return search


def fit_whole(model: Model, pos: np.ndarray, values: list[np.ndarray]) -> list[list[float]]:
    """Fits of consecutive whole series."""
    rows = np.diff(np.append(np.flatnonzero(pos == 0), len(pos)))
    search = Search(len(rows), model.start, model.limit)
    for _ in range(STEPS):
        search.tell(model.objective(model.whole(pos, values, search.ask()), rows))
    return model.result(search.point, model.whole(pos, values, search.point[:, None, :]), rows)


def _blocks(batches: Iterable[pa.RecordBatch], rows_wanted: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole series, of about ``rows_wanted`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        for begin in np.flatnonzero(_column(batch, "_pos") == 0).tolist():
            if rows + begin - at >= rows_wanted:
                held.append(batch.slice(at, begin - at))
                yield _joined(held)
                held, rows, at = [], 0, begin
        held.append(batch.slice(at))
        rows += batch.num_rows - at
    if rows:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def fit_series(placed: DataFrame, keys: Sequence[str], model: Model) -> DataFrame:
    """(keys, fit): the best parameters of each series of ``placed`` (keys, _pos, the model's columns) with enough rows."""
    keys = list(keys)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= model.least_rows)
    enough = materialise(sizes)
    fields = [placed.schema[k] for k in keys]
    fitted = T.StructType([*fields, T.StructField("fit", T.ArrayType(T.DoubleType()))])
    chunk = F.floor(F.col("_pos") / model.chunk_rows).cast("bigint")
    chunked = semi_on(placed, enough, keys).withColumn("chunk", chunk)
    # The work per row is large and the rows are small, so partitions must not be merged by their bytes.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunked.repartition(tasks, *keys, "chunk").sortWithinPartitions(*keys, "chunk", "_pos")
    longest = enough.agg(F.max("points")).first()[0] or 0
    if longest > model.chunk_rows:
        return _fit_long(materialise(spread), enough, keys, longest, fitted, model)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, model.block_rows):
            pos = _column(block, "_pos")
            fits = fit_whole(model, pos, [_column(block, c) for c in model.columns])
            first = pa.array(np.flatnonzero(pos == 0))
            columns = [block.column(block.schema.get_field_index(k)).take(first) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fits, pa.list_(pa.float64()))], [*keys, "fit"])

    return spread.mapInArrow(whole, fitted)


def _fit_long(
    stretches: DataFrame, sizes: DataFrame, keys: list[str], longest: int, fitted: T.StructType, model: Model
) -> DataFrame:
    """The same search with a job for each pass: summaries of stretches merge in a tree, series by series."""
    fields = [sizes.schema[k] for k in keys]
    state_type = T.StructType([*fields, T.StructField("points", T.LongType()), T.StructField("state", T.BinaryType())])
    part_type = T.StructType([
        *fields, T.StructField("chunk", T.LongType()), T.StructField("candidates", T.IntegerType()),
        T.StructField("summary", T.BinaryType()),
    ])

    def array(raw: bytes, candidates: int) -> np.ndarray:
        return np.frombuffer(raw).reshape(candidates, -1)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[*keys, "points"]].assign(state=[Search(1, model.start, model.limit).pack()] * len(frame))

    def evaluate(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:  # rows of one stretch
            frame = frame.sort_values("_pos")
            search = Search.unpack(frame["state"].iloc[0], model)
            free = search.point[:, None, :] if last else search.ask()
            found = model.stretch(frame["_pos"].to_numpy(), [frame[c].to_numpy() for c in model.columns], free)
            return frame.iloc[:1][[*keys, "chunk"]].assign(candidates=[len(found)], summary=[found.tobytes()])

        return run

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw, candidates in frame.sort_values("chunk")[["summary", "candidates"]].itertuples(index=False):
            part = array(raw, candidates)
            total = part if total is None else model.merge(total, part)
        out = frame.iloc[:1][[*keys, "_group"]].rename(columns={"_group": "chunk"})
        return out.assign(candidates=[len(total)], summary=[total.tobytes()])

    def totals(state: DataFrame, last: bool) -> DataFrame:
        parts = join_on(stretches, state, keys).groupBy(*keys, "chunk").applyInPandas(evaluate(last), part_type)
        left = (longest - 1) // model.chunk_rows
        while left > 0:
            grouped = materialise(parts).withColumn("_group", F.floor(F.col("chunk") / FAN_IN).cast("bigint"))
            parts = grouped.groupBy(*keys, "_group").applyInPandas(combine, part_type)
            left //= FAN_IN
        return parts.drop("chunk")

    def told(frame: pd.DataFrame) -> Iterator[tuple[Search, np.ndarray, np.ndarray]]:
        for raw, summary, candidates, points in zip(frame["state"], frame["summary"], frame["candidates"], frame["points"]):
            yield Search.unpack(raw, model), model.total(array(summary, candidates)), np.array([points])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = []
            for search, total, rows in told(frame):
                search.tell(model.objective(total, rows))
                states.append(search.pack())
            yield frame[[*keys, "points"]].assign(state=states)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keys].assign(fit=[model.result(search.point, total, rows)[0] for search, total, rows in told(frame)])

    state = materialise(sizes.mapInPandas(begin, state_type))
    for _ in range(STEPS):
        state = materialise(join_on(state, totals(state, False), keys).mapInPandas(learn, state_type), replaces=state)
    return join_on(state, totals(state, True), keys).mapInPandas(finish, fitted)
