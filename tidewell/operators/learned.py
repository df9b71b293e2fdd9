"""A small neural regression that learns from batches of ordered rows and can go on from where it stopped.

The network is a linear part plus one hidden layer. A batch is a stretch of positions; a step on it is one job in which
every partition returns the gradient and the curvature of its rows (by backpropagation), summed place by place. What earlier
batches taught stays as a quadratic prior on the weights, so that going on with new rows is the same as one run over the
same batches. The state is a handful of numbers, stored by version.

Batches grow with the position, from ``FIRST`` rows to ``LARGEST``: the number of jobs grows with the logarithm of a
history, later with its size over ``LARGEST``. Rows of an unfinished batch wait, unless the caller closes the history.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col
from tidewell.session import discard, materialise

HIDDEN = 6
FIRST, LARGEST = 1 << 14, 1 << 20  # rows of a batch
STEPS = 6  # most jobs spent on a batch
RIDGE = 1.0  # prior precision of the weights before the first batch
FORGET = 1.0  # share of the prior kept at each batch; below 1 old batches fade
ENOUGH = 1e-5  # relative fall of the loss at which a batch is done


@dataclass(frozen=True)
class NetState:
    """Everything that learning needs to go on. ``position`` is the first one that has not been learned."""

    inputs: tuple[str, ...]
    position: int
    rows: int
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    precision: np.ndarray
    version: int = 0

    @property
    def hidden(self) -> int:
        n = len(self.inputs)
        return (len(self.weights) - n - 1) // (n + 2)


def new_state(inputs: Sequence[str], hidden: int = HIDDEN, seed: int = 7) -> NetState:
    n = len(inputs)
    size = n + 1 + hidden * (n + 2)
    weights = np.zeros(size)
    # only the hidden layer's own weights differ, or its units would stay alike
    weights[n + 1 : n + 1 + hidden * (n + 1)] = np.random.default_rng(seed).normal(0, 0.7, hidden * (n + 1))
    return NetState(tuple(inputs), 0, 0, np.zeros(n), np.zeros(n), weights, RIDGE * np.eye(size))


def batch_size(position: int) -> int:
    """Rows of the batch that begins at ``position``."""
    return min(max(position, FIRST), LARGEST)


def _batch_number(position: Column, start: int) -> Column:
    """The number of the batch that holds a position, for batches that begin at ``start``."""
    begins = [start]
    while batch_size(begins[-1]) < LARGEST:
        begins.append(begins[-1] + batch_size(begins[-1]))
    number = F.lit(len(begins) - 1) + F.floor((position - begins[-1]) / LARGEST)  # batches of one size from here on
    for k in range(len(begins) - 1, 0, -1):
        number = F.when(position < begins[k], F.lit(k - 1)).otherwise(number)
    return number.cast("bigint")


def _split(weights: np.ndarray, n: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """(linear weights, bias, hidden weights, hidden biases, output weights)."""
    hidden = (len(weights) - n - 1) // (n + 2)
    at = n + 1
    inner = weights[at : at + hidden * n].reshape(hidden, n)
    at += hidden * n
    return weights[:n], weights[n], inner, weights[at : at + hidden], weights[at + hidden :]


def forward(weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, derivative of each prediction by each weight) for standardised inputs."""
    n = x.shape[1]
    linear, bias, inner, offsets, outer = _split(weights, n)
    units = np.tanh(x @ inner.T + offsets)
    back = (1 - units * units) * outer  # by backpropagation, the share of each hidden unit
    slopes = np.concatenate(
        [x, np.ones((len(x), 1)), (back[:, :, None] * x[:, None, :]).reshape(len(x), -1), back, units], axis=1
    )
    return x @ linear + bias + units @ outer, slopes


def _tree_sum(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all tasks of ``part(matrix of a batch)``, of ``size`` numbers; tasks add up place by place."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(np.column_stack([c.to_numpy(zero_copy_only=False).astype("f8") for c in batch.columns]))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    sums = rows.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("at", "sum"))
    out = np.zeros(size)
    for at, value in sums.groupBy("at").agg(F.sum("sum")).collect():
        out[at] = value
    return out


def learn(
    rows: DataFrame, state: NetState, target: str, position: str, close: bool = False
) -> NetState:
    """The state after all further batches that ``rows`` complete, and with ``close`` after the rest as well.

    ``position`` numbers the rows in their order; positions below the state's own have been learned and are skipped. Rows
    with a gap in an input or the target count for the position only. A state that has learned nothing new keeps its
    version.
    """
    known = F.col("_at") >= state.position
    columns = [col(c).cast("double").alias(f"x{k}") for k, c in enumerate(state.inputs)]
    picked = rows.select(col(position).cast("bigint").alias("_at"), *columns, col(target).cast("double").alias("y"))
    end = picked.agg(F.max("_at")).first()[0]
    if end is None or end < state.position:
        return state
    # A folder for each batch, so that a step reads its own files only, however long the history is.
    numbered = picked.where(known).dropna().withColumn("_batch", _batch_number(F.col("_at"), state.position))
    table = materialise(numbered.repartitionByRange("_batch", "_at"), folders=("_batch",))
    begun = state
    for number in itertools.count():
        stop = state.position + batch_size(state.position)
        if stop > end + 1:
            if not close or state.position > end:
                break
            stop = end + 1
        batch = table.where(F.col("_batch") == number).drop("_batch", "_at")
        state = replace(_learn_batch(batch, state), position=stop)
    discard(table)
    return replace(state, version=begun.version + 1) if state.position > begun.position else begun


def _learn_batch(batch: DataFrame, state: NetState) -> NetState:
    n, size = len(state.inputs), len(state.weights)
    if state.rows == 0:  # the first batch sets the scale of the inputs for good
        moments = batch.agg(
            F.count(F.lit(1)), *[f(f"x{k}") for f in (F.avg, F.stddev_pop) for k in range(n)]
        ).first()
        if not moments[0]:
            return state
        scales = np.array(moments[1 + n :])
        state = replace(state, means=np.array(moments[1 : 1 + n]), scales=np.where(scales > 0, scales, 1.0))
    means, scales = state.means, state.scales

    def sums_at(weights: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        def part(matrix: np.ndarray) -> np.ndarray:
            guess, slopes = forward(weights, (matrix[:, :n] - means) / scales)
            off = matrix[:, n] - guess
            return np.concatenate([[len(off), off @ off], slopes.T @ off, (slopes.T @ slopes).ravel()])

        total = _tree_sum(batch, part, 2 + size + size * size)
        return int(total[0]), total[1], total[2 : 2 + size], total[2 + size :].reshape(size, size)

    prior, anchor = FORGET * state.precision, state.weights

    def loss(weights: np.ndarray, squares: float) -> float:
        return squares + (weights - anchor) @ prior @ (weights - anchor)

    weights, damping = anchor, 1e-3
    count, squares, slope, curve = sums_at(weights)
    now = loss(weights, squares)
    for _ in range(STEPS - 1):
        full = curve + prior
        uphill = slope - prior @ (weights - anchor)
        tried = weights + np.linalg.solve(full + damping * np.diag(np.diag(full)), uphill)
        _, more, tried_slope, tried_curve = sums_at(tried)
        then = loss(tried, more)
        if then < now:
            done = now - then <= ENOUGH * now
            weights, slope, curve, now, damping = tried, tried_slope, tried_curve, then, damping / 10
            if done:
                break
        else:
            damping *= 10
    return replace(state, rows=state.rows + count, weights=weights, precision=prior + curve)


def predict(rows: DataFrame, state: NetState, name: str = "prediction") -> DataFrame:
    """Adds the network's value as one expression over the inputs; null where an input is."""
    linear, bias, inner, offsets, outer = _split(state.weights, len(state.inputs))
    scaled = [
        (col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))
        for c, m, s in zip(state.inputs, state.means, np.where(state.scales > 0, state.scales, 1.0))
    ]

    def dot(weights: np.ndarray, start: float) -> Column:
        total = F.lit(float(start))
        for w, x in zip(weights, scaled):
            total = total + F.lit(float(w)) * x
        return total

    value = dot(linear, bias)
    for w, row, offset in zip(outer, inner, offsets):
        value = value + F.lit(float(w)) * F.tanh(dot(row, offset))
    return rows.withColumn(name, value)


# ---- stored states ----------------------------------------------------------------------------------------

STATE = (
    "model string, version int, inputs array<string>, position bigint, rows bigint, means array<double>,"
    " scales array<double>, weights array<double>, precision array<double>"
)


def save_state(store, name: str, state: NetState) -> None:
    """Append a version of a model to the store; earlier ones stay."""
    arrays = [a.ravel().tolist() for a in (state.means, state.scales, state.weights, state.precision)]
    row = (name, state.version, list(state.inputs), state.position, state.rows, *arrays)
    store.append(store.spark.createDataFrame([row], STATE), "models")


def load_state(store, name: str, version: int | None = None) -> NetState | None:
    """The newest version of a model, or the one asked for; None where there is none."""
    if not store.holds("models"):
        return None
    rows = store.read("models").where(F.col("model") == name)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).limit(1).collect()
    if not found:
        return None
    row = found[0]
    size = len(row["weights"])
    return NetState(
        tuple(row["inputs"]), row["position"], row["rows"], np.array(row["means"]), np.array(row["scales"]),
        np.array(row["weights"]), np.array(row["precision"]).reshape(size, size), row["version"],
    )
