"""A random forest for regression over counted rows.

A forest sees a row only through the bins of its features, so rows that agree in all bins and in the target are counted
once and kept as one. A bootstrap draws each row a Poisson(1) number of times; for n equal rows that is one draw from
Poisson(n), made once for each tree. Levels of all trees grow together: a task adds up its rows by node, feature and bin,
Spark adds up the tasks and picks the best splits, and the driver sees one row for each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise

MAX_BINS = 32
MAX_DEPTH = 5
# Bytes of sums a task holds; trees beyond it wait for another pass.
TASK_BYTES = 64 << 20


@dataclass
class Forest:
    """Trees as heaps: node k has the children 2k and 2k + 1; a feature of -1 marks a leaf."""

    feature: np.ndarray
    first: np.ndarray  # the first bin that goes right
    prediction: np.ndarray
    importance: list[float]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Mean prediction of all trees for each row of bins."""
        total = np.zeros(len(bins))
        for feature, first, prediction in zip(self.feature, self.first, self.prediction):
            node = np.ones(len(bins), dtype=np.int64)
            for _ in range(MAX_DEPTH):
                node = _down(bins, node, feature, first)
            total += prediction[node]
        return total / len(self.feature)


def _down(bins: np.ndarray, node: np.ndarray, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The child of each row's node; a row in a leaf stays."""
    f = feature[node]
    right = bins[np.arange(len(bins)), np.maximum(f, 0)] >= first[node]
    return np.where(f >= 0, 2 * node + right, node)


def thresholds(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """The least values of all bins but the first, for each feature: at quantiles, and the largest value."""
    shares = [i / (MAX_BINS - 1) for i in range(1, MAX_BINS - 1)]
    cuts = df.agg(*[
        F.concat(F.array(F.min(f)), F.percentile_approx(f, shares), F.array(F.max(f))).alias(f"c{i}") for i, f in enumerate(features)
    ]).first()
    return [sorted({v for v in c[1:] if v is not None and v > c[0] and math.isfinite(v)}) for c in cuts]


def binned_counts(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], others: Sequence[str]) -> DataFrame:
    """(bins, others..., n): the rows that agree in all bins and in the other columns, counted."""
    cut = [(f, f"_bin{i}", [-math.inf, *c, math.inf]) for i, (f, c) in enumerate(zip(features, cuts)) if c]
    if cut:
        names, outs, splits = (list(part) for part in zip(*cut))
        df = Bucketizer(splitsArray=splits, inputCols=names, outputCols=outs).transform(df)
    keys = [(F.col(f"_bin{i}") if c else F.lit(0)).cast("int").alias(f"_key{i}") for i, c in enumerate(cuts)]
    counted = df.groupBy(*keys, *others).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.array(*[f"_key{i}" for i in range(len(cuts))]).alias("bins"), *others, "n")


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _draw(batches: Iterator[pa.RecordBatch], trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds to each row how often each tree has drawn it."""
    rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
    for batch in batches:
        drawn = rng.poisson(batch.column("n").to_numpy()[:, None], (batch.num_rows, trees))
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * trees
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(drawn.reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), lists], names=["bins", "y", "drawn"])


def _sums(
    batches: Iterator[pa.RecordBatch], trees: range, level: int, feature: np.ndarray, first: np.ndarray, offered: np.ndarray, origin: float
) -> Iterator[pa.RecordBatch]:
    """(tree, node, feature, bin, w, s, q): drawn rows, and sums of the target and of its square, both from ``origin``."""
    nodes, k = 1 << level, offered.shape[2]
    sums = np.zeros((len(trees), 3, nodes * k * MAX_BINS))
    for batch in batches:
        if not batch.num_rows:
            continue
        bins, drawn = _matrix(batch.column("bins"), batch.num_rows), _matrix(batch.column("drawn"), batch.num_rows)
        y = batch.column("y").to_numpy() - origin
        for i, t in enumerate(trees):
            node = np.ones(len(bins), dtype=np.int64)
            for _ in range(level):
                node = _down(bins, node, feature[t], first[t])
            at = np.flatnonzero((node >= nodes) & (drawn[:, t] > 0))
            node, w, v = node[at] - nodes, drawn[at, t].astype(float), y[at]
            for j in range(k):
                place = (node * k + j) * MAX_BINS + bins[at, offered[t, node, j]]
                for p, weights in enumerate((w, w * v, w * v * v)):
                    sums[i, p] += np.bincount(place, weights, sums.shape[2])
    tree, place = np.nonzero(sums[:, 0])
    if len(tree):
        at, node = np.asarray(trees)[tree], place // (k * MAX_BINS)
        f = offered[at, node, place // MAX_BINS % k]
        columns = [at, node + nodes, f, place % MAX_BINS, *(sums[tree, p, place] for p in range(3))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i < 4 else pa.float64()) for i, c in enumerate(columns)], names=["tree", "node", "feature", "bin", "w", "s", "q"]
        )


def _best_splits(sums: DataFrame) -> DataFrame:
    """One row per tree and node: its sums, and the split that lowers the variance most, ties to the first feature and bin."""
    whole = Window.partitionBy("tree", "node", "feature")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    added = sums.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "wsq"])
    cut = added.withColumns({f"all_{c}": F.sum(c).over(whole) for c in "wsq"} | {f"left_{c}": F.sum(c).over(before) for c in "wsq"})

    def spread(side: str):
        return F.col(f"{side}_q") - F.col(f"{side}_s") * F.col(f"{side}_s") / F.col(f"{side}_w")

    cut = cut.withColumns({f"right_{c}": F.col(f"all_{c}") - F.col(f"left_{c}") for c in "wsq"})
    gain = F.coalesce(spread("all") - spread("left") - spread("right"), F.lit(0.0))  # nothing lies before the first bin
    order = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    kept = F.struct(gain.alias("gain"), "feature", "bin", "left_w", "left_s", "right_w", "right_s", "all_w", "all_s", "all_q")
    return cut.groupBy("tree", "node").agg(F.max_by(kept, order).alias("best")).select("tree", "node", "best.*")


def fit(counted: DataFrame, features: int, trees: int, seed: int) -> Forest:
    """Fit on (bins, y, n): each node is offered a random third of the features, and splits while the variance falls."""
    keys = [F.col("bins"), F.col("y")]
    # In a fixed order, so that the same rows draw the same numbers.
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition(parts, *keys).sortWithinPartitions(*keys)
    bags = materialise(dealt.mapInArrow(partial(_draw, trees=trees, seed=seed), "bins array<int>, y double, drawn array<long>"))
    origin = counted.agg(F.sum(F.col("y") * F.col("n")) / F.sum("n")).first()[0]
    rng, offers = np.random.default_rng(seed), math.ceil(features / 3)
    size = 2 << MAX_DEPTH
    forest = Forest(np.full((trees, size), -1), np.zeros((trees, size), dtype=np.int64), np.full((trees, size), origin), [])
    gains = np.zeros((trees, features))
    for level in range(MAX_DEPTH):
        nodes = 1 << level
        offered = np.argsort(rng.random((trees, nodes, features)), axis=2)[:, :, :offers]
        share = max(1, TASK_BYTES // (3 * 8 * nodes * offers * MAX_BINS))
        found = []
        for start in range(0, trees, share):
            some = range(start, min(start + share, trees))
            add = partial(_sums, trees=some, level=level, feature=forest.feature, first=forest.first, offered=offered, origin=origin)
            sums = bags.mapInArrow(add, "tree long, node long, feature long, bin long, w double, s double, q double")
            found += _best_splits(sums).collect()
        for r in found:
            t, node = r["tree"], r["node"]
            forest.prediction[t, node] = origin + r["all_s"] / r["all_w"]
            if r["gain"] <= 1e-12 * r["all_q"]:  # nothing but rounding
                continue
            forest.feature[t, node], forest.first[t, node] = r["feature"], r["bin"]
            gains[t, r["feature"]] += r["gain"]
            for child, side in ((2 * node, "left"), (2 * node + 1, "right")):
                forest.prediction[t, child] = origin + r[f"{side}_s"] / r[f"{side}_w"]
    totals = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).sum(axis=0)
    forest.importance = [float(v) for v in shares / (shares.sum() or 1.0)]
    return forest


def _predicted(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            guess = forest.predict(_matrix(batch.column("bins"), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("n"), pa.array(guess)], names=["y", "n", "prediction"])


def predict(counted: DataFrame, forest: Forest) -> DataFrame:
    """(y, n, prediction) of counted rows."""
    return counted.select("bins", "y", "n").mapInArrow(partial(_predicted, forest=forest), "y double, n long, prediction double")
