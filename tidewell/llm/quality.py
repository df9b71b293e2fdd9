"""Quality classifier by positive-unlabelled learning.

A linear model over character-class and word statistics minimises the non-negative unbiased risk: trusted positives
give the risk of calling good text bad, unlabelled text the risk of calling text good, from which the share that the
positives explain (their class prior times their own risk) is taken off, never below zero. Only a bounded sample of
feature rows reaches the driver; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bytes_of, named, pick, slices, spark_of

CLASSES = 24
STATS = 15
WIDTH = CLASSES + CLASSES * CLASSES + STATS
PART_BYTES = 1 << 22


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte: kinds of letters, digits, spaces and single punctuation marks."""
    table = np.zeros(256, "u1")
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[0x80:0xC0] = 4  # later bytes of a character
    table[0xC0:] = 5
    table[list(b" \t")] = 6
    table[list(b"\n\r")] = 7
    for number, marks in enumerate([b".", b",", b"!", b"?", b"#", b"$%&", b"*", b"|", b"-_", b"'\"", b"()[]{}", b"<>", b"/\\", b":;", b"@=+~^`"]):
        table[list(marks)] = 8 + number
    return table


TABLE = _class_table()


def features(text: bytes) -> np.ndarray:
    """Statistics of a whole text; all zero but the first ones for an empty text."""
    out = np.zeros(WIDTH, "f4")
    size = len(text)
    if not size:
        return out
    single, double = np.zeros(CLASSES), np.zeros(CLASSES * CLASSES)
    for start in range(0, size, PART_BYTES):  # neighbouring parts share one byte, so no pair is lost
        kinds = TABLE[np.frombuffer(text, "u1", min(PART_BYTES + 1, size - start), start)].astype("i4")
        single += np.bincount(kinds[:PART_BYTES], minlength=CLASSES)
        double += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    n, distinct = max(1, len(words)), set(words)
    repeated = sum(map(eq, words, words[1:])) / n
    lower = {word.lower() for word in distinct}
    stats = [
        np.log1p(size) / 10,
        np.log1p(n) / 10,
        len(distinct) / n,
        len(lower) / n,
        repeated,
        repeated**0.5,
        float(repeated > 0.05),
        (1 - len(distinct) / n) ** 0.5,
        (size - n) / n / 20,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(distinct) / n**0.75,
        sum(map(len, distinct)) / max(1, len(distinct)) / 20,
        float(n < 5),
        1.0,
    ]
    out[:CLASSES] = np.sqrt(single / size)
    out[CLASSES:-STATS] = np.sqrt(double / size)
    out[-STATS:] = stats
    return out


@dataclass(frozen=True)
class Model:
    """A linear model on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        value = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 250, decay: float = 1e-3) -> Model:
    """Minimise the non-negative unbiased risk under logistic loss by Adam over the full sample."""
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    p, u = (((rows - mean) / scale).astype("f4") for rows in (positive, unlabelled))
    weights, bias, rate = np.zeros(p.shape[1], "f4"), np.float32(0), 0.03
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, steps + 1):
        zp, zu = p @ weights + bias, u @ weights + bias
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        gp = -prior * sigmoid(-zp) / len(zp)
        if negative >= 0:
            gu = sigmoid(zu) / len(zu)
            gp = gp - prior * sigmoid(zp) / len(zp)
        else:  # the estimate fell below zero: undo the overfit instead of following it
            gu = -sigmoid(zu) / len(zu)
            gp = prior * sigmoid(zp) / len(zp)
        gp, gu = gp.astype("f4"), gu.astype("f4")
        slope = np.append(gp @ p + gu @ u + decay * weights, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = (weights - move[:-1]).astype("f4"), np.float32(bias - move[-1])
    return Model(mean, scale, weights.astype("f8"), float(bias), prior)


def held_out(id_column: str, folds: int = 3, fold: int = 1):
    """Whether a row belongs to the fold whose labels are never read."""
    return F.coalesce(F.crc32(named(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [features(text).tobytes() for text in bytes_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["positive", "features"])


def _smallest(rows: DataFrame, order: Column, total: int, most: int) -> DataFrame:
    """``most`` rows of smallest hash out of about ``total``.

    Only rows below the hash that about 1.2 times as many fall under are ordered, so few texts move, however many tasks
    read the table.
    """
    place = F.pmod(order, F.lit(1 << 40))
    share = min(1.0, (1.2 * most + 100) / max(total, 1))
    return rows.where(place < int(share * (1 << 40))).orderBy(place).limit(most)


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = 3000,
    unlabelled: int = 6000,
    prior: float | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> Model:
    """Fit on at most ``positives`` trusted texts (label 1) and ``unlabelled`` texts, both outside the held-out fold.

    The samples are those of smallest hash. The class prior is estimated from the labelled rows outside the held-out fold
    unless given; with no label 0 among them it is 0.5. Null ids and labels are no labels, and an id that repeats in
    ``labels`` is positive if any of its rows is. Without a positive or an unlabelled text every text scores the prior.
    """
    known = pick(labels, id=id_column, label=label_column).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("double")).alias("ones")).first()
    if prior is None:
        prior = counts["ones"] / counts["n"] if counts["n"] and 0 < counts["ones"] < counts["n"] else 0.5
    texts = pick(docs, id=id_column, text=text_column).where(~held_out("id"))
    present = known.where("label = 1").join(texts.select("id"), "id", "left_semi")
    ids = _smallest(present, F.xxhash64("id"), present.count(), positives).select("id")  # at most ``positives``
    trusted = texts.join(F.broadcast(ids), "id", "left_semi").orderBy(F.xxhash64("id", "text")).limit(positives)
    web = _smallest(texts, F.xxhash64("text", "id"), texts.count(), unlabelled)
    chosen = trusted.select(F.lit(True).alias("positive"), "text").unionByName(
        web.select(F.lit(False).alias("positive"), "text")
    )
    rows = chosen.mapInArrow(_feature_rows, "positive boolean, features binary").collect()  # the two samples at most
    sample = {True: [], False: []}
    for row in rows:
        sample[row["positive"]].append(np.frombuffer(row["features"], "f4"))
    if not sample[True] or not sample[False]:
        bias = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(WIDTH, "f4"), np.ones(WIDTH, "f4"), np.zeros(WIDTH), bias, prior)
    # the order in which rows arrive must not matter
    return fit(*(np.stack(sorted(sample[side], key=lambda row: row.tobytes())) for side in (True, False)), prior)


def with_score(docs: DataFrame, model: Model, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with a further column: how likely label 1 is, from the text alone; a null text is scored as empty."""
    shared = spark_of(docs).sparkContext.broadcast(model)
    inner = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])  # no name can clash
    names, text = [*inner.columns, "score"], f"c{docs.columns.index(text_column)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = shared.value.score(np.stack([features(one) for one in bytes_of(batch, text)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype("f8"))], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    return inner.mapInArrow(run, f"{kinds}, score double").toDF(*docs.columns, name)


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): how likely label 1 is, from the text alone; predicted is 1 from 0.5 on.

    A null text is scored as the empty one. Null or repeated ids are kept as they are (a null id is not held out); an
    empty table gives an empty one; other columns are not carried.
    """
    scored = with_score(pick(docs, id=id_column, text=text_column), model, "score")
    return scored.select(
        "id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
