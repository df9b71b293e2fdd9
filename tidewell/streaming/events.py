"""Cleaning and windowed statistics on event streams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.functions.columns import clamp, json_safe
from tidewell.functions.text import clean_text
from tidewell.operators.clean import RangeRule


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def clean_stream(
    events: DataFrame,
    key: Sequence[str],
    time: str,
    delay: str,
    texts: Sequence[str] = (),
    ranges: dict[str, RangeRule] | None = None,
) -> DataFrame:
    """Row-local cleaning of a stream: repeats within the watermark, non-finite numbers, text and ranges.

    State is one entry per key for the length of the watermark. Range bounds come from a fitted snapshot.
    """
    # Watermarks need an instant, and files may hold local timestamps.
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    distinct = json_safe(timed.dropDuplicatesWithinWatermark(list(key)))
    changed = {c: clean_text(F.col(c)) for c in texts}
    changed |= {c: clamp(F.col(c), r.low, r.high) for c, r in (ranges or {}).items()}
    return distinct.withColumns(changed) if changed else distinct


def windowed_statistics(events: DataFrame, time: str, group: str, value: str, width: str, delay: str) -> DataFrame:
    """Count, mean and largest value per tumbling window and group, late rows up to ``delay``."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return _statistics(timed, time, group, value, width)


def batch_statistics(events: DataFrame, time: str, group: str, value: str, width: str) -> DataFrame:
    """The same statistics of a finished table; local timestamps need no zone here."""
    return _statistics(events, time, group, value, width)


def _statistics(timed: DataFrame, time: str, group: str, value: str, width: str) -> DataFrame:
    grouped = timed.groupBy(F.window(time, width).alias("w"), group).agg(
        F.count(F.lit(1)).alias("events"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")
    )
    return grouped.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), group, "events", "mean_value", "max_value"
    )


# ---- anomalies --------------------------------------------------------------------------------------------

MIN_BEFORE = 10  # values that a group must have had before its deviations mean anything
DEVIATIONS = 3.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class AnomalyCounter(StatefulProcessor):
    """Counts, for each closed window of a group, the values far from what all windows before have shown.

    The state of a group is three numbers, its running moments. Rows are the counted values of closed windows; all windows
    that a batch closes are later than those of the batches before, so they are taken by their start.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = [[batch[c].to_numpy(float if c == "value" else int) for c in ("start", "value", "n")] for batch in rows]
        starts, values, counts = (np.concatenate(column) for column in zip(*batches))
        order = np.argsort(starts, kind="stable")
        starts, values, counts = starts[order], values[order], counts[order]
        n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
        found = []
        firsts = np.flatnonzero(np.diff(starts, prepend=starts[0] - 1))
        for first, end in zip(firsts, [*firsts[1:], len(starts)]):
            known = ~np.isnan(values[first:end])
            v, c = values[first:end][known], counts[first:end][known]
            bound = DEVIATIONS * math.sqrt(m2 / n) if n >= MIN_BEFORE else math.inf
            anomalies = int(c[np.abs(v - mean) > bound].sum())
            found.append((int(starts[first]), key[0], int(counts[first:end].sum()), anomalies, mean if n else None, n))
            if len(v):  # moments of the window join those before
                more = int(c.sum())
                middle = math.fsum(v * c) / more
                spread = math.fsum((v - middle) ** 2 * c)
                apart, both = middle - mean, n + more
                m2 += spread + apart * apart * n * more / both
                mean += apart * more / both
                n = both
        self.moments.update((n, mean, m2))
        yield pd.DataFrame(found, columns=["start", "group", "events", "anomalies", "mean_before", "seen_before"]).astype(
            {"mean_before": "float64"}
        )

    def close(self) -> None:
        pass


def anomaly_counts(events: DataFrame, time: str, group: str, value: str, width_seconds: int, delay: str) -> DataFrame:
    """(window_start, group, events, anomalies, mean_before, seen_before) for each tumbling window once it is closed.

    A value is an anomaly when it lies over three population deviations from the mean of all earlier windows of its group
    and these held ten values at least. Rows later than ``delay`` are left out, a null value counts as an event only. Needs
    the RocksDB state store, which ``run_to_table`` sets.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    narrow = timed.select(F.col(time).alias("at"), F.col(group).alias("key"), F.col(value).cast("double").alias("value"))
    # Open windows wait as counted values, dealt by window, group and value: a group is one task's only when they are closed.
    counted = narrow.groupBy(F.window("at", f"{width_seconds} seconds").alias("w"), "key", "value").agg(F.count(F.lit(1)).alias("n"))
    kind = events.schema[group].dataType.simpleString()
    closed = counted.select("key", F.unix_millis("w.start").alias("start"), "value", "n")
    found = closed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=AnomalyCounter(),
        outputStructType=f"start long, group {kind}, events long, anomalies long, mean_before double, seen_before long",
        outputMode="Append",
        timeMode="None",
    )
    start = F.timestamp_millis("start").cast("timestamp_ntz").alias("window_start")
    return found.select(start, F.col("group").alias(group), "events", "anomalies", "mean_before", "seen_before")


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything available and append it to a table; exactly once through the checkpoint."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
