"""The log of a run, readable while it runs: one small file for each event in a shared folder.

A step writes an event when it starts (``running``), when its statistics are known and it is part of the plan
(``fitted``), and when the table is written (``completed``, with its figures), or when it is left out (``skipped``) or
fails (``error``). Files appear whole, by a rename, so the folder can be read as a table or as a stream at any time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import col
from tidewell.session import materialise, new_path

EVENT = (
    "run string, event int, kind string, seq int, step_id string, label string, stage string, technique string, "
    "status string, progress int, row_count bigint, quality_score double, columns_affected int, rows_removed bigint, "
    "issues bigint, parameters string, error string, at timestamp_ntz"
)
STEP, PREDICTION = "step", "prediction"


class RunLog:
    """Events of one run, in the order in which they happen. ``at`` fixes the time that they state."""

    def __init__(self, spark: SparkSession, path: str | None = None, run: str | None = None, at: dt.datetime | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "progress")
        self.run = run or uuid.uuid4().hex
        self.at = at
        self.event = 0
        # there before the first event, so that a reader can wait for it
        files, folder = self._files(self.path)
        files.mkdirs(folder)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, **fields) -> None:
        """Append an event. Parameters are a mapping and become JSON text."""
        at = self.at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        if isinstance(fields.get("parameters"), Mapping):
            fields["parameters"] = json.dumps(fields["parameters"], sort_keys=True, default=str)
        row = {"run": self.run, "event": self.event, "kind": STEP, **fields, "at": at.isoformat(timespec="microseconds")}
        name = f"{self.run}-{self.event:06d}.json"
        files, hidden = self._files(f"{self.path}/_{name}")
        stream = files.create(hidden, True)
        try:
            stream.write(bytearray((json.dumps({k: v for k, v in row.items() if v is not None}) + "\n").encode()))
        finally:
            stream.close()
        if not files.rename(hidden, self._files(f"{self.path}/{name}")[1]):
            raise OSError(f"could not publish event {name}")
        self.event += 1

    def events(self) -> DataFrame:
        """All events so far."""
        return read_log(self.spark, self.path).where(F.col("run") == self.run)

    def latest(self) -> DataFrame:
        """The last event of each step and prediction, without the bookkeeping of events."""
        events = self.events()
        whole = F.max_by(F.struct(*events.columns), "event").alias("last")
        kept = [c for c in events.columns if c not in ("run", "event")]
        return events.groupBy("kind", "seq").agg(whole).select(*[F.col(f"last.{c}").alias(c) for c in kept])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events in a folder; an empty folder has none."""
    return spark.read.schema(EVENT).json(path)


def follow_log(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream, which gets every event once."""
    return spark.readStream.schema(EVENT).json(path)


class Watch:
    """Row counts and completeness of a table at several points of a plan, taken by the job that writes it.

    A point adds two narrow columns to the rows that pass it, the rows it stands for and their null cells, and the write
    observes their sums. The observation lies in the stage that writes, whose tasks count once whatever happens to
    executors; above a shuffle or a sample it would count what is read twice. Rows that a later step drops must be written
    before.
    """

    def __init__(self):
        self.open: dict[object, int] = {}  # points not yet written, with the number of columns there
        self.found: dict[object, tuple[int, float]] = {}

    def _names(self, name: object) -> tuple[str, str]:
        return f"rows at point {name}", f"gaps at point {name}"

    def hidden(self) -> list[str]:
        return [column for name in self.open for column in self._names(name)]

    def visible(self, df: DataFrame) -> list[str]:
        hidden = set(self.hidden())
        return [c for c in df.columns if c not in hidden]

    def mark(self, df: DataFrame, name: object) -> DataFrame:
        """The table with a point of this name."""
        columns = self.visible(df)
        gaps = F.lit(0)
        for c in columns:
            gaps = gaps + F.when(col(c).isNull(), 1).otherwise(0)
        self.open[name] = len(columns)
        rows_name, gaps_name = self._names(name)
        return df.withColumns({rows_name: F.lit(1).cast("bigint"), gaps_name: gaps.cast("bigint")})

    def distinct(self, df: DataFrame) -> DataFrame:
        """Distinct rows, which stand for all their repeats at the points before."""
        sums = [F.sum(c).alias(c) for c in self.hidden()]
        columns = [col(c) for c in self.visible(df)]
        return df.groupBy(*columns).agg(*sums) if sums else df.dropDuplicates()

    def shown(self, df: DataFrame) -> DataFrame:
        return df.select(*[col(c) for c in self.visible(df)])

    def write(self, df: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Write the table, shaped by a projection of its rows, without the points, and take their figures."""
        seen = Observation()
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"s{i}") for i, c in enumerate(self.hidden())]
        table = materialise(shape(self.shown(df.observe(seen, *sums) if sums else df)))
        if sums:
            values = seen.get
            for i, (name, width) in enumerate(self.open.items()):
                rows, gaps = values[f"s{2 * i}"], values[f"s{2 * i + 1}"]
                cells = max(rows, 1) * max(width, 1)
                self.found[name] = (rows, (rows * width - gaps) / cells)
        self.open = {}
        return table

    def figures(self, name: object) -> tuple[int, float]:
        """(rows, completeness) at a point that was written."""
        return self.found[name]


def log_prediction(log: RunLog, seq: int, prediction_type: str, found: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Write a table of predictions with a ``confidence`` and log the run: its parameters, rows and mean confidence.

    Returns the written table. A run that fails leaves its ``running`` event and an ``error``.
    """
    step = {"kind": PREDICTION, "seq": seq, "step_id": prediction_type, "stage": "prediction", "parameters": parameters}
    log.write(**step, status="running")
    seen = Observation()
    try:
        table = materialise(found.observe(seen, F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("sure")))
    except Exception as error:
        log.write(**step, status="error", error=str(error)[:2000])
        raise
    log.write(**step, status="completed", row_count=seen.get["rows"], quality_score=seen.get["sure"], progress=100)
    return table
