"""Stored datasets: raw and cleaned tables, append-only logs, exports and deletes, as partitioned files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import col, json_safe
from tidewell.functions.text import SECTOR_MARK
from tidewell.operators.scope import semi
from tidewell.operators.structure import with_sector_keys

RAW, CLEANED, SCORES, REPORTS = "raw", "cleaned", "scores", "reports"

# Every dataset is a folder, and every run of it one below; a report is a folder too.
FOLDERS = {
    RAW: ("raw_data_id",),
    CLEANED: ("raw_data_id", "cleaning_algorithm"),
    SCORES: ("raw_data_id", "cleaning_algorithm"),
    REPORTS: ("report_id",),
}


SCHEMA = "_schema.json"  # columns of a table, for when its last folder is gone; readers of the folder skip it


def balanced(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of a folder meet in few tasks, while a huge folder is still written by many."""
    return df.hint("rebalance", *partitions)


class DatasetStore:
    """Tables under one root folder.

    Datasets and their runs are partition folders: a save replaces the folders that it has rows for, and a delete removes
    folders, so that an id can be saved again at any time. The driver knows the names of folders, as a reader's planner
    does, and no rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # ---- datasets ----

    def save_raw(self, df: DataFrame, id_column: str = "raw_data_id") -> None:
        """Store rows of one or many datasets, replacing exactly the datasets present."""
        self._overwrite(json_safe(df), RAW, [id_column])

    def save_cleaned(
        self, df: DataFrame, raw_data_id: int, algorithm: str, scores: Mapping[str, float], cleaned_data_id: int
    ) -> float:
        """Replace the cleaned result of (dataset, algorithm) and its scores; returns the mean score."""
        quality = sum(scores.values()) / len(scores) if scores else 0.0
        tagged = json_safe(df).withColumns({
            "cleaned_data_id": F.lit(cleaned_data_id).cast("bigint"),
            "quality_score": F.lit(quality),
            "raw_data_id": F.lit(raw_data_id).cast("bigint"),
            "cleaning_algorithm": F.lit(algorithm),
        })
        if (raw_data_id, algorithm) not in self._overwrite(tagged, CLEANED, FOLDERS[CLEANED]):
            self._drop(CLEANED, raw_data_id, algorithm)
        self._save_scores(scores, [(raw_data_id, algorithm)])
        return quality

    def save_variants(
        self, df: DataFrame, raw_data_id: int, algorithm: str, scores: Mapping[str, float], cleaned_data_id: int
    ) -> float:
        """Whole result and all sector variants of one dataset; see ``save_many_variants``."""
        ids = {"raw_data_id": F.lit(raw_data_id).cast("bigint"), "cleaned_data_id": F.lit(cleaned_data_id).cast("bigint")}
        return self.save_many_variants(df.withColumns(ids), algorithm, scores, emptied=[raw_data_id])

    def save_many_variants(
        self, df: DataFrame, algorithm: str, scores: Mapping[str, float], emptied: Sequence[int] = ()
    ) -> float:
        """Whole results and sector variants of all datasets of ``df`` in one write; returns the mean score.

        ``df`` has ``raw_data_id`` and ``cleaned_data_id``; each row goes to the whole result of its dataset and to its
        sector. Every variant gets the scores of the run. Variants of an earlier save that have no rows now are removed,
        for the datasets in ``emptied`` even if ``df`` has no rows of them at all.
        """
        quality = sum(scores.values()) / len(scores) if scores else 0.0
        ids = ["raw_data_id", "cleaned_data_id"]
        keyed = with_sector_keys(json_safe(df), "raw_data_id")
        variant = F.concat(F.lit(f"{algorithm}{SECTOR_MARK}"), F.col("sector_key"))
        names = F.when(F.col("sector_key") == "all", F.array(F.lit(algorithm))).otherwise(
            F.array(F.lit(algorithm), variant)
        )
        tagged = keyed.select(
            *[col(c) for c in df.columns if c not in ids], "cleaned_data_id", F.lit(quality).alias("quality_score"),
            "raw_data_id", F.explode(names).alias("cleaning_algorithm"),
        )
        old = self._folders(CLEANED)
        now = self._overwrite(tagged, CLEANED, FOLDERS[CLEANED])
        touched = {dataset for dataset, _ in now} | set(emptied)
        mark = f"{algorithm}{SECTOR_MARK}"
        mine = {run for run in old if run[0] in touched and (run[1] == algorithm or run[1].startswith(mark))}
        for dataset, name in mine - now:
            self._drop(CLEANED, dataset, name)
            self._drop(SCORES, dataset, name)
        self._save_scores(scores, sorted(now))
        return quality

    def _save_scores(self, scores: Mapping[str, float], runs: Sequence[tuple[int, str]]) -> None:
        """The same scores for all runs, in one write; without scores the runs lose those that they had."""
        if not runs:
            return
        if not scores:
            for dataset, algorithm in runs:
                self._drop(SCORES, dataset, algorithm)
            return
        names = self.spark.createDataFrame(list(runs), "raw_data_id bigint, cleaning_algorithm string")
        lines = F.array(*[F.struct(F.lit(n).alias("algorithm"), F.lit(float(v)).alias("score")) for n, v in scores.items()])
        self._overwrite(names.select(F.inline(lines), "raw_data_id", "cleaning_algorithm"), SCORES, FOLDERS[SCORES])

    def _overwrite(self, df: DataFrame, table: str, partitions: Sequence[str]) -> set[tuple]:
        """Replace the folders that ``df`` has rows for; returns their names, as the write itself observed them."""
        seen = Observation()
        names = F.collect_set(F.struct(*[col(c) for c in partitions])).alias("names")
        watched = balanced(df, partitions).observe(seen, names)
        writer = watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partitions).parquet(self.path(table))
        self._write_text(f"{self.path(table)}/{SCHEMA}", df.schema.json())
        return {tuple(row) for row in seen.get["names"] or ()}

    def read(self, table: str, where: Column | None = None) -> DataFrame:
        """A stored table; a filter on the partition columns prunes folders. One without rows has the columns of its last save."""
        if table in FOLDERS and self.holds(table) and not self._names(self.path(table)):
            schema = T.StructType.fromJson(json.loads(self._read_text(f"{self.path(table)}/{SCHEMA}")))
            df = self.spark.createDataFrame([], schema)
        else:
            df = self.spark.read.parquet(self.path(table))
        return df if where is None else df.where(where)

    # ---- folders ----

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def holds(self, table: str) -> bool:
        """Whether anything was ever written to a table."""
        files, path = self._files(self.path(table))
        return files.exists(path)

    def _write_text(self, name: str, text: str) -> None:
        files, path = self._files(name)
        stream = files.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _read_text(self, name: str) -> str:
        files, path = self._files(name)  # readers of tables skip such a file
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _remove(self, folder: str) -> None:
        files, path = self._files(folder)
        files.delete(path, True)

    def _folder(self, table: str, *values) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join([self.path(table), *[f"{name}={escape(str(v))}" for name, v in zip(FOLDERS[table], values)]])

    def _drop(self, table: str, *values) -> None:
        """Remove the folder of a dataset, a run or a report, and the one above if that was its last."""
        folder = self._folder(table, *values)
        self._remove(folder)
        above = folder.rsplit("/", 1)[0]
        files, path = self._files(above)
        if len(values) > 1 and files.exists(path) and not len(files.listStatus(path)):
            self._remove(above)

    def _names(self, folder: str) -> list[str]:
        """Values of the partition folders right below."""
        files, path = self._files(folder)
        if not files.exists(path):
            return []
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [status.getPath().getName() for status in files.listStatus(path) if status.isDirectory()]
        return [unescape(name.split("=", 1)[1]) for name in names if "=" in name]

    def _folders(self, table: str) -> set[tuple[int, str]]:
        """(dataset, run) of all stored runs."""
        return {(int(d), run) for d in self._names(self.path(table)) for run in self._names(self._folder(table, d))}

    # ---- logs ----

    def append(self, df: DataFrame, table: str, partitions: Sequence[str] = ()) -> None:
        df.write.mode("append").partitionBy(*partitions).parquet(self.path(table))

    def append_predictions(self, df: DataFrame, payload: Sequence[str]) -> None:
        """Predictions by type; the payload columns become one JSON text."""
        kept = [c for c in df.columns if c not in payload]
        body = F.to_json(F.struct(*payload)).alias("prediction_data")
        self.append(json_safe(df).select(*kept, body), "predictions", ["prediction_type"])

    def append_report(
        self, metrics: DataFrame, report_id: int, title: str, report_type: str, created_by: int, notes: str = ""
    ) -> None:
        """Store a one-row metrics frame as a report, the metrics as one JSON text."""
        body = F.to_json(F.struct(*metrics.columns)).alias("payload")
        row = metrics.select(
            F.lit(report_id).cast("bigint").alias("report_id"), F.lit(title).alias("title"), F.lit(report_type).alias("report_type"),
            F.lit(created_by).cast("bigint").alias("created_by"), F.lit(notes).alias("notes"), body,
        )
        self.append(row, REPORTS, FOLDERS[REPORTS])
        self._write_text(f"{self.path(REPORTS)}/{SCHEMA}", row.schema.json())

    # ---- deletes ----

    def delete_dataset(self, raw_data_id: int) -> dict[str, int]:
        """Delete a dataset with its cleaned results and their scores; returns the rows that went, by table."""
        gone = {}
        for table in (RAW, CLEANED, SCORES):
            files, path = self._files(self._folder(table, raw_data_id))
            found = files.exists(path)
            gone[table] = self.spark.read.parquet(self._folder(table, raw_data_id)).count() if found else 0
            self._drop(table, raw_data_id)
        return gone

    def delete_history(self, scope: DataFrame) -> dict[str, int]:
        """Delete the cleaned results, with their scores, of the datasets whose ids a one-column frame lists.

        Returns how many results went, and their rows and scores. Raw data stays. One pass counts what goes; the driver
        gets the ids of the datasets that have a result, which are names of folders, and removes these.
        """
        gone = {"results": 0, CLEANED: 0, SCORES: 0}
        if not self.holds(CLEANED):
            return gone
        ids = scope.toDF("id")
        doomed = semi(self.read(CLEANED).select("raw_data_id", "cleaned_data_id"), "raw_data_id", ids)
        per_dataset = doomed.groupBy("raw_data_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("cleaned_data_id").alias("results")
        ).collect()
        if self.holds(SCORES):
            gone[SCORES] = semi(self.read(SCORES).select("raw_data_id"), "raw_data_id", ids).count()
        for row in per_dataset:
            gone["results"] += row["results"]
            gone[CLEANED] += row["n"]
            for table in (CLEANED, SCORES):
                self._drop(table, row["raw_data_id"])
        return gone

    def delete_report(self, report_id: int) -> bool:
        """Delete a report; returns whether there was one."""
        files, path = self._files(self._folder(REPORTS, report_id))
        found = files.exists(path)
        self._drop(REPORTS, report_id)
        return found


# ---- exports ----------------------------------------------------------------------------------------------

CSV_OPTIONS = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """JSON lines when asked for JSON, CSV for any other kind."""
    writer = df.write.mode("errorifexists")
    if kind == "json":
        writer.json(path)
    else:
        writer.options(**CSV_OPTIONS).csv(path)


def export_all(df: DataFrame, path: str, kind: str, id_column: str = "cleaned_data_id") -> None:
    """Every dataset into its own folder, in one write."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {kind}")
    writer = balanced(df, [id_column]).write.mode("errorifexists").partitionBy(id_column)
    if kind == "json":
        writer.json(path)
    else:
        writer.options(**CSV_OPTIONS).csv(path)
