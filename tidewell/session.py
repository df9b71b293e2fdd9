"""Session helpers: a local session for tests and benchmarks, and shared storage for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "tidewell") -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with the machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="tidewell-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)  # one folder per session, also when it was not configured
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, replaces: DataFrame | None = None, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, so later jobs neither recompute nor lose it.

    The table is columnar, so later passes read only their columns, and its size is known to the planner. A loop
    names the table of its last round in ``replaces``; it is deleted once the new one is complete. Rows that differ in the
    columns ``folders`` lie in folders of their own.
    """
    path = new_path(df.sparkSession, "table")
    df.write.partitionBy(*folders).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.table_path = path
    if replaces is not None:
        discard(replaces)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
