"""Readers of uploaded files, chosen by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.functions.columns import json_safe

Schema = T.StructType | str | None


def read_csv(spark: SparkSession, path: str, schema: Schema = None, quoted_breaks: bool = False) -> DataFrame:
    """Header row; types are inferred only when no schema is given.

    A file is split among tasks. One with line breaks inside quotes cannot be: say so by ``quoted_breaks``.
    """
    reader = spark.read.option("header", True).option("multiLine", quoted_breaks).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: Schema = None, lines: bool = True) -> DataFrame:
    """Records or arrays of records, one per line, so that a file is split; nested objects become structs.

    A document that spreads over lines cannot be split: turn ``lines`` off for it.
    """
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv,
    ".json": read_json,
}


def read_upload(
    spark: SparkSession, path: str, kind: str | None = None, schema: Schema = None, **options
) -> DataFrame:
    """Read a file or folder by extension (any case) or by the given kind; non-finite numbers become null.

    An unknown extension is an error before any job starts.
    """
    name = (kind or path).lower()
    for extension, reader in READERS.items():
        if name.endswith(extension):
            return json_safe(reader(spark, path, schema, **options))
    raise ValueError(f"unsupported file format: {path}")
