"""Helpers the operators share: column picking, bounded slices of Arrow batches, vocabulary files, row keys."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import new_path

WORD_SPACE = " \t\n\x0b\x0c\r"
MAX_VOCABULARY_BYTES = 64 << 20


def named(name: str) -> Column:
    """The column of exactly this name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, so that no further column of the input can clash."""
    return df.select(*[named(source).alias(alias) for alias, source in columns.items()])


def kind(df: DataFrame, column: str) -> str:
    """The SQL type of a column."""
    return df.schema[column].dataType.simpleString()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``limit`` bytes of ``column`` (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = size = 0
        for row, more in enumerate(sizes):
            if row > start and size + more > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += more
        yield batch.slice(start)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of slices that hold about ``limit`` bytes of ``column`` together (at least one row each)."""
    block, held = [], 0
    for batch in slices(batches, column, max(1, limit // 8)):
        block.append(batch)
        held += batch.nbytes
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; a null text is an empty one."""
    return [text or "" for text in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The same as UTF-8, without a detour over str."""
    values = batch.column(batch.schema.get_field_index(column))
    return [text or b"" for text in values.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return the memory that a finished task has freed: a worker lives on, and its executor counts what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux keeps freed memory too
    if trim:
        trim(0)


def vocabulary_bytes(path: str) -> bytes:
    """A tokenizer file, read on the driver and small enough to send to every executor."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than a vocabulary may have")
    with open(path, "rb") as file:
        return file.read()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder: later jobs neither recompute nor lose it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
