"""Joining grouped results back on their keys, null keys included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col


def semi_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys occur in ``right``, null keys included."""
    return join_on(left, right.select(*map(col, keys)), keys, "left_semi")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & col(k).eqNullSafe(col(f"_right_{k}"))
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])
