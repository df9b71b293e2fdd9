"""Row-level scope: which datasets a principal may see, as semi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """Who asks: company, role and, for a sector head, the sector."""

    company_id: int
    role: str
    sector_id: int | None = None


def allowed_sectors(sectors: DataFrame, who: Principal) -> DataFrame:
    """Sectors of the company; a sector head sees the own sector only."""
    found = sectors.where(F.col("company_id") == who.company_id)
    return found.where(F.col("id") == who.sector_id) if who.role == "sector_head" else found


def allowed_uploaders(users: DataFrame, who: Principal) -> DataFrame:
    return users.where((F.col("company_id") == who.company_id) & (F.col("role") == who.role))


def semi(left: DataFrame, key: str, right: DataFrame, right_key: str = "id") -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``. No fan-out, so no distinct afterwards."""
    keys = right.select(F.col(right_key).alias("_semi"))
    return left.join(keys, F.col(key) == F.col("_semi"), "left_semi")


def anti(left: DataFrame, key: str, right: DataFrame, right_key: str = "id") -> DataFrame:
    keys = right.select(F.col(right_key).alias("_anti"))
    return left.join(keys, F.col(key) == F.col("_anti"), "left_anti")


def scoped_raw(raw: DataFrame, sectors: DataFrame, users: DataFrame, who: Principal) -> DataFrame:
    """Datasets in an allowed sector, uploaded by a user of the same company and role."""
    in_sector = semi(raw, "sector_id", allowed_sectors(sectors, who))
    return semi(in_sector, "uploaded_by", allowed_uploaders(users, who))


def predictions_in_scope(predictions: DataFrame, scoped: DataFrame, sectors: DataFrame) -> DataFrame:
    """Predictions of sectors that have a dataset in scope.

    The sectors are filtered first: a filtered dimension is known to be small, so the predictions need not be
    shuffled on a few hot sector keys.
    """
    return semi(predictions, "sector_id", semi(sectors, "id", scoped, "sector_id"))


def recommendations_in_scope(
    recommendations: DataFrame, predictions: DataFrame, scoped: DataFrame, sectors: DataFrame
) -> DataFrame:
    return semi(recommendations, "prediction_id", predictions_in_scope(predictions, scoped, sectors))


def with_principal(raw: DataFrame, sectors: DataFrame, users: DataFrame) -> DataFrame:
    """Each dataset with the principals that see it: company, role and, for sector heads, the sector.

    Serves the roll-ups of all principals at once, instead of one query per principal.
    """
    homes = sectors.select(F.col("id").alias("_s"), F.col("company_id").alias("_sc"))
    owners = users.select(F.col("id").alias("_u"), F.col("company_id").alias("company_id"), "role")
    return (
        raw.join(homes, F.col("sector_id") == F.col("_s"))
        .join(owners, (F.col("uploaded_by") == F.col("_u")) & (F.col("_sc") == F.col("company_id")))
        .withColumn("scope_sector", F.when(F.col("role") == "sector_head", F.col("sector_id")))
        .drop("_s", "_sc", "_u")
    )
