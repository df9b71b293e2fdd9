"""Turning loose tables into flat typed ones: JSON expansion, list cells, sector split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import arrays_to_json, col, text_columns, with_normalised_names
from tidewell.functions.text import sector_key, strip
from tidewell.operators.clean import Fitted, fit_types


def _json_object(name: str):
    """The cell when it looks like a JSON object, else null."""
    text = strip(col(name))
    return F.when(text.startswith("{") & text.endswith("}"), text)


def json_keys(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct (column, key) pairs of all JSON objects in the text columns; key null marks an empty object.

    One pass for all columns; pairs combine map-side, so the shuffle carries names only.
    """
    columns = text_columns(df) if columns is None else list(columns)
    pairs = [
        F.struct(F.lit(c).alias("column"), F.json_object_keys(_json_object(c)).alias("keys")) for c in columns
    ]
    found = df.select(F.inline(F.array(*pairs))).where("keys IS NOT NULL")
    return found.select("column", F.explode_outer("keys").alias("key")).distinct()


def json_maps(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns as maps from key to text, null where a cell is no JSON object; any number of keys, in one pass.

    The form for tables with very many distinct keys, which make too many columns for any planner.
    """
    columns = text_columns(df) if columns is None else list(columns)
    parsed = {c: F.from_json(_json_object(c), "map<string,string>") for c in columns}
    return df.withColumns(parsed) if parsed else df


def _variant(name: str):
    return F.try_parse_json(_json_object(name))


def _fields(schema: str | None) -> dict[str, T.DataType]:
    """The keys and types that a merged schema of objects names."""
    kind = T._parse_datatype_string(schema.replace("OBJECT<", "STRUCT<")) if schema else None
    return {f.name: f.dataType for f in kind} if isinstance(kind, T.StructType) else {}


def fit_json(df: DataFrame, columns: Sequence[str] | None = None, typed: bool = True) -> Fitted:
    """Replace every column holding at least one JSON object by ``<column>_<key>`` columns.

    Cells that are no object give null. Struct columns expand by their own schema. With ``typed`` numbers are numbers, and
    texts become numbers or timestamps when every value parses; nested objects and lists stay JSON text. A new column that
    has the name of another takes its place, as a later key does that of an earlier one.

    The keys and their types come from one aggregate that merges schemas in each task; the driver sees the merged schema,
    which becomes that of the result. ``json_maps`` keeps keys as data.
    """
    wanted = set(df.columns if columns is None else columns)
    candidates = [c for c in text_columns(df) if c in wanted]
    merged, objects, odd = (), (), ()
    if candidates:
        # Objects that name a key twice are no variants; they are rare, but their keys count.
        row = df.agg(
            *[F.schema_of_variant_agg(_variant(c)) for c in candidates],
            *[F.count(F.json_object_keys(_json_object(c))) for c in candidates],
            *[F.count_if(_variant(c).isNull() & F.json_object_keys(_json_object(c)).isNotNull()) for c in candidates],
        ).first()
        merged, objects, odd = (row[k * len(candidates) : (k + 1) * len(candidates)] for k in range(3))
    found = {c: _fields(schema) for c, schema, n in zip(candidates, merged, objects) if n}
    repeated = [c for c, n in zip(candidates, odd) if n]
    for column, key in json_keys(df, repeated).collect() if repeated else ():
        if key is not None:
            found[column][key] = T.StringType()
    structs = [f for f in df.schema if isinstance(f.dataType, T.StructType) and f.name in wanted]
    if not found and not structs:
        return Fitted(lambda d: d)
    as_text = set(repeated) if typed else set(found)
    kept = [c for c in df.columns if c not in found and c not in {s.name for s in structs}]

    def value(column: str, key: str, kind: T.DataType):
        if column in as_text:
            return col(column)[key]
        if isinstance(kind, T.LongType):
            return F.try_variant_get(col(column)[key], "$", "bigint")
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.try_variant_get(col(column)[key], "$", "double")
        return F.try_variant_get(col(column)[key], "$", "string")

    out = {c: col(c) for c in kept}
    out |= {f"{c}_{key}": value(c, key, found[c][key]) for c in df.columns if c in found for key in sorted(found[c])}
    fields = {f"{s.name}_{f.name}": col(s.name).getField(f.name) for s in structs for f in s.dataType}
    numbers = (T.LongType, T.DoubleType, T.FloatType, T.DecimalType)
    texts = [
        f"{c}_{key}" for c in found for key, kind in found[c].items()
        if f"{c}_{key}" not in fields and (c in as_text or not isinstance(kind, numbers))
    ]

    def flatten(d: DataFrame) -> DataFrame:
        maps = {
            c: F.from_json(_json_object(c), "map<string,string>") if c in as_text else _variant(c).cast("map<string,variant>")
            for c in found
        }
        parsed = d.withColumns(maps) if maps else d
        return parsed.select(*[v.alias(name) for name, v in (out | fields).items()])

    if not typed or not texts:
        return Fitted(flatten)
    types = fit_types(flatten(df), texts)
    return Fitted(lambda d: types.apply(flatten(d)), types.parameters)


def expand_json(df: DataFrame, columns: Sequence[str] | None = None, typed: bool = True) -> DataFrame:
    return fit_json(df, columns, typed).apply(df)


def fit_structure(df: DataFrame) -> Fitted:
    """Expand JSON, turn list cells into text and normalise the column names."""
    flat = fit_json(df)
    return Fitted(lambda d: with_normalised_names(arrays_to_json(flat.apply(d))), flat.parameters)


def structure(df: DataFrame) -> DataFrame:
    return fit_structure(df).apply(df)


# Column names that hold a sector, in order of preference.
SECTOR_COLUMNS = ("sector", "sector_name", "business_sector", "department", "division")


def sector_column(df: DataFrame) -> str | None:
    for name in SECTOR_COLUMNS:
        if name in df.columns:
            return name
    return next((c for c in df.columns if "sector" in c), None)


def with_sector_key(df: DataFrame) -> DataFrame:
    """Adds ``sector_key``; ``all`` when there is no sector column or it has at most one non-empty value."""
    column = sector_column(df)
    if column is None:
        return df.withColumn("sector_key", F.lit("all"))
    value = strip(F.coalesce(col(column).cast("string"), F.lit("unknown")))
    named = df.withColumn(column, value)
    # Two distinct values are enough to decide, so the distinct stops there.
    several = named.select(F.nullif(col(column), F.lit("")).alias("v")).where("v IS NOT NULL").distinct().limit(2)
    if several.count() <= 1:
        return named.withColumn("sector_key", F.lit("all"))
    return named.withColumn("sector_key", sector_key(col(column)))


def with_sector_keys(df: DataFrame, dataset: str) -> DataFrame:
    """The same for many datasets in one table, each of which decides for itself."""
    column = sector_column(df.drop(dataset))
    if column is None:
        return df.withColumn("sector_key", F.lit("all"))
    named = df.withColumn(column, strip(F.coalesce(col(column).cast("string"), F.lit("unknown"))))
    value = F.nullif(col(column), F.lit(""))
    several = named.groupBy(col(dataset).alias("_dataset")).agg((F.min(value) != F.max(value)).alias("_several"))
    joined = named.join(several, col(dataset).eqNullSafe(F.col("_dataset")), "left").drop("_dataset")
    key = F.when(F.col("_several"), sector_key(col(column))).otherwise("all")
    return joined.withColumn("sector_key", key).drop("_several")


def sector_variants(df: DataFrame, algorithm: str, quality: float) -> DataFrame:
    """One row for the whole result and one per sector variant: label, algorithm, rows, quality."""
    per_sector = with_sector_key(df).groupBy("sector_key").agg(F.count(F.lit(1)).alias("row_count"))
    labelled = per_sector.where("sector_key <> 'all'").withColumnRenamed("sector_key", "label")
    whole = per_sector.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("row_count")).select(
        F.lit("all").alias("label"), "row_count"
    )
    name = F.when(F.col("label") == "all", algorithm).otherwise(
        F.concat(F.lit(f"{algorithm}__sector__"), F.col("label"))
    )
    return whole.unionByName(labelled).select(
        "label", name.alias("algorithm"), "row_count", F.lit(quality).alias("quality_score")
    )
