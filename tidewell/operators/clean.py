"""Cleaning steps. A step that needs column statistics fits them in one job and returns a lazy projection.

The fitted values are one number per column and end up as literals, so a chain of steps stays a narrow
projection over the source: no join, no shuffle, one whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import clamp, col, numeric_columns, text_columns
from tidewell.functions.text import clean_text as clean_text_column
from tidewell.functions.text import strip
from tidewell.operators.profile import iqr_fences
from tidewell.operators.quantiles import column_quantiles
from tidewell.session import materialise


@dataclass(frozen=True)
class Fitted:
    """A step with its statistics: what it does to a table of the same columns, and the fitted values by column."""

    apply: Callable[[DataFrame], DataFrame]
    parameters: dict[str, dict[str, object]] = field(default_factory=dict)
    once: bool = False  # applying it is work of its own, so one result serves all later steps


def with_columns(changed: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(changed) if changed else df


@dataclass(frozen=True)
class RangeRule:
    """Clamp a column to [low, high]."""

    low: float
    high: float


@dataclass(frozen=True)
class RegexRule:
    """Remove every match of the pattern."""

    pattern: str


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows. Repeats of a hot row combine map-side before the shuffle."""
    return df.dropDuplicates()


# ---- imputation -------------------------------------------------------------------------------------------


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, ties to the smallest; computed as distributed value counts."""
    if not columns:
        return {}
    entries = [F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    counted = df.select(F.inline(F.array(*entries))).where("v IS NOT NULL").groupBy("i", "v").count()
    best = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
    found = {row["i"]: row["v"] for row in best.collect()}  # one row per column
    return {c: found[i] for i, c in enumerate(columns) if i in found}


def fill_values(df: DataFrame, strategy: str, columns: Sequence[str]) -> dict[str, float]:
    """Mean or median of each numeric column that has both values and gaps."""
    stats = df.agg(
        F.count(F.lit(1)),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    rows, counts, means = stats[0], stats[1 : 1 + len(columns)], stats[1 + len(columns) :]
    gaps = {c: counts[i] for i, c in enumerate(columns) if 0 < counts[i] < rows}
    if strategy == "median":
        return {c: q[0] for c, q in column_quantiles(df, list(gaps), (0.5,)).items()}
    return {c: means[i] for i, c in enumerate(columns) if c in gaps}


def fit_impute(df: DataFrame, strategy: str = "auto", exclude: Sequence[str] = (), knn=None) -> Fitted:
    """Fill numeric gaps by mean, median or nearest rows, and text gaps by the most frequent value.

    ``auto`` is the mean. ``ml`` needs ``knn``, a function that fills the numeric columns of a frame.
    """
    numeric = numeric_columns(df, exclude)
    if strategy in ("auto", "mean", "median"):
        fills: dict[str, object] = fill_values(df, "median" if strategy == "median" else "mean", numeric) if numeric else {}
        filled = {c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in fills.items()}
    elif strategy == "ml":
        fills, filled = {}, {}
    else:
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    modes = column_modes(df, text_columns(df, exclude))
    filled |= {c: F.coalesce(col(c), F.lit(v)) for c, v in modes.items()}
    near = knn is not None and strategy == "ml" and bool(numeric)
    parameters = {c: {"fill": v} for c, v in (fills | modes).items()}
    if near:
        parameters |= {c: {"fill": "nearest rows"} for c in numeric}
    return Fitted(lambda d: with_columns(filled)(knn(d, numeric) if near else d), parameters, once=near)


def impute(df: DataFrame, strategy: str = "auto", exclude: Sequence[str] = (), knn=None) -> DataFrame:
    return fit_impute(df, strategy, exclude, knn).apply(df)


# ---- outliers ---------------------------------------------------------------------------------------------


def fit_clip(df: DataFrame, exclude: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> Fitted:
    """Clamp each numeric column to its own 5th and 95th percentile; null stays null."""
    bounds = {c: b for c, b in column_quantiles(df, numeric_columns(df, exclude), (low, high)).items() if b}
    clipped = {c: clamp(col(c).cast("double"), b[0], b[1]) for c, b in bounds.items()}
    return Fitted(with_columns(clipped), {c: {"low": b[0], "high": b[1]} for c, b in bounds.items()})


def clip_outliers(df: DataFrame, exclude: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    return fit_clip(df, exclude, low, high).apply(df)


def flag_outliers(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<column>_outlier``: outside 1.5 IQR, or more than three population deviations from the mean."""
    columns = numeric_columns(df) if columns is None else list(columns)
    flags: dict[str, Column] = {}
    if method == "iqr":
        fences = iqr_fences(df, columns)
        for c in columns:
            fence = fences.get(c)
            flags[c] = (col(c) < fence[0]) | (col(c) > fence[1]) if fence else F.lit(False)
    elif method == "zscore":
        for c, (mean, spread) in mean_and_spread(df, columns).items():
            flags[c] = F.abs(col(c) - mean) / spread > 3 if spread else F.lit(False)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return df.withColumns({f"{c}_outlier": F.coalesce(flag, F.lit(False)) for c, flag in flags.items()})


# ---- scaling ----------------------------------------------------------------------------------------------


def mean_and_spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(col(c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def fit_normalise(df: DataFrame, exclude: Sequence[str] = ()) -> Fitted:
    """Min-max scale each numeric column to [0, 1]; a constant column becomes 0."""
    columns = numeric_columns(df, exclude)
    row = df.agg(*[f(col(c)) for c in columns for f in (F.min, F.max)]).first() if columns else ()
    scaled, parameters = {}, {}
    for i, c in enumerate(columns):
        low, high = row[2 * i], row[2 * i + 1]
        if low is not None:
            value = (col(c) - low) / float(high - low) if high != low else F.lit(0.0)
            scaled[c] = F.when(col(c).isNotNull(), value)
            parameters[c] = {"low": low, "high": high}
    return Fitted(with_columns(scaled), parameters)


def normalise(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return fit_normalise(df, exclude).apply(df)


def fit_standardise(df: DataFrame, exclude: Sequence[str] = ()) -> Fitted:
    """Centre and divide by the population deviation; a constant column becomes 0."""
    columns = numeric_columns(df, exclude)
    scaled, parameters = {}, {}
    for c, (mean, spread) in mean_and_spread(df, columns).items() if columns else ():
        if mean is not None:
            value = (col(c) - mean) / spread if spread else F.lit(0.0)
            scaled[c] = F.when(col(c).isNotNull(), value)
            parameters[c] = {"mean": mean, "deviation": spread}
    return Fitted(with_columns(scaled), parameters)


def standardise(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return fit_standardise(df, exclude).apply(df)


# ---- types, text, rules -----------------------------------------------------------------------------------


# The types a text column may turn into, in order.
TYPES = ("bigint", "double", "timestamp_ntz")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# What a number or a time looks like from its beginning: a year, or digits and points to the end.
MAYBE = r"^[+-]?(\d{4}|[\d.]+([eE][+-]?\d+)?[^\x21-\x7e]*$)"


def _unfit(value: Column) -> Column:
    """The types, as bits in their order, that a text does not parse as.

    Numbers and times begin with a digit, sign or point. Most other texts are told by their first characters, which are
    looked at before white space is cut off, the type checks and the cut being the costly part.
    """
    first = F.ascii(value)
    other = first.between(33, 42) | first.between(58, 127) | (first.between(43, 57) & ~value.rlike(MAYBE))
    cut = strip(value)
    # A cast that fails costs as much as many patterns, so it is left to the few texts that may be too large.
    sized = cut.rlike(r"^[+-]?\d{1,18}$") | (cut.rlike(r"^[+-]?\d{19,}$") & cut.try_cast("bigint").isNotNull())
    whole = F.when(sized, 0).otherwise(1)
    number = F.when(cut.rlike(NUMBER), 0).otherwise(2)
    time = F.when(cut.try_cast("timestamp_ntz").isNotNull(), 0).otherwise(4)
    return F.when(value.isNull(), None).when(other, 7).otherwise(whole + number + time)


def fit_types(df: DataFrame, columns: Sequence[str] | None = None) -> Fitted:
    """Text columns whose every value parses become bigint, double or timestamp; others stay text.

    One pass gathers, for every column, the types that some value does not parse as.
    """
    columns = text_columns(df) if columns is None else list(columns)
    row = df.agg(*[F.bit_or(_unfit(col(c))) for c in columns]).first() if columns else ()
    casts: dict[str, Column] = {}
    parameters = {}
    for c, unfit in zip(columns, row):
        fitting = [kind for bit, kind in enumerate(TYPES) if unfit is not None and not unfit >> bit & 1]
        if fitting:
            casts[c] = strip(col(c)).try_cast(fitting[0])
            parameters[c] = {"type": fitting[0]}
    return Fitted(with_columns(casts), parameters)


def correct_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fit_types(df, columns).apply(df)


def clean_text(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    columns = text_columns(df, exclude)
    return df.withColumns({c: clean_text_column(col(c)) for c in columns}) if columns else df


def apply_rules(df: DataFrame, rules: Mapping[str, RangeRule | RegexRule]) -> DataFrame:
    """Range rules clamp, regex rules remove matches; rules for absent columns are skipped."""
    changed = {}
    for c, rule in rules.items():
        if c not in df.columns:
            continue
        if isinstance(rule, RangeRule):
            changed[c] = clamp(col(c), rule.low, rule.high)
        else:
            changed[c] = F.regexp_replace(col(c).cast("string"), rule.pattern, "")
    return df.withColumns(changed) if changed else df


# ---- reference checks and integration ----------------------------------------------------------------------


def _values(reference: DataFrame) -> DataFrame:
    return reference.toDF("_ref").distinct()


def keep_referenced(df: DataFrame, references: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose value is in the one-column reference table, for each listed column present."""
    for c, reference in references.items():
        if c in df.columns:
            # Null is kept only when the reference lists it.
            df = df.join(_values(reference), col(c).eqNullSafe(F.col("_ref")), "left_semi")
    return df


def reference_violations(df: DataFrame, references: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that fail at least one check, with the columns that failed."""
    present = [c for c in references if c in df.columns]
    flagged = df
    for i, c in enumerate(present):
        known = _values(references[c]).withColumn(f"_known{i}", F.lit(True)).withColumnRenamed("_ref", f"_ref{i}")
        flagged = flagged.join(known, col(c).eqNullSafe(F.col(f"_ref{i}")), "left").drop(f"_ref{i}")
    failed = F.array_compact(
        F.array(*[F.when(F.col(f"_known{i}").isNull(), F.lit(c)) for i, c in enumerate(present)])
    )
    return (
        flagged.withColumn("violations", F.concat_ws(",", failed))
        .where("violations <> ''")
        .drop(*[f"_known{i}" for i in range(len(present))])
    )


def full_outer(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Full outer equi-join on one key where null keys match each other.

    Written as a left outer join plus the unmatched right rows: both join types can split a hot key at run
    time, which a full outer join cannot. Null keys meeting null keys multiply, as equal keys do: that is the
    meaning of the merge, so give rows without a key one before when that is not wanted.
    """
    taken = set(left.columns) - {key}
    right = right.select(
        col(key).alias("_rk"),
        *[col(c).alias(f"{c}{suffix}" if c in taken else c) for c in right.columns if c != key],
    )
    match = col(key).eqNullSafe(F.col("_rk"))
    both = left.join(right.withColumn("_hit", F.lit(True)), match, "left").drop("_rk", "_hit")
    only_right = right.join(left.select(col(key)), match, "left_anti").withColumnRenamed("_rk", key)
    return both.unionByName(only_right, allowMissingColumns=True)


def integrate(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Fold full outer joins over the sources; overlapping columns of source i get ``_<i>``.

    Each join reads both of its sides twice, so what was joined so far is written before the next source joins,
    and the scans grow with the number of sources, not with its square.
    """
    merged = sources[0]
    for number, source in enumerate(sources[1:], start=2):
        merged = full_outer(merged if number == 2 else materialise(merged), source, key, f"_{number}")
    return merged
