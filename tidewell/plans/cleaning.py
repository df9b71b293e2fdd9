"""Cleaning plans: a typed configuration, named step lists and the step log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col, numeric_columns, text_columns
from tidewell.functions.text import clean_text
from tidewell.operators import clean, history, profile, series, structure
from tidewell.plans import progress
from tidewell.session import materialise
from tidewell.sources.store import DatasetStore


NOISE_WINDOW = 5
START = "start"  # the table before the first step


@dataclass(frozen=True)
class CleaningConfig:
    """What a cleaning run does.

    ``id_columns`` are never changed; ``order_by`` gives the row order smoothing needs, within ``key``.
    """

    impute_strategy: str = "auto"
    outlier_method: str = "iqr"
    normalize: bool = True
    standardize: bool = False
    reduce_noise: bool = True
    clean_text: bool = True
    rules: Mapping[str, clean.RangeRule | clean.RegexRule] = field(default_factory=dict)
    reference_data: Mapping[str, DataFrame] = field(default_factory=dict)
    id_columns: Sequence[str] = ()
    order_by: Sequence[str] = ()
    key: Sequence[str] = ()

    @property
    def kept(self) -> tuple[str, ...]:
        return tuple({*self.id_columns, *self.order_by, *self.key})

    def with_strategy(self, row: Mapping[str, object]) -> "CleaningConfig":
        """The same run with the settings of a strategy row."""
        names = ("impute_strategy", "outlier_method", "normalize", "standardize", "reduce_noise", "clean_text")
        return replace(self, **{n: row[n] for n in names if n in row})


@dataclass(frozen=True)
class Step:
    """A named step.

    ``fit`` takes the statistics and returns what to do; ``changes`` tells whether that may change the number of rows or
    of nulls, ``distinct`` and ``drops`` whether it removes repeated or other rows, ``stored`` whether later steps read its
    result so often that it is written, ``columns`` which columns it works on, and ``issues`` counts what a scan or
    validation step looks for.
    """

    id: str
    label: str
    stage: str
    technique: str
    fit: Callable[[DataFrame], clean.Fitted] | None = None
    changes: bool = False
    stored: bool = False
    distinct: bool = False
    drops: bool = False
    columns: Callable[[DataFrame], Sequence[str]] = lambda df: ()
    issues: Callable[[DataFrame], int] | None = None


def _smooth(config: CleaningConfig) -> Callable[[DataFrame], clean.Fitted]:
    def fit(df: DataFrame) -> clean.Fitted:
        if not config.order_by:
            raise ValueError("noise reduction needs order_by: a table has no row order of its own")
        columns = numeric_columns(df, config.kept)
        parameters = {c: {"window": NOISE_WINDOW} for c in columns}
        smooth = lambda d: series.reduce_noise(d, columns, config.order_by, config.key, NOISE_WINDOW)
        return clean.Fitted(smooth, parameters, once=True)

    return fit


def _impute(config: CleaningConfig) -> Callable[[DataFrame], clean.Fitted]:
    from tidewell.operators.neighbours import impute_knn

    return lambda df: clean.fit_impute(df, config.impute_strategy, config.kept, impute_knn)


def _plain(run: Callable[[DataFrame], DataFrame], once: bool = False) -> Callable[[DataFrame], clean.Fitted]:
    """A step without statistics."""
    return lambda df: clean.Fitted(run, once=once)


def _optional(wanted: bool, fit: Callable[[DataFrame], clean.Fitted]):
    return fit if wanted else None


def named_steps(algorithm: str, config: CleaningConfig) -> list[Step]:
    """The steps of a named run; an unknown name is an error."""
    kept = config.kept
    numbers = lambda df: numeric_columns(df, kept)
    words = lambda df: text_columns(df, kept)
    # The ids of the steps.
    impute = Step("impute_values", "Fill missing values", "ml", f"{config.impute_strategy} imputation", _impute(config), True,
                  columns=lambda df: [*numbers(df), *words(df)])
    # Later steps of a full run read the distinct rows several times, so those are written once.
    dedupe = Step("remove_duplicates", "Remove duplicate rows", "cleaning", "exact row match",
                  _plain(clean.remove_duplicates, once=True), True, True, True, columns=lambda df: df.columns)
    cap = Step("cap_outliers", "Cap outliers", "ml", f"{config.outlier_method} outlier detection",
               lambda df: clean.fit_clip(df, kept), columns=numbers)
    types = Step("apply_types", "Correct data types", "cleaning", "type coercion", lambda df: clean.fit_types(df),
                 columns=text_columns)
    scale = Step("apply_normalize", "Normalise numbers", "ml", "min-max scaling", lambda df: clean.fit_normalise(df, kept),
                 columns=numbers)
    texts = Step("apply_text_cleaning", "Clean text", "nlp", "text normalisation",
                 _plain(lambda df: clean.clean_text(df, kept)), columns=words)

    def framed(scan: str, step: Step, check: str, technique: str, issues: Callable[[DataFrame], int]) -> list[Step]:
        """The step between a count of what it is to mend and the same count afterwards."""
        first = Step(scan, f"Before: {step.label.lower()}", "profiling", technique, columns=step.columns, issues=issues)
        return [first, step, replace(first, id=check, label=f"After: {step.label.lower()}", stage="validation")]

    def one(df: DataFrame, count: Column) -> int:
        return int(df.agg(count).first()[0] or 0)

    def missing(df: DataFrame) -> int:
        return one(df, profile.missing_total(df))

    def repeated(df: DataFrame) -> int:
        return profile.duplicate_count(df).first()[0]

    def outlying(df: DataFrame) -> int:
        return profile.iqr_outlier_count(df, numbers(df)).first()[0]

    def mistyped(df: DataFrame) -> int:
        return sum(a != b for a, b in zip(df.dtypes, clean.correct_types(df).dtypes))

    def unscaled(df: DataFrame) -> int:
        return one(df, profile.total([F.count_if(~col(c).between(0, 1)) for c in numbers(df)]))

    def unclean(df: DataFrame) -> int:
        return one(df, profile.total([F.count_if(col(c) != clean_text(col(c))) for c in words(df)]))

    plans: dict[str, Callable[[], list[Step]]] = {
        "missing_values": lambda: framed("scan_missing", impute, "validate_missing", "null count", missing),
        "duplicates": lambda: framed(
            "scan_duplicates", replace(dedupe, stored=False), "validate_dedup", "repeated rows", repeated
        ),
        "outliers": lambda: framed("profile_numeric", cap, "validate_outliers", "values outside 1.5 IQR", outlying),
        "data_types": lambda: framed("infer_types", types, "validate_types", "text columns of another type", mistyped),
        "normalization": lambda: framed("profile_scale", scale, "validate_scale", "values outside 0 to 1", unscaled),
        "text_cleaning": lambda: framed("profile_text", texts, "validate_text", "texts that cleaning changes", unclean),
        "full_pipeline": lambda: [
            dedupe,
            impute,
            cap,
            types,
            replace(scale, fit=_optional(config.normalize, scale.fit)),
            Step("standardize", "Standardise numbers", "ml", "z-score scaling",
                 _optional(config.standardize, lambda df: clean.fit_standardise(df, kept)), columns=numbers),
            Step("noise_reduction", "Reduce noise", "ml", "moving mean", _optional(config.reduce_noise, _smooth(config)), True,
                 columns=numbers),
            replace(texts, fit=_optional(config.clean_text, texts.fit)),
            Step("rules", "Apply rules", "validation", "range and pattern rules",
                 _optional(bool(config.rules), _plain(lambda df: clean.apply_rules(df, config.rules))),
                 columns=lambda df: [c for c in config.rules if c in df.columns]),
            Step("references", "Check references", "validation", "reference tables",
                 _optional(bool(config.reference_data), _plain(lambda df: clean.keep_referenced(df, config.reference_data))), True,
                 drops=True, columns=lambda df: [c for c in config.reference_data if c in df.columns]),
        ],
    }
    if algorithm not in plans:
        raise ValueError(f"unsupported algorithm: {algorithm}")
    return plans[algorithm]()


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        if step.fit is not None:
            df = step.fit(df).apply(df)
            df = materialise(df) if step.stored else df
    return df


def clean_table(df: DataFrame, algorithm: str = "full_pipeline", config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Run a named cleaning algorithm."""
    return run_steps(df, named_steps(algorithm, config))


def clean_with_log(
    df: DataFrame,
    algorithm: str = "full_pipeline",
    config: CleaningConfig = CleaningConfig(),
    at: dt.datetime | None = None,
    log: progress.RunLog | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The cleaned and structured table, written, and its log with one row per step.

    ``log`` gets an event whenever a step starts, is fitted, completes or fails, and can be read all the while. Rows and
    completeness come from the jobs that write the table, after steps that can change them; other steps keep the figures. A step that the settings leave out is logged as skipped. ``at`` is the time the log states.
    """
    steps = named_steps(algorithm, config)
    log = log or progress.RunLog(df.sparkSession, at=at)
    watch = progress.Watch()
    # Statistics are taken from ``df``; ``watched`` is the same table with the points that the writes observe.
    watched = watch.mark(df, START)
    done: list[tuple[Step, dict]] = []
    finish = Step("structuring", "Convert to a flat table", "structuring", "column flattening")
    for seq, step in enumerate([*steps, finish]):
        about = {
            "seq": seq, "step_id": step.id, "label": step.label, "stage": step.stage, "technique": step.technique,
            "progress": min(100, int((seq + 1) / len(steps) * 100)),
        }
        if step.fit is None and step.issues is None and step is not finish:
            about["columns_affected"] = 0
            log.write(**about, status="skipped")
            done.append((step, about))
            continue
        log.write(**about, status="running")
        try:
            if step is finish:
                fitted = structure.fit_structure(df)
                about["parameters"] = fitted.parameters
                df = watch.write(watched, fitted.apply)
                about["columns_affected"] = len(df.columns)
            else:
                about["columns_affected"] = len(step.columns(df))
                about["issues"] = step.issues(df) if step.issues is not None else None
            if step.fit is not None:
                fitted = step.fit(df)
                about["parameters"] = fitted.parameters
                if step.drops:  # what the points before have counted must not go
                    watched = df = watch.write(watched)
                watched = watch.distinct(watched) if step.distinct else fitted.apply(watched)
                watched = watch.mark(watched, seq) if step.changes else watched
                watched = watch.write(watched) if step.stored else watched
                df = watch.shown(watched) if fitted.once or step.stored or step.drops else fitted.apply(df)
        except Exception as error:
            log.write(**about, status="error", error=str(error)[:2000])
            raise
        if step is not finish:
            log.write(**about, status="fitted")
        done.append((step, about))
    rows, full = watch.figures(START)
    for seq, (step, about) in enumerate(done):
        before, had = full, rows
        if step.fit is not None and step.changes:
            rows, full = watch.figures(seq)
        score = min(1.0, full / max(before, 0.01)) if step.fit is not None else None
        left_out = step.fit is None and step.issues is None and step is not finish
        log.write(
            **about, status="skipped" if left_out else "completed", row_count=rows, quality_score=score, rows_removed=had - rows
        )
    return df, log.latest().where(F.col("kind") == progress.STEP)


def adaptive_cleaning(
    df: DataFrame,
    scores: DataFrame,
    store: DatasetStore,
    raw_data_id: int,
    cleaned_data_id: int,
    algorithm: str = "full_pipeline",
    config: CleaningConfig = CleaningConfig(),
    at: dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean with the strategy that the shape of the data and the quality history suggest, and store the result.

    Returns the structured table, the log, and one row with the settings used and the improvement. The store gets the
    whole result, its sector variants and the scores of the steps.
    """
    shape = profile.data_characteristics(df, numeric_columns(df, config.kept))
    strategy = history.cleaning_strategy(shape, history.quality_history(scores))
    chosen = strategy.first().asDict()
    cleaned, log = clean_with_log(df, algorithm, config.with_strategy(chosen), at)
    measured = {row["step_id"]: row["quality_score"] for row in quality_scores(log).collect()}  # one row per step
    store.save_variants(cleaned, raw_data_id, algorithm, measured, cleaned_data_id)
    settings = [F.lit(value).alias(name) for name, value in chosen.items()]
    return cleaned, log, profile.cleaning_improvement(df, cleaned).select(*settings, "*")


def quality_scores(log: DataFrame) -> DataFrame:
    """Score per step, the last run of a step winning."""
    scored = log.where(F.col("quality_score").isNotNull())
    return scored.groupBy("step_id").agg(F.max_by("quality_score", "seq").alias("quality_score"))
