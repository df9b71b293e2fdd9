"""Exact linear-interpolated quantiles that never hold a whole column or group in one task.

Mergeable sketches bracket the value at each wanted rank, exact counts confirm the bracket, and brackets that still hold
many values are narrowed again from inside. Only the values of a bracket are ranked, as value counts in the long form
(bracket, value), so that every bracket is a small group of its own in one shuffle for all columns or groups. Rows that
share a value are one row there, and a value that holds most rows becomes an edge of its bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import col
from tidewell.operators.keyed import join_on
from tidewell.session import materialise

# Values strictly inside a bracket that are ranked in one task.
RANKED_VALUES = 100_000
SKETCH_ACCURACY = 10_000
# Columns whose sketches meet in one task.
COLUMNS_PER_JOB = 64
# Times a sketch may fail to narrow a bracket before it is ranked as it is; ranking sorts on disk, so it stays exact.
ATTEMPTS = 4
# Ranks at which the sketch of a group is read, as no group can have shares of its own.
GRID = 64


@dataclass
class _Spot:
    """A wanted rank of a column and the closed bracket that holds it; an edge of None leaves its side open."""

    rank: int
    inside: int  # values strictly between the edges
    low: float | None = None
    high: float | None = None
    below: int = 0  # values under ``low``
    first: int = 0  # values equal to ``low``
    proposed: tuple[float | None, float | None] | None = None
    answer: float | None = None
    failed: int = 0

    def wide(self) -> bool:
        return self.answer is None and self.inside > RANKED_VALUES and self.failed < ATTEMPTS

    def slack(self) -> float:
        """How far from its rank, as a share, the sketch is read."""
        return 4 ** (1 + self.failed) / SKETCH_ACCURACY

    def held(self, v: Column, closed: bool) -> Column:
        return _held(v, self.low, self.high, closed)


def _held(v: Column, low: float | None, high: float | None, closed: bool) -> Column:
    found = v.isNotNull()
    if low is not None:
        found = found & (v >= F.lit(low) if closed else v > F.lit(low))
    if high is not None:
        found = found & (v <= F.lit(high) if closed else v < F.lit(high))
    return found


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], least: int = 1
) -> dict[str, list[float] | None]:
    """Quantiles of each column over the whole frame; None for a column of fewer than ``least`` values."""
    found: dict[str, list[float] | None] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        batch = columns[start : start + COLUMNS_PER_JOB]
        found.update(zip(batch, _of_columns(df, batch, probs, max(least, 1))))
    return found


def _of_columns(df: DataFrame, columns: Sequence[str], probs: Sequence[float], least: int) -> list[list[float] | None]:
    values = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    slack = 4 / SKETCH_ACCURACY
    shares = [min(max(edge, 0.0), 1.0) for p in probs for edge in (p - slack, p + slack)]
    stats = values.agg(*[
        F.struct(F.count(v).alias("n"), F.percentile_approx(v, shares, SKETCH_ACCURACY).alias("edges")).alias(v)
        for v in values.columns
    ]).first()
    spots: dict[tuple[int, int], _Spot] = {}
    for i, (n, edges) in enumerate(stats):
        for k, p in enumerate(probs if n >= least else ()):
            low = edges[2 * k] if p > slack else None
            high = edges[2 * k + 1] if p < 1 - slack else None
            for rank in (math.floor((n - 1) * p), math.ceil((n - 1) * p)):
                spots[i, rank] = _Spot(rank, n, proposed=(low, high))
    while wide := {at: spot for at, spot in spots.items() if spot.wide()}:
        _confirm(values, wide, [n for n, _ in stats])
        wide = {at: spot for at, spot in wide.items() if spot.wide()}
        if wide:
            _propose(values, wide)
    _rank(values, {at: spot for at, spot in spots.items() if spot.answer is None})
    out: list[list[float] | None] = []
    for i, (n, _) in enumerate(stats):
        found = []
        for p in probs if n >= least else ():
            place = (n - 1) * p
            first, second = spots[i, math.floor(place)].answer, spots[i, math.ceil(place)].answer
            found.append(first + (second - first) * (place - math.floor(place)))
        out.append(found or None)
    return out


def _confirm(values: DataFrame, spots: dict[tuple[int, int], _Spot], sizes: Sequence[int]) -> None:
    """Take over the proposed brackets that hold their rank, by exact counts of all of them in one pass."""
    asked = list(dict.fromkeys((i, *spot.proposed) for (i, _), spot in spots.items()))
    counts = []
    for i, low, high in asked:
        v = F.col(f"v{i}")
        nothing, all_values = F.lit(0).cast("bigint"), F.lit(sizes[i])
        counts.append(F.struct(
            (nothing if low is None else F.count_if(v < F.lit(low))).alias("below"),
            (nothing if low is None else F.count_if(v == F.lit(low))).alias("first"),
            F.count_if(_held(v, low, high, False)).alias("inside"),
            (all_values if high is None else F.count_if(v <= F.lit(high))).alias("upto"),
        ))
    row = values.agg(*[c.alias(f"b{k}") for k, c in enumerate(counts)]).first()
    found = dict(zip(asked, row))
    for (i, rank), spot in spots.items():
        below, first, inside, upto = found[(i, *spot.proposed)]
        if not below <= rank < upto:  # the sketch left its error bound: reach further
            spot.failed += 1
            continue
        if rank < below + first:
            spot.answer = spot.proposed[0]
        elif rank >= below + first + inside:
            spot.answer = spot.proposed[1]
        spot.failed = spot.failed + 1 if inside > spot.inside // 2 else 0
        spot.low, spot.high = spot.proposed
        spot.below, spot.first, spot.inside = below, first, inside


def _propose(values: DataFrame, spots: dict[tuple[int, int], _Spot]) -> None:
    """Sketch the values strictly inside each bracket for a narrower one."""
    arounds, sketches = [], []
    for k, ((i, rank), spot) in enumerate(spots.items()):
        v = F.col(f"v{i}")
        share = (rank - spot.below - spot.first + 0.5) / spot.inside
        arounds.append((share - spot.slack(), share + spot.slack()))
        inner = F.when(spot.held(v, False), v)
        inside = [min(max(s, 0.0), 1.0) for s in arounds[-1]]
        sketches.append(F.percentile_approx(inner, inside, SKETCH_ACCURACY).alias(f"s{k}"))
    for spot, (left, right), (low, high) in zip(spots.values(), arounds, values.agg(*sketches).first()):
        spot.proposed = (low if left > 0 else spot.low, high if right < 1 else spot.high)


def _rank(values: DataFrame, spots: dict[tuple[int, int], _Spot]) -> None:
    """Find the value at each rank. All brackets share one shuffle, keyed by the bracket."""
    brackets: dict[tuple, list[_Spot]] = {}
    for (i, _), spot in spots.items():
        brackets.setdefault((i, spot.low, spot.high), []).append(spot)
    if not brackets:
        return
    entries, ranks = [], []
    for number, ((i, _, _), members) in enumerate(brackets.items()):
        v = F.col(f"v{i}")
        entries.append(F.when(members[0].held(v, True), F.struct(F.lit(number).alias("b"), v.alias("v"))))
        ranks.append(F.array(*[F.lit(spot.rank - spot.below).cast("bigint") for spot in members]))
    counted = values.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("n").over(running)).withColumn("wanted", F.get(F.array(*ranks), F.col("b")))
    held = F.filter("wanted", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    found = {(row["b"], row["r"]): row["v"] for row in ranked.select("b", "v", F.explode(held).alias("r")).collect()}
    for number, members in enumerate(brackets.values()):
        for spot in members:
            spot.answer = found[number, spot.rank - spot.below]


# ---- groups -----------------------------------------------------------------------------------------------

SPOT = "array<struct<spot: int, place: double, low: double, high: double, below: bigint, first: bigint, inside: bigint, failed: int>>"
SPOT_FIELDS = ["spot", "place", "low", "high", "below", "first", "inside", "failed"]


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Quantiles of ``column`` per group, one output column per probability.

    The spots of a group (place of the rank, closed bracket with open sides null, values below it, on its lower edge and
    inside) travel as one row; groups of ``RANKED_VALUES`` at most keep their whole range as bracket.
    """
    keys = list(keys)
    # Read several times, and narrow whatever it comes from.
    values = materialise(df.where(col(column).isNotNull()).select(*map(col, keys), col(column).cast("double").alias("_v")))
    sizes = values.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_n"))
    spot = [
        F.struct(F.lit(k), (F.col("_n") - 1) * F.lit(float(p)), *[F.lit(None)] * 2, *[F.lit(0)] * 2, "_n", F.lit(0))
        for k, p in enumerate(probs)
    ]
    whole = sizes.select(*map(col, keys), F.array(*spot).cast(SPOT).alias("_spots"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    spots = _narrowed(values, whole, keys) if largest > RANKED_VALUES else whole
    inside = _beside(values, spots, keys).where(_in_bracket(">=", "<="))
    counted = inside.groupBy(*map(col, keys), "spot", "place", "below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*map(col, keys), "spot").orderBy("_v")
    upto = F.col("below") + F.sum("_c").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", upto).withColumn("rank", F.floor("place"))
    lower = F.min(F.when(F.col("_upto") > F.col("rank"), F.col("_v")))
    upper = F.min(F.when(F.col("_upto") > F.col("rank") + 1, F.col("_v")))
    part = F.first("place") - F.first("rank")
    # With no value above the lower one the rank is the last, and the place has no fraction.
    value = lower + (F.coalesce(upper, lower) - lower) * part
    picked = ranked.groupBy(*map(col, keys), "spot").agg(value.alias("_q"))
    return picked.groupBy(*map(col, keys)).agg(
        *[F.max(F.when(F.col("spot") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)]
    )


def _in_bracket(above: str, below: str) -> str:
    return f"(low IS NULL OR _v {above} low) AND (high IS NULL OR _v {below} high)"


def _beside(values: DataFrame, spots: DataFrame, keys: list[str]) -> DataFrame:
    """Every value once for each spot of its group."""
    joined = join_on(values, spots, keys) if keys else values.join(spots)  # without keys: one row of spots
    return joined.select(*map(col, keys), "_v", F.inline("_spots"))


def _narrowed(values: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Spots whose brackets hold ``RANKED_VALUES`` values at most between their edges.

    A round sketches what lies inside the brackets that are too wide and confirms the narrower ones by exact counts; all
    groups share its two passes.
    """
    state = materialise(whole)
    grid = [k / GRID for k in range(GRID + 1)]
    too_wide = lambda s: (s["inside"] > RANKED_VALUES) & (s["failed"] < ATTEMPTS)
    by_spot = [*map(col, keys), "spot"]
    while True:
        wide = state.withColumn("_spots", F.filter("_spots", too_wide)).where(F.size("_spots") > 0)
        if wide.isEmpty():
            return state
        inner = _beside(values, wide, keys).where(_in_bracket(">", "<"))
        sketched = inner.groupBy(*by_spot).agg(
            F.percentile_approx("_v", grid, SKETCH_ACCURACY).alias("_grid"),
            *[F.first(c).alias(c) for c in SPOT_FIELDS if c != "spot"],
        )
        before = F.col("below") + F.col("first")
        step = F.pow(F.lit(4), F.col("failed"))  # grid steps beyond the one that holds the rank
        left = F.floor((F.floor("place") - before) / F.col("inside") * GRID) - step
        right = F.ceil((F.ceil("place") - before + 1) / F.col("inside") * GRID) + step
        asked = sketched.select(
            *by_spot, *[c for c in SPOT_FIELDS if c != "spot"],
            F.when(left <= 0, F.col("low")).otherwise(F.get("_grid", left.cast("int"))).alias("_a"),
            F.when(right >= GRID, F.col("high")).otherwise(F.get("_grid", right.cast("int"))).alias("_b"),
        )
        fields = F.collect_list(F.struct(*SPOT_FIELDS, "_a", "_b")).alias("_spots")
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        counted = _beside(values, asked.groupBy(*map(col, keys)).agg(fields), keys).groupBy(*by_spot).agg(
            *[F.first(c, ignorenulls=False).alias(c) for c in [*SPOT_FIELDS[1:], "_a", "_b"]],
            F.count_if(v < a).alias("_below"),
            F.count_if(v == a).alias("_first"),
            F.count_if((a.isNull() | (v > a)) & (b.isNull() | (v < b))).alias("_inside"),
            F.count_if(b.isNull() | (v <= b)).alias("_upto"),
        )
        state = materialise(_taken_over(state, counted, keys), replaces=state)


def _taken_over(state: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """The state with the counted brackets that hold both ranks of their place in the stead of their old ones."""
    sure = (F.col("_below") <= F.floor("place")) & (F.col("_upto") > F.ceil("place"))
    inner = F.col("_below") + F.col("_first")
    # Both ranks on one edge: the bracket is that value.
    on_low = sure & (F.ceil("place") < inner)
    on_high = sure & (F.floor("place") >= inner + F.col("_inside"))
    shrunk = sure & (F.col("_inside") <= F.col("inside") / 2)
    found = counted.select(
        *map(col, keys), "spot", "place",
        F.when(on_high, F.col("_b")).when(sure, F.col("_a")).otherwise(F.col("low")).alias("low"),
        F.when(on_low, F.col("_a")).when(sure, F.col("_b")).otherwise(F.col("high")).alias("high"),
        F.when(on_high, inner + F.col("_inside")).when(sure, F.col("_below")).otherwise(F.col("below")).alias("below"),
        F.when(on_high, 0).when(sure, F.col("_first")).otherwise(F.col("first")).alias("first"),
        F.when(on_low | on_high, 0).when(sure, F.col("_inside")).otherwise(F.col("inside")).alias("inside"),
        F.when(shrunk, 0).otherwise(F.col("failed") + 1).alias("failed"),
    )
    found = found.groupBy(*map(col, keys)).agg(F.collect_list(F.struct(*SPOT_FIELDS)).cast(SPOT).alias("_new"))
    both = join_on(state, found, keys, "left") if keys else state.join(found)
    fresh = F.coalesce(F.transform("_new", lambda s: s["spot"]), F.array().cast("array<int>"))
    kept = F.filter("_spots", lambda s: ~F.array_contains(fresh, s["spot"]))
    merged = F.concat(kept, F.coalesce("_new", F.array().cast(SPOT))).alias("_spots")
    return both.select(*map(col, keys), merged)
