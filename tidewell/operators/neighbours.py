"""Exact nearest neighbours without comparing all pairs, and imputation from them.

Donors are put on a grid that gets finer level by level. Each cell keeps its count and the tight box around
its donors. A receiver walks down the levels with a short list of cells and a radius that surely holds k
donors; cells whose nearest edge lies beyond it are dropped, and the radius shrinks on the way. Only donors of the
few cells left are compared. The grid is as deep as the densest spot needs, so a hot spot costs levels, not pairs,
and its first levels cut at quantiles, so heavy tails do not crowd into few cells. Many searches run as one: each has
a key, and rows meet only inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import col, finite
from tidewell.operators.keyed import join_on
from tidewell.operators.ranking import top_n_per_key
from tidewell.session import materialise

GRID_BITS = 24
# Donors a cell of the finest level may hold.
LEAF_ROWS = 64
# Levels that a walk goes down at once, and steps between two shuffles that shrink the radius.
STRIDE = 2
TIGHTEN_EVERY = 3
# Levels whose cells are cut at quantiles.
RANK_BITS = 5
# Levels of at most so many cells are sent to all tasks: dealt by cell, their rows would meet in a few tasks.
COARSE_CELLS = 16384
# Receivers a task holds with their cells and candidates, and donors a task sorts.
TASK_ROWS = 100_000
TASK_DONORS = 500_000


def _near(dims: int) -> Column:
    """Squared distance from the receiver to the nearest edge of a box."""
    return _sum([
        F.pow(F.greatest(F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}"), F.lit(0.0)), 2)
        for i in range(dims)
    ])


def _far(dims: int) -> Column:
    """Squared distance from the receiver to the farthest corner of a box."""
    return _sum([
        F.pow(F.greatest(F.abs(F.col(f"x{i}") - F.col(f"lo{i}")), F.abs(F.col(f"x{i}") - F.col(f"hi{i}"))), 2)
        for i in range(dims)
    ])


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _at_level(dims: int, level: str | int) -> dict[str, Column]:
    """Cells ``c*`` of a grid level from the finest codes ``g*``."""
    return {f"c{i}": F.expr(f"shiftright(g{i}, {GRID_BITS} - {level})") for i in range(dims)}


def _cell_boxes(donors: DataFrame, dims: int, first: int, last: int) -> DataFrame:
    """Count and tight box of every occupied cell of the given grid levels; the finest boxes make up the others."""
    names = [f"c{i}" for i in range(dims)]
    edges = [f(f"y{i}").alias(f"{e}{i}") for i in range(dims) for e, f in (("lo", F.min), ("hi", F.max))]
    leaves = donors.groupBy("s", *[c.alias(f"f{i}") for i, c in enumerate(_at_level(dims, last).values())])
    leaves = leaves.agg(F.count(F.lit(1)).alias("n"), *edges)
    spread = leaves.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumns(
        {f"c{i}": F.expr(f"shiftright(f{i}, {last} - level)") for i in range(dims)}
    )
    wider = [f(f"{e}{i}").alias(f"{e}{i}") for i in range(dims) for e, f in (("lo", F.min), ("hi", F.max))]
    return materialise(spread.groupBy("s", "level", *names).agg(F.sum("n").alias("n"), *wider), folders=["level"])


class _Grid:
    """The boxes of each level, read from a folder of their own so that the planner knows their size."""

    def __init__(self):
        self.tables, self.cells = {}, {}

    def add(self, boxes: DataFrame) -> None:
        reader = boxes.sparkSession.read.schema(boxes.drop("level").schema)
        for row in boxes.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("most")).collect():
            self.tables[row["level"]] = reader.parquet(f"{boxes.table_path}/level={row['level']}")
            self.cells[row["level"]] = row["cells"]
            self.most = row["most"] if row["level"] == max(self.tables) else self.most

    def at(self, level: int) -> DataFrame:
        table = self.tables[level]
        return F.broadcast(table) if self.cells[level] <= COARSE_CELLS else table

    def together(self, coarse: bool) -> DataFrame | None:
        """All coarse or all other levels as one table."""
        chosen = [t.withColumn("level", F.lit(n)) for n, t in self.tables.items() if (self.cells[n] <= COARSE_CELLS) == coarse]
        if not chosen:
            return None
        found = reduce(DataFrame.unionByName, chosen)
        return F.broadcast(found) if coarse else found


def nearest(receivers: DataFrame, donors: DataFrame, dims: int, k: int) -> DataFrame:
    """(s, rid, dist2, value, y0..): the k nearest donors of each receiver, ties by donor place and value.

    ``receivers`` has s, rid and x0.., ``donors`` has s, value and y0..; ``s`` names the search in which they meet. All
    coordinates are doubles without nulls. A receiver of a search without donors has no rows.
    """
    xs, ys, names = ([f"{v}{i}" for i in range(dims)] for v in "xyc")
    # No receiver needs more than k donors of one place.
    donors = materialise(top_n_per_key(donors.select("s", *ys, "value"), ["s", *ys], [F.asc("value")], k))
    shares = [n / (1 << RANK_BITS) for n in range(1, 1 << RANK_BITS)]
    cuts = [
        F.concat(F.array(F.min(y)), F.percentile_approx(y, shares), F.array(F.max(y))).alias(f"cuts{i}")
        for i, y in enumerate(ys)
    ]
    spans = materialise(donors.groupBy("s").agg(F.count(F.lit(1)).alias("donors"), *cuts))
    most, total = spans.agg(F.max("donors"), F.sum("donors")).first()

    def with_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Finest codes: the number of the quantile bucket, then the place inside it."""
        rest = GRID_BITS - RANK_BITS
        codes = {}
        for i, c in enumerate(columns):
            value, edges = F.col(c), F.col(f"cuts{i}")
            bucket = F.least(F.size(F.filter(edges, lambda edge: edge < value)), F.lit(1 << RANK_BITS))
            bucket = F.greatest(bucket - 1, F.lit(0))
            low, high = F.get(edges, bucket), F.get(edges, bucket + 1)
            share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
            inside = F.least(F.greatest(F.floor(share * (1 << rest)), F.lit(0)), F.lit((1 << rest) - 1))
            codes[f"g{i}"] = (bucket.cast("bigint") * (1 << rest) + inside).cast("bigint")
        return join_on(df, spans, ["s"]).withColumns(codes).drop("donors", *[f"cuts{i}" for i in range(dims)])

    donors = materialise(with_codes(donors, ys))
    receivers = materialise(with_codes(receivers.select("s", "rid", *xs), xs))
    if not most:
        return join_on(receivers, donors, ["s"]).select("s", "rid", F.lit(0.0).alias("dist2"), "value", *ys)
    spark = donors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), receivers.count() // TASK_ROWS, total // TASK_DONORS)
    dealt = receivers.repartition(parts, "s", "rid")  # files may pack many receivers into a task

    # Deepen the grid until no cell holds many donors.
    depth, grid = 0, _Grid()
    while True:
        more = 4 if depth else max(2, math.ceil(math.log2(max(most / LEAF_ROWS, 2)) / dims))
        last = min(depth + more, GRID_BITS)
        grid.add(_cell_boxes(donors, dims, depth + 1, last))
        depth = last
        if grid.most <= LEAF_ROWS or depth == GRID_BITS:
            break

    # First radius: the farthest corner of the smallest cell around the receiver that holds k donors.
    radii = []
    for coarse in (True, False):
        boxes = grid.together(coarse)
        if boxes is not None:
            levels = [n for n, cells in grid.cells.items() if (cells <= COARSE_CELLS) == coarse]
            of = dealt.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns(_at_level(dims, "level"))
            around = of.join(boxes, ["s", "level", *names]).where(F.col("n") >= k)
            radii.append(around.groupBy("s", "rid").agg(F.min(_far(dims)).alias("radius")))
    radius = reduce(DataFrame.unionByName, radii).groupBy("s", "rid").agg(F.min("radius").alias("radius"))
    frontier = join_on(receivers.select("s", "rid", *xs), radius, ["s", "rid"], "left").withColumns(
        {c: F.lit(0).cast("bigint") for c in names}
    )
    by_far = Window.partitionBy("s", "rid").orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = F.col("radius").isNotNull() & (F.col("near") > F.col("radius") * (1 + 1e-9))
    above, last = 0, None
    for step, level in enumerate([*range(STRIDE, depth, STRIDE), depth], start=1):
        child = grid.at(level).withColumnsRenamed({c: f"to_{c}" for c in ("s", *names)})
        same = F.col("s") == F.col("to_s")
        for c in names:
            same = same & (F.col(c) == F.shiftright(F.col(f"to_{c}"), level - above))
        above = level
        opened = frontier.join(child, same).select(
            "s", "rid", *xs, "radius", *[F.col(f"to_{c}").alias(c) for c in names], "n",
            _near(dims).alias("near"), _far(dims).alias("far"),
        )
        frontier = opened.where(~beyond)
        if step % TIGHTEN_EVERY == 0 or level == depth:
            # The smallest far bound whose cells hold k donors in all.
            enough = F.min(F.when(F.col("_seen") >= k, F.col("far"))).over(Window.partitionBy("s", "rid"))
            seen = frontier.repartition(parts, "s", "rid").withColumn("_seen", F.sum("n").over(by_far))
            last = materialise(seen.withColumn("radius", F.least("radius", enough)).where(~beyond).drop("_seen"), last)
            frontier = last
        frontier = frontier.select("s", "rid", *xs, "radius", *names)
    placed = donors.withColumns(_at_level(dims, depth))
    dist2 = _sum([(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(xs, ys)])
    found = frontier.repartition(parts, "s", *names).join(placed, ["s", *names])
    found = found.select("s", "rid", "radius", dist2.alias("dist2"), "value", *ys)
    # The radius holds k donors, so that few candidates are left to be sorted.
    within = F.col("radius").isNull() | (F.col("dist2") <= F.col("radius") * (1 + 1e-9))
    found = found.where(within).drop("radius").repartition(parts, "s", "rid")
    return top_n_per_key(found, ["s", "rid"], [F.asc(c) for c in ("dist2", *ys, "value")], k)


def impute_knn(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Fill each numeric gap with the mean over the k nearest rows that have the value.

    The distance uses the columns both rows have, scaled up by the share of columns compared. A search is a gap column
    with the pattern of missing columns on either side, and all searches run as one; columns that a search does not
    compare are 0 on both sides. A row that shares no column with any donor gets the column mean.
    """
    columns = list(columns)
    values = [f"_v{j}" for j in range(len(columns))]
    tagged = df.withColumns({v: finite(col(c).cast("double")) for v, c in zip(values, columns)})
    mask = F.concat(*[F.when(F.col(v).isNull(), "0").otherwise("1") for v in values])
    rows = materialise(tagged.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_mask", mask))
    stats = rows.agg(F.count(F.lit(1)), *[F.count(v) for v in values], *[F.avg(v) for v in values]).first()
    counts, means = stats[1 : 1 + len(values)], stats[1 + len(values) :]
    usable = [j for j, n in enumerate(counts) if n]
    gaps = [j for j in usable if counts[j] < stats[0]]
    if not gaps:
        return df

    def has(side: str, j) -> Column:
        return F.substring(F.col(f"{side}_mask"), j + 1, 1) == "1"

    def both(j: int) -> Column:
        return has("r", j) & has("d", j)

    patterns = rows.select("_mask").distinct()
    gap = F.array(*[F.lit(j) for j in gaps])
    at = lambda j: F.substr(F.col("_mask"), j + 1, F.lit(1))
    lacking = patterns.select(F.col("_mask").alias("r_mask"), F.explode(F.filter(gap, lambda j: at(j) == "0")).alias("j"))
    having = patterns.select(F.col("_mask").alias("d_mask"), F.explode(F.filter(gap, lambda j: at(j) == "1")).alias("j"))
    shared = F.lit(0)
    for j in usable:
        shared = shared + both(j).cast("int")
    searches = lacking.join(having, "j").withColumn("shared", shared).where("shared > 0")
    searches = materialise(searches.withColumn("s", F.concat_ws(":", "j", "r_mask", "d_mask")))
    # A row meets all searches of its pattern, so a task that reads a whole file would sort many times its rows.
    meets = searches.groupBy("d_mask").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    spread = rows.repartition(stats[0] * meets // TASK_DONORS + 1, "_rid")

    def placed(side: str, axis: str, *more: Column) -> DataFrame:
        sought = spread.join(searches, F.col("_mask") == F.col(f"{side}_mask"))
        place = [F.when(both(j), F.col(values[j])).otherwise(0.0).alias(f"{axis}{p}") for p, j in enumerate(usable)]
        return sought.select("s", *more, *place)

    value = F.element_at(F.array(*values), F.col("j") + 1).alias("value")
    found = nearest(placed("r", "x", F.col("_rid").alias("rid")), placed("d", "y", value), len(usable), k)
    found = found.join(searches, "s")
    pairs = F.array(*[F.struct(both(j).alias("in"), F.col(f"y{p}").alias("y")) for p, j in enumerate(usable)])
    place = F.transform(F.filter(pairs, lambda pair: pair["in"]), lambda pair: pair["y"])
    near = found.select("rid", "j", (F.col("dist2") * (len(usable) / F.col("shared"))).alias("d"), place.alias("place"), "value")
    best = top_n_per_key(near, ["rid", "j"], [F.asc("d"), F.asc("place"), F.asc("value")], k)
    wide = best.groupBy(F.col("rid").alias("_rid")).agg(
        *[F.avg(F.when(F.col("j") == j, F.col("value"))).alias(f"_fill{j}") for j in gaps]
    )
    filled = {
        columns[j]: F.coalesce(F.col(values[j]), F.col(f"_fill{j}"), F.lit(means[j])) for j in gaps
    }
    return join_on(rows, wide, ["_rid"], "left").withColumns(filled).select(*map(col, df.columns))
