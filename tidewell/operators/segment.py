"""Segments and density outliers."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col, finite, numeric_columns
from tidewell.operators.keyed import join_on
from tidewell.session import materialise

# Compare points of undecided cell pairs directly while there are at most this many pairs per point.
PAIRS_PER_POINT = 16
FREE_PAIRS = 1_000_000
MAX_SPLITS = 40


def kmeans_segments(df: DataFrame, k: int = 3, columns: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds ``cluster``, null for rows that lack one of the columns; unchanged when there is no numeric column.

    The centres are fitted on the complete rows; every row is returned.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    values = {f"_x{i}": finite(col(c).cast("double")) for i, c in enumerate(columns)}
    assembler = VectorAssembler(inputCols=list(values), outputCol="_features")
    rows = df.withColumns(values)
    complete = rows.na.drop(subset=list(values))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(
        assembler.transform(complete).select("_features")
    )
    centres = F.array(*[F.array(*map(F.lit, map(float, centre))) for centre in model.clusterCenters()])
    point = F.array(*values)
    gaps = F.transform(centres, lambda centre: F.aggregate(
        F.zip_with(centre, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, gap: total + gap
    ))
    place = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
    whole = F.lit(True)
    for value in values:
        whole = whole & F.col(value).isNotNull()
    return rows.withColumn("cluster", F.when(whole, place)).drop(*values)


class _Grid:
    """Cells whose diagonal is just below eps, so all points of a cell are neighbours.

    Cells are sought by their first coordinates alone where there are more than three: the number of neighbouring
    cells would grow as a power of the dimensions. A distance in some coordinates is never above the whole distance,
    so nothing is lost, and whole distances decide.
    """

    def __init__(self, dims: int, eps: float):
        self.dims, self.eps = dims, eps
        self.side = eps / math.sqrt(dims) * (1 - 1e-9)
        self.xs = [f"x{i}" for i in range(dims)]
        self.cells = [f"c{i}" for i in range(dims)]
        reach = math.ceil(eps / self.side)
        self.sought = self.cells if dims <= 3 else self.cells[:2]
        self.offsets = [
            o for o in itertools.product(range(-reach, reach + 1), repeat=len(self.sought))
            if sum((max(abs(v) - 1, 0) * self.side) ** 2 for v in o) <= eps * eps
        ]

    def cell(self) -> list[Column]:
        return [F.floor(F.col(x) / self.side).cast("bigint") for x in self.xs]

    def part(self, split: int) -> list[Column]:
        """Place inside the cell, of 2 ** split along each side; counted from the cell's corner, so it stays small."""
        return [
            F.floor((F.col(x) / self.side - F.col(c)) * float(1 << split)).cast("bigint")
            for x, c in zip(self.xs, self.cells)
        ]

    def around(self, df: DataFrame) -> DataFrame:
        """Each row once per neighbouring cell, with the cell in ``to*``."""
        moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in self.offsets])
        moved = df.withColumn("_o", F.explode(moves))
        return moved.withColumns(
            {f"to{i}": F.col(c) + F.col(f"_o.o{i}") for i, c in enumerate(self.sought)}
        ).drop("_o")

    def near(self, left: str, right: str) -> Column:
        parts = [F.col(f"{left}{x}") - F.col(f"{right}{x}") for x in self.xs]
        total = parts[0] * parts[0]
        for p in parts[1:]:
            total = total + p * p
        return total <= self.eps * self.eps

    def neighbours(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ``left`` beside every row of ``right`` within eps; right columns get ``r_``."""
        named = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
        match = F.lit(True)
        for i, c in enumerate(self.sought):
            match = match & (F.col(f"to{i}") == F.col(f"r_{c}"))
        joined = self.around(left).join(named, match)
        return joined.where(self.near("", "r_"))


def _points(df: DataFrame, key: str, columns: Sequence[str], grid: _Grid) -> DataFrame:
    """Distinct places with their row count, smallest key and cell."""
    placed = df.select(F.col(key).alias("pid"), *[finite(col(c).cast("double")).alias(x) for c, x in zip(columns, grid.xs)])
    distinct = placed.na.drop(subset=grid.xs).groupBy(*grid.xs).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("pid"))
    located = distinct.withColumns(dict(zip(grid.cells, grid.cell())))
    sizes = located.groupBy(*grid.cells).agg(F.sum("n").alias("cell_n"))
    return materialise(join_on(located, sizes, grid.cells))


def _with_core(points: DataFrame, grid: _Grid, min_points: int) -> DataFrame:
    """Adds ``core``. Points of a full cell are core without looking further.

    Only points of cells with fewer than ``min_points`` rows are compared with their neighbourhood, so the
    pairs stay linear in the number of points.
    """
    sparse = points.where(F.col("cell_n") < min_points)
    found = grid.neighbours(sparse.select("pid", *grid.xs, *grid.cells), points.select(*grid.xs, "n", *grid.cells))
    counted = found.groupBy("pid").agg(F.sum("r_n").alias("around"))
    joined = join_on(points, counted, ["pid"], "left")
    core = (F.col("cell_n") >= min_points) | (F.coalesce("around", F.lit(0)) >= min_points)
    return materialise(joined.withColumn("core", core).drop("around"))


def _box_bounds(grid: _Grid) -> tuple[Column, Column]:
    """Squared lower and upper bound of the distance between boxes a and b."""
    low, high = F.lit(0.0), F.lit(0.0)
    for x in grid.xs:
        gap = F.greatest(F.col(f"a_lo_{x}") - F.col(f"b_hi_{x}"), F.col(f"b_lo_{x}") - F.col(f"a_hi_{x}"), F.lit(0.0))
        span = F.greatest(F.col(f"a_hi_{x}") - F.col(f"b_lo_{x}"), F.col(f"b_hi_{x}") - F.col(f"a_lo_{x}"))
        low, high = low + gap * gap, high + span * span
    return low, high


def _boxes(core: DataFrame, grid: _Grid, keys: Sequence[str], *more: Column) -> DataFrame:
    edges = [f(x).alias(f"{b}_{x}") for x in grid.xs for b, f in (("lo", F.min), ("hi", F.max))]
    return core.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *edges, *more)


def _middle(grid: _Grid) -> Column:
    """The point of a cell that lies nearest to the cell's centre."""
    gaps = [F.pow(F.col(x) - (F.col(c) + 0.5) * grid.side, 2) for x, c in zip(grid.xs, grid.cells)]
    return F.min_by(F.struct(*grid.xs), sum(gaps[1:], gaps[0])).alias("mid")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component yet."""
    for side in "ab":
        names = {"node": f"_{side}", "component": f"_in_{side}"}
        pairs = pairs.join(parts.withColumnsRenamed(names), F.col(side) == F.col(f"_{side}"), "left")
    differ = F.coalesce("_in_a", "a") != F.coalesce("_in_b", "b")
    return pairs.where(differ).drop("_a", "_b", "_in_a", "_in_b")


def _side(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{side}_{c}" for c in boxes.columns})


def _cell_edges(core: DataFrame, grid: _Grid) -> DataFrame:
    """(a, b): links between core cells, of the same components as all cells with a core pair within eps.

    ``core`` carries its cell's ``node``. Cell pairs are decided by the tight boxes around their points and by the points
    nearest to the cells' centres. An undecided pair matters only while its cells are in different components; such
    pairs are split into smaller boxes until the boxes decide or few enough points are left to compare.
    """
    limit = grid.eps * grid.eps
    cells = materialise(_boxes(core, grid, ["node", *grid.cells], _middle(grid)))
    left = grid.around(_side(cells, "a").withColumnsRenamed({f"a_{c}": c for c in grid.cells})).drop(*grid.cells)
    match = F.col("a_node") < F.col("b_node")
    for i, c in enumerate(grid.sought):
        match = match & (F.col(f"to{i}") == F.col(f"b_{c}"))
    pairs = left.join(_side(cells, "b"), match)
    low, high = _box_bounds(grid)
    pairs = materialise(
        pairs.where(low <= limit).select(
            F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_m"), F.col("b_m"),
            ((high <= limit) | grid.near("a_mid.", "b_mid.")).alias("sure"),
        )
    )
    parts = connected_components(pairs.where("sure").select("a", "b"))
    open_pairs = materialise(_apart(pairs.where("NOT sure").select("a", "b", "a_m", "b_m"), parts))
    points = core.count()
    split = 0
    subs = [f"s{i}" for i in range(grid.dims)]
    while True:
        work = open_pairs.agg(F.sum(F.col("a_m").cast("double") * F.col("b_m"))).first()[0] or 0.0
        if work <= FREE_PAIRS + PAIRS_PER_POINT * points or split == MAX_SPLITS:
            break
        split += 1
        part = core.withColumns(dict(zip(subs, grid.part(split))))
        boxes = _boxes(part, grid, ["node", *subs])
        for side, node in (("a", "a"), ("b", "b")):
            child = _side(boxes, side)
            same = F.col(node) == F.col(f"{side}_node")
            if split > 1:
                for s in subs:
                    same = same & (F.col(f"{side}_up_{s}") == F.floor(F.col(f"{side}_{s}") / 2))
            open_pairs = open_pairs.drop(f"{side}_m").join(child, same).drop(f"{side}_node", *[f"{side}_up_{s}" for s in subs])
        low, high = _box_bounds(grid)
        kept = [F.col(f"{d}_{s}").alias(f"{d}_up_{s}") for d in "ab" for s in subs]
        judged = materialise(
            open_pairs.where(low <= limit).select("a", "b", "a_m", "b_m", *kept, (high <= limit).alias("sure"))
        )
        won = judged.where("sure").select("a", "b").distinct()
        parts = connected_components(_links(parts).unionByName(won))
        open_pairs = materialise(_apart(judged.where("NOT sure").drop("sure"), parts))
    located = core.withColumns(dict(zip(subs, grid.part(split)))).select("node", *grid.xs, *subs)
    for side in "ab":
        child = located.withColumnsRenamed({"node": f"{side}_node", **{x: f"{side}_{x}" for x in grid.xs}, **{s: f"{side}_{s}" for s in subs}})
        same = F.col(side) == F.col(f"{side}_node")
        if split:
            for s in subs:
                same = same & (F.col(f"{side}_up_{s}") == F.col(f"{side}_{s}"))
        open_pairs = open_pairs.join(child, same)
    close = open_pairs.where(grid.near("a_", "b_")).select("a", "b").distinct()
    return materialise(_links(parts).unionByName(close).distinct())


def _links(parts: DataFrame) -> DataFrame:
    """Each node of a component beside its centre."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the edges (a, b), by alternating star contraction.

    The number of rounds grows with the logarithm of the graph, not with its diameter.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def contract(e: DataFrame, larger: bool) -> DataFrame:
        arcs = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = arcs.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("m"))
        joined = arcs.join(least, F.col("a") == F.col("_a"))
        if larger:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("_a").alias("a"), F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node is either a centre or hangs on exactly one centre."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("arms"), F.lit(0).alias("centre")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("arms"), F.lit(1).alias("centre"))
        )
        nodes = ends.groupBy("node").agg(F.sum("arms").alias("arms"), F.max("centre").alias("centre"))
        return nodes.where((F.col("arms") > 1) | ((F.col("arms") == 1) & (F.col("centre") == 1))).isEmpty()

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialise(links.distinct())
    while not settled(stars):
        stars = materialise(contract(contract(stars, True), False), replaces=stars)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def core_points(df: DataFrame, key: str, columns: Sequence[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Keys of the rows with at least ``min_points`` rows within eps, themselves included."""
    grid = _Grid(len(columns), eps)
    points = _with_core(_points(df, key, columns, grid), grid, min_points)
    core = points.where("core").select(*grid.xs)
    placed = df.select(key, *[finite(col(c).cast("double")).alias(x) for c, x in zip(columns, grid.xs)])
    return placed.join(core, grid.xs, "left_semi").select(key)


def dbscan(df: DataFrame, key: str, columns: Sequence[str] | None = None, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Adds ``outlier``: -1 for noise, else the smallest core key of the row's cluster.

    A border row reachable from several clusters joins the one with the smallest label. Without numeric
    columns every row is noise.
    """
    columns = numeric_columns(df, (key,)) if columns is None else list(columns)
    if not columns:
        return df.withColumn("outlier", F.lit(-1).cast("bigint"))
    grid = _Grid(len(columns), eps)
    points = _with_core(_points(df, key, columns, grid), grid, min_points)
    core = points.where("core").select("pid", *grid.xs, *grid.cells)
    nodes = core.groupBy(*grid.cells).agg(F.min("pid").alias("node"))
    core = materialise(join_on(core, nodes, grid.cells))
    parts = connected_components(_cell_edges(core, grid))
    named = join_on(core, parts, ["node"], "left").withColumn("label", F.coalesce("component", "node"))
    labelled = materialise(named.select("pid", *grid.xs, *grid.cells, "label"))
    loose = points.where("NOT core").select("pid", *grid.xs, *grid.cells)
    border = grid.neighbours(loose, labelled.drop("pid")).groupBy(*grid.xs).agg(F.min("r_label").alias("label"))
    known = labelled.select(*grid.xs, "label").unionByName(border)
    placed = df.withColumns({x: finite(col(c).cast("double")) for c, x in zip(columns, grid.xs)})
    joined = placed.join(known, grid.xs, "left")
    return joined.withColumn("outlier", F.coalesce("label", F.lit(-1)).cast("bigint")).select(*df.columns, "outlier")
