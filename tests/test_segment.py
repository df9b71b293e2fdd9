import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import neighbours, segment


def brute_dbscan(xy, ids, eps, min_points):
    near = [[j for j in range(len(xy)) if ((xy[i] - xy[j]) ** 2).sum() <= eps * eps] for i in range(len(xy))]
    core = [len(n) >= min_points for n in near]
    label = {}
    for i in range(len(xy)):
        if core[i] and i not in label:
            stack, group = [i], {i}
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and j not in group:
                        group.add(j)
                        stack.append(j)
            low = min(ids[j] for j in group)
            label.update({j: low for j in group})
    out = {}
    for i in range(len(xy)):
        options = [label[j] for j in near[i] if core[j]]
        out[ids[i]] = label[i] if core[i] else min(options, default=-1)
    return out, {ids[i] for i in range(len(xy)) if core[i]}


def blobs(dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (4, dims))
    parts = [c + rng.normal(0, 0.6, (60, dims)) for c in centres]
    parts.append(rng.uniform(-12, 12, (40, dims)))
    parts.append(np.repeat(centres[:1], 30, axis=0))  # one hot place
    parts.append(np.column_stack([np.linspace(0, 9, 40)] + [np.full(40, 5.0)] * (dims - 1)))  # a chain
    return np.vstack(parts)


@pytest.mark.parametrize("dims, split", [(1, False), (2, False), (3, True), (5, True)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, split):
    if split:  # decide cell pairs by boxes alone
        monkeypatch.setattr(segment, "FREE_PAIRS", 0)
        monkeypatch.setattr(segment, "PAIRS_PER_POINT", 0)
    xy = blobs(dims)
    names = [f"v{i}" for i in range(dims)]
    pdf = pd.DataFrame(xy, columns=names).assign(id=np.arange(len(xy)) + 100)
    df = spark.createDataFrame(pdf)
    want, core = brute_dbscan(xy, pdf["id"].tolist(), 0.5, 5)
    got = {r["id"]: r["outlier"] for r in segment.dbscan(df, "id", names, 0.5, 5).collect()}
    assert got == want
    assert len(set(want.values())) > 2
    assert {r["id"] for r in segment.core_points(df, "id", names, 0.5, 5).collect()} == core


def test_dense_cells_need_no_split(spark, monkeypatch):
    """Cells of one dense cloud are joined by their middle points, so no pair of them is split into boxes."""
    monkeypatch.setattr(segment, "FREE_PAIRS", 0)
    monkeypatch.setattr(segment, "PAIRS_PER_POINT", 0)
    splits, part = [], segment._Grid.part
    monkeypatch.setattr(segment._Grid, "part", lambda grid, split: splits.append(split) or part(grid, split))
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, xy)) for i, xy in enumerate(rng.uniform(0, 4, (800, 3)))]
    rows += [(1000 + i, *map(float, xy)) for i, xy in enumerate(rng.uniform(50, 51, (30, 3)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    found = {(r["id"] >= 1000, r["outlier"]) for r in segment.dbscan(df, "id", ["a", "b", "c"], 1.5, 4).collect()}
    assert found == {(False, 0), (True, 1000)}
    assert max(splits) == 0


def test_dbscan_without_numbers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string")
    assert [r["outlier"] for r in segment.dbscan(df, "id").collect()] == [-1, -1]


def test_connected_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in segment.connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[i] == 31 for i in range(31, 61))


def brute_knn(rows, k):
    filled = [list(r) for r in rows]
    d = len(rows[0])
    for i, r in enumerate(rows):
        for j in range(d):
            if r[j] is not None:
                continue
            options = []
            for o in rows:
                if o[j] is None:
                    continue
                shared = [c for c in range(d) if r[c] is not None and o[c] is not None]
                if shared:
                    dist = sum((r[c] - o[c]) ** 2 for c in shared) * d / len(shared)
                    options.append((dist, [o[c] for c in shared], o[j]))
            best = sorted(options)[:k]
            known = [o[j] for o in rows if o[j] is not None]
            filled[i][j] = np.mean([b[2] for b in best]) if best else np.mean(known)
    return filled


def test_knn_imputation_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 3)
    rng = np.random.default_rng(5)
    xyz = np.vstack([rng.normal(0, 1, (80, 3)), np.repeat(rng.normal(3, 0.2, (20, 3)), 2, axis=0), [[50, 50, 50]]])
    rows = [[None if j < 2 and rng.random() < 0.15 else float(v) for j, v in enumerate(r)] for r in xyz]
    rows.append([None, None, None])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, a double, b double, c double")
    got = [list(r)[1:] for r in neighbours.impute_knn(df, ["a", "b", "c"]).orderBy("id").collect()]
    np.testing.assert_allclose(got, brute_knn(rows, 5), rtol=1e-9)


def test_kmeans_splits_blobs(spark):
    pts = list(itertools.product([0.0, 0.1, 0.2], [0.0, 0.1])) + [(x + 50, y) for x, y in itertools.product([0.0, 0.1], [0.0, 0.1])]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    rows = segment.kmeans_segments(df, 2).collect()
    assert len({r["cluster"] for r in rows if r["a"] < 25}) == 1
    assert len({r["cluster"] for r in rows}) == 2


def test_kmeans_returns_rows_with_gaps(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.1, 1.0), (9.0, 9.0), (None, 1.0), (float("nan"), 2.0)], "`a.x` double, b double")
    rows = segment.kmeans_segments(df, 2).collect()
    assert len(rows) == 5 and [r["cluster"] is None for r in sorted(rows, key=lambda r: (r["b"], r[0] or 0))].count(True) == 2
    assert {r["cluster"] for r in rows} == {None, 0, 1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in segment.connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_one_search_for_all_patterns_of_gaps(spark):
    rng = np.random.default_rng(1)
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns: int) -> int:
        values = rng.normal(size=(60, columns))
        rows = [[None if rng.random() < 0.2 else float(v) for v in row] for row in values]
        names = [f"c{i}" for i in range(columns)]
        df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
        spark.sparkContext.setJobGroup(f"gaps{columns}", "")
        got = neighbours.impute_knn(df, names).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        np.testing.assert_allclose(sorted(map(list, got)), sorted(brute_knn(rows, 5)), rtol=1e-9)
        return len(tracker.getJobIdsForGroup(f"gaps{columns}"))

    assert jobs(4) <= 1.5 * jobs(2) + 5


def test_heavy_tails_do_not_crowd_into_few_cells(spark):
    rng = np.random.default_rng(2)
    values = np.exp(rng.normal(0, 6, 3000))
    donors = spark.createDataFrame([("s", 0.0, float(v)) for v in values], "s string, value double, y0 double")
    receivers = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(np.exp(rng.normal(0, 6, 50)))], "s string, rid int, x0 double")
    found = neighbours.nearest(receivers, donors, 1, 3).groupBy("rid").agg({"dist2": "max"}).collect()
    places = {r["rid"]: r["x0"] for r in receivers.collect()}
    for row in found:
        want = np.sort((values - places[row["rid"]]) ** 2)[2]
        np.testing.assert_allclose(row[1], want, rtol=1e-9)
    assert len(found) == 50


def test_rounds_leave_one_table(spark):
    from pathlib import Path

    from tidewell.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    edges = spark.createDataFrame([(k, k + 1) for k in range(64)], "a bigint, b bigint")
    before = set(folder.glob("table-*"))
    assert segment.connected_components(edges).where("component <> 0").isEmpty()
    assert len(set(folder.glob("table-*")) - before) == 1


def test_coarse_levels_of_a_walk_are_not_dealt_by_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 3)
    rng = np.random.default_rng(4)
    plans, write = [], neighbours.materialise

    def seen(df, *args, **kwargs):
        if "radius" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **kwargs)

    monkeypatch.setattr(neighbours, "materialise", seen)
    rows = [[float(a), None if rng.random() < 0.2 else float(b)] for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neighbours.impute_knn(df, ["a", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    np.testing.assert_allclose(sorted(map(list, got)), sorted(brute_knn(rows, 5)), rtol=1e-9)
    walks = [line for plan in plans for line in plan.splitlines() if "Join" in line and "shiftright(to_c" in line]
    assert walks and all("BroadcastHashJoin" in line for line in walks)


@pytest.mark.parametrize("coarse", [0, 4])
def test_imputation_with_levels_dealt_by_cell(spark, monkeypatch, coarse):
    for name, value in (("LEAF_ROWS", 3), ("COARSE_CELLS", coarse), ("TASK_ROWS", 7)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    rows = [[None if j < 2 and rng.random() < 0.2 else float(v) for j, v in enumerate(r)] for r in rng.normal(size=(90, 3)).round(1)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = neighbours.impute_knn(df, ["a", "b", "c"]).collect()
    np.testing.assert_allclose(sorted(map(list, got)), sorted(brute_knn(rows, 5)), rtol=1e-9)


def test_donors_of_one_file_are_sorted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_DONORS", 40, raising=False)
    rng = np.random.default_rng(8)
    most, top = [], neighbours.top_n_per_key

    def seen(df, keys, order, n):
        if keys[0] == "s" and "rid" not in keys:
            most.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())
        return top(df, keys, order, n)

    monkeypatch.setattr(neighbours, "top_n_per_key", seen)
    rows = [[None if rng.random() < 0.2 else float(v) for v in row] for row in rng.normal(size=(200, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(1)
    got = neighbours.impute_knn(df, ["a", "b", "c"]).collect()
    np.testing.assert_allclose(sorted(map(list, got)), sorted(brute_knn(rows, 5)), rtol=1e-9)
    assert most[0][1] > 1000 and most[0][0] < most[0][1] / 10
