import math
import random

import numpy as np
import pytest

from stratavox.operators.bvh import Hierarchy, ear_clip, in_triangle, space_order
from stratavox.operators.spatial import fit_tree, near_pairs, regions_of_points, top_hierarchy

POINTS = "n long, im string, z double, y double, x double, leaf string"


def cloud(seed, n, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pos = [rng.randint(0, spread * 8) / 8 for _ in range(3)]
        if rng.random() < 0.03:
            pos[rng.randrange(3)] = rng.choice([None, math.nan])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), *pos, "x"))
    return rows


def brute(rows, d):
    good = [r for r in rows if r[1] is not None and all(v is not None and not math.isnan(v) for v in r[2:5])]
    return sorted((a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= d * d)


@pytest.mark.parametrize("task_rows,spread,d", [(40, 6, 0.75), (10_000, 6, 0.75), (25, 3, 0.0), (30, 4, 1.5)])
def test_pairs_match_brute_force(spark, task_rows, spread, d):
    rows = cloud(task_rows, 300, spread)
    got = near_pairs(spark.createDataFrame(rows, POINTS).repartition(3), "n", "im", d, task_rows=task_rows).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == brute(rows, d)


def test_points_at_one_place_and_empty(spark):
    rows = [(i, "a", 1.0, 1.0, 1.0, "x") for i in range(30)] + [(None, "a", 1.0, 1.0, 1.0, "x")]
    assert near_pairs(spark.createDataFrame(rows, POINTS), "n", "im", 0.5, task_rows=4).count() == 435
    assert near_pairs(spark.createDataFrame([], POINTS), "n", "im", 0.5).count() == 0


def test_points_at_one_place_are_dealt_to_several_tasks(spark):
    rows = [(i, "a", 1.0, 1.0, 1.0, "x") for i in range(300)] + [(300 + i, "a", 1.0, 1.0, 1.0 + i / 16, "x") for i in range(40)]
    df = spark.createDataFrame(rows, POINTS)
    top = top_hierarchy(df.withColumnRenamed("im", "g"), "g", task_rows=10)
    first, blocks = top.deal(40)
    assert top.rows.sum() == 340 and blocks.max() >= 7 and first[-1] + blocks[-1] == blocks.sum()
    got = [(r["id_a"], r["id_b"]) for r in near_pairs(df, "n", "im", 0.5, task_rows=10, block_rows=16).collect()]
    assert len(got) == len(set(got)) and sorted(got) == brute(rows, 0.5)


@pytest.mark.parametrize("block", [7, 60])
def test_blocks_of_a_leaf_lose_no_pair(spark, block):
    rows = cloud(block, 400, 5)
    got = near_pairs(spark.createDataFrame(rows, POINTS).repartition(3), "n", "im", 0.75, block_rows=block).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == brute(rows, 0.75)


def test_dense_searches_come_in_parts():
    low = np.zeros((500, 2))
    tree = Hierarchy(low, low + 1)
    parts = list(tree.touching_parts(low[:50], low[:50], limit=3000))
    assert len(parts) > 5 and max(len(q) for q, _ in parts) <= 3000 and sum(len(q) for q, _ in parts) == 25_000


def test_hierarchy_finds_all_touching_boxes():
    rng = np.random.default_rng(3)
    low = rng.random((200, 3))
    order = space_order(np.zeros(200), low)
    low = low[order]
    high = low + 0.1
    q, b = Hierarchy(low, high).touching(low[:50], low[:50])
    want = [(i, j) for i in range(50) for j in range(200) if (low[j] <= low[i]).all() and (low[i] <= high[j]).all()]
    assert sorted(zip(q.tolist(), b.tolist())) == want


def test_ear_clip_covers_the_area_once():
    ring = np.array([(0, 0), (0, 4), (1, 4), (1, 1), (3, 1), (3, 4), (4, 4), (4, 2), (4, 0)], dtype=float)
    triangles = ear_clip(ring)
    area = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in triangles)
    assert area == 10
    inside = np.array([(0.5, 3.5), (2, 0.5), (3.5, 3.5)])
    outside = np.array([(2.0, 2.0), (5, 5), (2, 4)])
    for p, want in ((inside, True), (outside, False)):
        assert all(any(in_triangle(q[None], t[None])[0] for t in triangles) == want for q in p)
    assert len(ear_clip(np.zeros((0, 2)))) == 0 and len(ear_clip(np.zeros((5, 2)))) == 0


def test_regions_match_rounding(spark):
    rng = random.Random(9)
    volume = [[[rng.choice([0, 0, 5, 5, 5, 6]) for _ in range(7)] for _ in range(6)] for _ in range(3)]
    rows = [(z, y, volume[z][y]) for z in range(3) for y in range(6)] + [(1, 1, volume[1][1]), (None, 2, [1])]
    annotation = spark.createDataFrame(rows, "z int, y int, labels array<int>")
    points = [(i, "a", rng.randint(-4, 12) / 4, rng.randint(-4, 28) / 4, rng.randint(-4, 32) / 4, "x") for i in range(400)] + [(900, "a", None, 1.0, 1.0, "x"), (901, "a", 1.0, math.nan, 1.0, "x")]

    def label(z, y, x):
        if z is None or math.isnan(y):
            return None
        z, y, x = round(z), round(y), round(x)
        return volume[z][y][x] if 0 <= z < 3 and 0 <= y < 6 and 0 <= x < 7 else 0

    want = {p[0]: label(*p[2:5]) for p in points}
    for task_rows in (5, 100_000):
        got = regions_of_points(spark.createDataFrame(points, POINTS), "n", annotation, task_rows=task_rows).collect()
        assert len(got) == len(points) and {r["id"]: r["voxel_region"] for r in got} == want
    empty = regions_of_points(spark.createDataFrame(points, POINTS), "n", annotation.limit(0)).collect()
    assert {r["voxel_region"] for r in empty} == {0, None}


def test_hot_slices_and_repeated_points_are_dealt_to_tasks_without_the_driver(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(z, y, [rng.choice([0, 7, 8]) for _ in range(5)]) for z in (0, 1, 3) for y in range(5)] + [(4, y, [0] * 5) for y in range(5)]
    annotation = spark.createDataFrame(rows, "z int, y int, labels array<int>")
    points = [(i, "a", rng.choice([1, 1, 1, 0.5, 2, 3, 4, -1, 1e300, math.nan]), rng.randint(0, 16) / 4, rng.randint(0, 16) / 4, "x") for i in range(300)] + [(7, "a", 1.0, 2.0, 2.0, "x")] * 3
    points += [(1000 + i, "a", 1.0, 2.5, 2.5, "x") for i in range(100)] + [(None, "a", 1.0, 2.0, 2.0, "x"), (2**60 + 1, "a", 1.0, 2.0, 2.0, "x")]
    df = spark.createDataFrame([(i, im, float(z), y, x, leaf) for i, im, z, y, x, leaf in points], POINTS).repartition(3)
    volume = {(z, y): labels for z, y, labels in rows}
    label = lambda z, y, x: None if math.isnan(z) else volume.get((round(z), round(y)), [0] * 9)[round(x)] if z < 9 else 0
    want = sorted(((p[0], label(*p[2:5])) for p in points), key=str)

    def refuse(self):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(type(df), "toPandas", refuse)
    monkeypatch.setattr(type(df), "collect", refuse)
    for task_rows in (4, 20_000):
        got = regions_of_points(df, "n", annotation, task_rows=task_rows).toArrow().to_pylist()
        assert sorted(((r["id"], r["voxel_region"]) for r in got), key=str) == want


def test_tree_places_unknown_groups():
    import pandas as pd

    sample = pd.DataFrame({"g": ["a", "a", "c", "c"], "z": [0.0, 1, 0, 1], "y": 0.0, "x": 0.0})
    tree = fit_tree(sample, np.ones(4), 1)
    rank = tree.ranks(np.array(["a", "b", "c", "d"], dtype=object))
    assert rank[0] < rank[1] < rank[2] < rank[3]
    rows, leaves = tree.leaves_of(np.column_stack([rank, np.zeros((4, 3))]), np.column_stack([rank, np.zeros((4, 3))]))
    assert sorted(rows.tolist()) == [0, 1, 2, 3] and len(leaves) == 4


def test_overfull_leaves_are_split_again(spark, monkeypatch):
    from stratavox.operators import spatial

    rng = random.Random(12)
    rows = [(i, "a", rng.random() * 1000, rng.random() * 1000, rng.random() * 1000, "x") for i in range(3000)]
    rows += [(3000 + i, "a", 500 + rng.random(), 500 + rng.random(), 500 + rng.random(), "x") for i in range(1500)]
    rows += [(4500 + i, "b", 7.0, 7.0, 7.0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    calls = []

    def unlucky(sample, weight, per_leaf):
        calls.append(per_leaf)
        return fit_tree(sample, weight, per_leaf if len(calls) > 1 else 1e9)

    monkeypatch.setattr(spatial, "fit_tree", unlucky)
    assert top_hierarchy(df.withColumnRenamed("im", "g"), "g", task_rows=50, sample_rows=600).leaves > 20 and len(calls) >= 2
    calls.clear()
    got = near_pairs(df, "n", "im", 0.05, task_rows=50, sample_rows=600).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == brute(rows, 0.05)
