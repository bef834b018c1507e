import math

import pytest
from pyspark.errors import PySparkException

from stratavox.operators import atlas, regions

OUTLINE = "ord int, id int, abbreviation string, regionlevel_01 string, regionlevel_02 string, regionlevel_03 string, regionlevel_04 string, is_leaf string"
ROWS = [
    (0, 1, "root", "root", None, None, None, ""), (1, 10, "A", None, " Area ", None, None, "parent"), (2, 11, "A1", None, "", None, "deep", "LEAF"),
    (3, 20010, "A-other", None, None, "rest", None, " Leaf "), (4, 12, "B", None, "b", None, None, "leaf"),
]


def outline(spark, rows=ROWS):
    return spark.createDataFrame(rows, OUTLINE)


def test_tree_collapses_skipped_indents(spark):
    got = {r["region_id"]: (r["parent_id"], r["depth"], r["name"], r["is_leaf"], r["is_other"], r["path"]) for r in atlas.outline_tree(outline(spark)).collect()}
    assert got == {
        1: (None, 0, "root", False, False, [1]), 10: (1, 1, "Area", False, False, [1, 10]), 11: (10, 2, "deep", True, False, [1, 10, 11]),
        20010: (10, 2, "rest", True, True, [1, 10, 20010]), 12: (1, 1, "b", True, False, [1, 12]),
    }
    assert atlas.checked_tree(outline(spark)).count() == 5
    assert atlas.outline_tree(outline(spark, [])).count() == 0


def test_random_outlines_follow_the_nearest_smaller_indent(spark):
    import random

    rng = random.Random(2)
    rows, indents = [], [0] + [rng.randint(1, 3) for _ in range(80)]
    for i, d in enumerate(indents):
        rows.append((i, i + 1, "n", *["x" if k == d else None for k in range(4)], ""))
    parents = {}
    for i, d in enumerate(indents):
        parents[i + 1] = next((j + 1 for j in range(i - 1, -1, -1) if indents[j] < d), None)
    got = {r["region_id"]: r["parent_id"] for r in atlas.outline_tree(outline(spark, rows)).collect()}
    assert got == parents


def test_all_violations_are_listed(spark):
    bad = [*ROWS, (5, 12, "C", None, None, "c", None, "leaf"), (6, 77, "B-other", None, None, "x", None, "leaf"), (7, 2, "again", "again", None, None, None, "leaf")]
    found = sorted(tuple(r) for r in atlas.tree_problems(atlas.outline_tree(outline(spark, bad))).collect())
    assert ("duplicate_id", 12) in found and ("leaf_mark", 12) in found and ("other_id", 77) in found and ("second_root", 2) in found
    with pytest.raises(ValueError, match="second_root"):
        atlas.checked_tree(outline(spark, bad))


def test_leaf_resolution_and_strictness(spark):
    cells = spark.createDataFrame([(1, 10), (2, 11), (3, 0), (4, None), (5, 999), (6, 1)], "cell_ord long, region_id int")
    tree = atlas.outline_tree(outline(spark))
    got = {r["cell_ord"]: (r["leaf_id"], r["placement"]) for r in atlas.resolve_leaves(cells, tree).collect()}
    assert got == {1: (20010, "leaf"), 2: (11, "leaf"), 3: (0, "outside"), 4: (None, "unlocated"), 5: (None, "unknown"), 6: (None, "not_leaf")}
    with pytest.raises(PySparkException, match="unknown"):
        atlas.resolve_leaves(cells.filter("cell_ord = 5"), tree, strict=True).collect()


def test_roll_up_conserves_cells(spark):
    tree = atlas.outline_tree(outline(spark))
    cells = spark.createDataFrame([(r,) for r in [10, 10, 11, 12, 0, 0, 5]], "region_id int")
    placed = atlas.resolve_leaves(cells, tree)
    rolled = {r["region_id"]: r["n_cells"] for r in regions.roll_up(regions.leaf_counts(placed), tree).collect()}
    assert rolled == {1: 4, 10: 3, 11: 1, 20010: 2, 12: 1}
    assert {r["placement"]: r["n"] for r in regions.placement_counts(placed).collect()} == {"leaf": 4, "outside": 2, "unknown": 1}


VOLUMES = "region_id int, aggregated_voxel_count long, aggregated_volume_mm3 double, loaded_at int"


def test_volumes_other_and_mismatch(spark):
    tree = atlas.outline_tree(outline(spark))
    good = spark.createDataFrame([(1, 100, 10.0, 0), (10, 70, 7.0, 0), (11, 999, 9.9, 0), (11, 50, 5.0, 1), (12, 30, 3.0, 0), (5, 1, 1.0, 0)], VOLUMES)
    volume = regions.node_volumes(tree, good)
    assert {r["region_id"]: (r["volume_voxels"], r["volume_mm3"]) for r in volume.collect()} == {1: (100, 10.0), 10: (70, 7.0), 11: (50, 5.0), 20010: (20, 2.0), 12: (30, 3.0)}
    assert regions.volume_mismatches(tree, volume).count() == 0
    off = regions.node_volumes(tree, spark.createDataFrame([(1, 101, 10.0, 0), (10, 70, 7.0, 0), (12, 30, 3.0 + 1e-12, 0)], VOLUMES))
    assert [tuple(r) for r in regions.volume_mismatches(tree, off).collect()] == [(1, 101, 100, False)]
    layout = regions.level_layout(regions.region_summary(atlas.resolve_leaves(spark.createDataFrame([(10,)], "region_id int"), tree), tree, good), tree)
    row = {r["id"]: r for r in layout.collect()}[20010]
    assert (row["leaf"], row["parent_id"], row["original_id"], row["original_abbreviation"], row["total_cells"], row["region_level_03"], row["region_level_01"]) == ("TRUE", 10, 10, "A", 1, "rest", "")


def test_merged_groups(spark):
    tree = atlas.outline_tree(outline(spark))
    volumes = spark.createDataFrame([(1, 100, 10.0, 0), (10, 70, 7.0, 0), (11, 50, 5.0, 1), (12, 30, 3.0, 0)], VOLUMES)
    cells = spark.createDataFrame([(r,) for r in [10, 11, 12, 12]], "region_id int")
    summary = regions.region_summary(atlas.resolve_leaves(cells, tree), tree, volumes)
    groups = spark.createDataFrame([(5, "G", "g", [10, 11, 11, None, 404], 1), (5, "G", "g", [1], 0), (6, "H", "h", [], 0), (7, "I", "i", [404], 0)], "id int, abbreviation string, description string, member_ids array<int>, loaded_at int")
    got = [tuple(r) for r in regions.merged_groups(summary, groups).collect()]
    assert got == [(5, "G", "g", 3, 170, 17.0, 4, pytest.approx(4 / 17), 1)]


def test_locate_rounds_half_to_even_and_bounds(spark):
    annotation = spark.createDataFrame([(0, 0, [5, 6]), (0, 2, [7, None]), (2, 0, [8, 9]), (0, 3, None)], "z int, y int, labels array<int>")
    points = [(0, 0.5, 0.0, 0.0), (1, 1.5, 0.0, 1.5), (2, 0.0, 2.5, 0.0), (3, -0.5, 0.0, 0.4), (4, -0.6, 0.0, 0.0), (5, 0.0, 0.0, 2.0), (6, 0.0, 0.0, -1.0), (7, None, 0.0, 0.0), (8, math.nan, 0.0, 0.0), (9, 1e300, 0.0, 0.0), (10, 0.0, 2.0, 1.0), (11, 0.0, 3.0, 1.0)]
    got = {r["i"]: r["voxel_region"] for r in atlas.locate(spark.createDataFrame(points, "i int, z double, y double, x double"), annotation).collect()}
    assert got == {0: 5, 1: 0, 2: 7, 3: 5, 4: 0, 5: 0, 6: 0, 7: None, 8: None, 9: 0, 10: 0, 11: 0}
