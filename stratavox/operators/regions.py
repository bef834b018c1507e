"""Counts per region, roll-up over the hierarchy, volumes, densities, merged groups and export layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .atlas import closure


def density(count: Column, volume: Column) -> Column:
    """count / volume, 0 where the volume is 0 or missing."""
    return F.coalesce(F.try_divide(count.cast("double"), volume.cast("double")), F.lit(0.0))


def leaf_counts(placed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) region_id, n of placed cells (``resolve_leaves``); outside and unplaced cells do not count.

    Aggregated map-side first, so a leaf that holds a third of all cells costs one row per task.
    """
    return placed.filter("placement = 'leaf'").groupBy(*(keys or []), F.col("leaf_id").alias("region_id")).agg(F.count("*").alias("n"))


def placement_counts(placed: DataFrame) -> DataFrame:
    """placement, n."""
    return placed.groupBy("placement").agg(F.count("*").alias("n"))


def roll_up(counts: DataFrame, regions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys,) region_id, n_cells: each node's sum over its subtree. Nodes without cells have 0 where no ``keys`` are given, else no row."""
    up = closure(regions).select("region_id", "ancestor_id")
    sums = counts.join(up, "region_id").groupBy(*(keys or []), F.col("ancestor_id").alias("region_id")).agg(F.sum("n").alias("n_cells"))
    if keys:
        return sums
    return regions.select("region_id").join(sums, "region_id", "left").select("region_id", F.coalesce("n_cells", F.expr("0L")).alias("n_cells"))


def root_totals(rolled: DataFrame, regions: DataFrame, placed: DataFrame) -> DataFrame:
    """region_id, n_cells, n_placed of every root: its rolled-up count, and the cells whose leaf has it first in its path; a sound tree has both equal."""
    root = regions.select(F.col("region_id").alias("leaf_id"), F.col("path")[0].alias("root_id"))
    counted = placed.filter("placement = 'leaf'").join(root, "leaf_id").groupBy(F.col("root_id").alias("region_id")).agg(F.count("*").alias("n_placed"))
    roots = regions.filter("parent_id IS NULL").select("region_id").join(rolled, "region_id")
    return roots.join(counted, "region_id", "left").select("region_id", "n_cells", F.coalesce("n_placed", F.expr("0L")).alias("n_placed"))


def node_volumes(regions: DataFrame, volumes: DataFrame) -> DataFrame:
    """region_id, volume_voxels, volume_mm3 of every node.

    volumes: region_id, aggregated_voxel_count, aggregated_volume_mm3, loaded_at (subtree totals; of repeated rows the last loaded counts, then the
    larger). Nodes without a row have 0; rows of unknown regions are left out. An ``-other`` node holds its parent's volume minus that of the parent's other children.
    """
    last = W.partitionBy("region_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("aggregated_voxel_count").desc_nulls_last())
    given = volumes.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    read = regions.join(given, "region_id", "left").select(
        "region_id", "parent_id", "is_other", F.coalesce("aggregated_voxel_count", F.expr("0L")).alias("voxels"), F.coalesce("aggregated_volume_mm3", F.lit(0.0)).alias("mm3")
    )
    normal = read.filter(~F.col("is_other")).groupBy("parent_id").agg(F.sum("voxels").alias("child_voxels"), F.sum("mm3").alias("child_mm3"))
    parent = read.select(F.col("region_id").alias("parent_id"), F.col("voxels").alias("parent_voxels"), F.col("mm3").alias("parent_mm3"))
    joined = read.join(parent, "parent_id", "left").join(normal, "parent_id", "left")
    other = F.col("is_other") & F.col("parent_id").isNotNull()
    rest = lambda whole, part: F.col(whole) - F.coalesce(F.col(part), F.lit(0))
    return joined.select(
        "region_id", F.when(other, rest("parent_voxels", "child_voxels")).otherwise(F.col("voxels")).alias("volume_voxels"),
        F.when(other, rest("parent_mm3", "child_mm3")).otherwise(F.col("mm3")).alias("volume_mm3"),
    )


def volume_mismatches(regions: DataFrame, node_volume: DataFrame) -> DataFrame:
    """Nodes whose volume is not the sum of their children's: region_id, voxels, child_voxels, mm3_differs (beyond 1e-9 of the larger)."""
    held = regions.select("region_id", "parent_id").join(node_volume, "region_id")
    children = held.groupBy(F.col("parent_id").alias("region_id")).agg(F.sum("volume_voxels").alias("child_voxels"), F.sum("volume_mm3").alias("child_mm3"))
    both = held.join(children, "region_id")
    differs = F.abs(F.col("volume_mm3") - F.col("child_mm3")) > 1e-9 * F.greatest(F.abs("volume_mm3"), F.abs("child_mm3"))
    return both.filter((F.col("volume_voxels") != F.col("child_voxels")) | differs).select("region_id", F.col("volume_voxels").alias("voxels"), "child_voxels", differs.alias("mm3_differs"))


def region_summary(placed: DataFrame, regions: DataFrame, volumes: DataFrame) -> DataFrame:
    """The flat summary of all nodes in outline order (ord): region_id, acronym, name, volume_voxels, volume_mm3, n_cells, cells_per_mm3, cells_per_voxel."""
    rolled = roll_up(leaf_counts(placed), regions)
    nodes = regions.join(node_volumes(regions, volumes), "region_id").join(rolled, "region_id")
    return nodes.select(
        "ord", "region_id", "acronym", "name", "volume_voxels", "volume_mm3", "n_cells",
        density(F.col("n_cells"), F.col("volume_mm3")).alias("cells_per_mm3"), density(F.col("n_cells"), F.col("volume_voxels")).alias("cells_per_voxel"),
    )


def level_layout(summary: DataFrame, regions: DataFrame) -> DataFrame:
    """The summary in level layout: ord, id, abbreviation, leaf, parent_id (-1 at the root), original_id, original_abbreviation, total_voxels,
    total_volume_mm3, total_cells, cell_density_mm3 and one region_level_NN per depth that holds the name of the node of that depth, else ''.

    An ``-other`` node reports its parent's id and abbreviation as the original ones. The number of levels is read from the tree first.
    """
    deepest = regions.agg(F.max("depth")).first()[0]
    parent = regions.select(F.col("region_id").alias("parent_id"), F.col("acronym").alias("parent_acronym"))
    shape = regions.select("region_id", "parent_id", "depth", "is_leaf", "is_other").join(parent, "parent_id", "left")
    other = F.col("is_other") & F.col("parent_id").isNotNull()
    rows = summary.join(shape, "region_id")
    levels = [F.when(F.col("depth") == k, F.col("name")).otherwise("").alias(f"region_level_{k + 1:02d}") for k in range((deepest if deepest is not None else -1) + 1)]
    return rows.select(
        "ord", F.col("region_id").alias("id"), F.col("acronym").alias("abbreviation"), F.when(F.col("is_leaf"), "TRUE").otherwise("FALSE").alias("leaf"),
        F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), F.when(other, F.col("parent_id")).otherwise(F.col("region_id")).alias("original_id"),
        F.when(other, F.col("parent_acronym")).otherwise(F.col("acronym")).alias("original_abbreviation"), F.col("volume_voxels").alias("total_voxels"),
        F.col("volume_mm3").alias("total_volume_mm3"), F.col("n_cells").alias("total_cells"), F.col("cells_per_mm3").alias("cell_density_mm3"), *levels,
    )


def merged_groups(summary: DataFrame, merge_tree: DataFrame) -> DataFrame:
    """Sums of member regions per group: group_id, acronym, name, n_members, volume_voxels, volume_mm3, n_cells, cells_per_mm3, n_unknown.

    merge_tree: id, abbreviation, description, member_ids, loaded_at; of rows with one id the last loaded counts (then the longer list). A member
    listed twice counts twice. Null members are ignored; unknown ones are counted in n_unknown and add nothing; groups without a known member have no row.
    """
    last = W.partitionBy("id").orderBy(F.col("loaded_at").desc_nulls_last(), F.size("member_ids").desc(), F.col("member_ids"))
    groups = merge_tree.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
    members = groups.select(F.col("id").alias("group_id"), F.col("abbreviation").alias("group_acronym"), F.col("description").alias("group_name"), F.explode("member_ids").alias("region_id")).filter("region_id is not null")
    joined = members.join(summary.select("region_id", "volume_voxels", "volume_mm3", "n_cells"), "region_id", "left")
    sums = joined.groupBy("group_id", "group_acronym", "group_name").agg(
        F.count("n_cells").alias("n_members"), F.sum("volume_voxels").alias("volume_voxels"), F.sum("volume_mm3").alias("volume_mm3"), F.sum("n_cells").alias("n_cells"), F.count_if(F.col("n_cells").isNull()).alias("n_unknown")
    )
    return sums.filter("n_members > 0").select(
        "group_id", F.col("group_acronym").alias("acronym"), F.col("group_name").alias("name"), "n_members", "volume_voxels", "volume_mm3", "n_cells", density(F.col("n_cells"), F.col("volume_mm3")).alias("cells_per_mm3"), "n_unknown"
    )
