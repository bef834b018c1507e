"""The hierarchical atlas: outline to tree, validation, closure, leaf resolution.

A table of nodes is one atlas, a dictionary of a few hundred to a few thousand nodes; its windows run over the whole of it. Forests of many atlases are the work of
``links``. Joins with the dictionary carry no hint: Spark broadcasts it by its measured size, and shuffles where it is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sized_join import sized_join

# Fixed values of the atlas format.
OTHER_OFFSET = 20000
OTHER_SUFFIX = "-other"
OUTSIDE = 0

_SPARE = "__atlas"


def level_columns(outline: DataFrame) -> list[str]:
    return sorted(c for c in outline.columns if c.lower().startswith("regionlevel_"))


def outline_tree(outline: DataFrame) -> DataFrame:
    """Nodes of an outline (ord, id, abbreviation, regionlevel_01 …, is_leaf).

    Result: ord, region_id, acronym, name, parent_id (null at a root), depth, path (ids from the root to the node), is_leaf (no children),
    marked_leaf (the outline's own mark), is_other. The first filled level column is a row's indent; its parent is the nearest earlier row
    of a smaller indent; depth counts parents, so skipped indents collapse. A row without any name has the last column's indent and ''. Text is
    trimmed. An empty outline gives no nodes.
    """
    levels = level_columns(outline)
    names = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in levels]
    indent = F.coalesce(*[F.when(n.isNotNull(), i) for i, n in enumerate(names)], F.lit(len(levels) - 1))
    rows = outline.select(
        F.lit(0).alias(_SPARE), "ord", F.col("id").alias("region_id"), F.trim("abbreviation").alias("acronym"), F.coalesce(*names, F.lit("")).alias("name"),
        indent.alias("indent"), (F.lower(F.trim(F.coalesce(F.col("is_leaf").cast("string"), F.lit("")))) == "leaf").alias("marked_leaf"),
    )
    order = W.partitionBy(_SPARE).orderBy("ord")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # the last earlier row of every smaller indent; one that a still smaller indent followed is no ancestor
    latest = [F.last(F.when(F.col("indent") == k, F.struct("ord", "region_id")), ignorenulls=True).over(before) for k in range(len(levels))]
    rows = rows.withColumn("latest", F.array(*latest))

    def ancestor(k: int) -> Column:
        me = F.col("latest")[k]
        lower = [F.coalesce(F.col("latest")[j]["ord"], F.lit(-1)) for j in range(k)]
        newest = reduce(lambda a, b: F.greatest(a, b), lower, F.lit(-1))
        return F.when((F.col("indent") > k) & me.isNotNull() & (me["ord"] > newest), me["region_id"])

    path = F.concat(F.array_compact(F.array(*[ancestor(k) for k in range(len(levels))])), F.array("region_id"))
    rows = rows.withColumn("path", path).withColumn("depth", F.size("path") - 1)
    following = F.lead("depth").over(order)
    return rows.select(
        "ord", "region_id", "acronym", "name", F.when(F.col("depth") > 0, F.col("path")[F.col("depth") - 1]).alias("parent_id"), "depth", "path",
        (F.coalesce(following, F.lit(-1)) <= F.col("depth")).alias("is_leaf"), "marked_leaf", F.endswith("acronym", F.lit(OTHER_SUFFIX)).alias("is_other"),
    )


def tree_problems(regions: DataFrame) -> DataFrame:
    """Violations of an outline tree's rules: rule, region_id. Rules: duplicate_id, leaf_mark, other_id, other_acronym, second_root."""
    parent = regions.select(F.col("region_id").alias("parent_id"), F.col("acronym").alias("parent_acronym")).dropDuplicates(["parent_id"])
    joined = regions.join(parent, "parent_id", "left").withColumn("n", F.count("*").over(W.partitionBy("region_id")))
    first = F.min("ord").over(W.partitionBy(F.lit(0)))
    joined = joined.withColumn("first", first)
    other = F.col("is_other") & F.col("parent_id").isNotNull()
    rules = [
        ("duplicate_id", F.col("n") > 1),
        ("leaf_mark", F.col("is_leaf") != F.col("marked_leaf")),
        ("other_id", other & (F.col("region_id") != F.col("parent_id") + OTHER_OFFSET)),
        ("other_acronym", other & (F.col("acronym") != F.concat("parent_acronym", F.lit(OTHER_SUFFIX)))),
        ("second_root", F.col("parent_id").isNull() & (F.col("ord") > F.col("first"))),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return joined.select(F.explode(broken).alias("rule"), "region_id")


def checked_tree(outline: DataFrame) -> DataFrame:
    """``outline_tree``, after its rules have been checked; raises ValueError that lists all violations."""
    tree = outline_tree(outline)
    broken = sorted(tuple(r) for r in tree_problems(tree).collect())
    if broken:
        raise ValueError(f"The outline breaks {len(broken)} rules: {broken}")
    return tree


def closure(regions: DataFrame) -> DataFrame:
    """ancestor_id, region_id, distance of all nodes; a node with itself at distance 0."""
    opened = regions.select("region_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return opened.select("ancestor_id", "region_id", (F.col("depth") - F.col("at")).alias("distance"))


def leaf_map(regions: DataFrame) -> DataFrame:
    """region_id, leaf_id, of_leaf: a region with an ``-other`` child resolves to it, every other to itself; of_leaf tells whether that has no children."""
    other = regions.filter(F.col("is_other") & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("region_id")).agg(F.min("region_id").alias("other_id"))
    return regions.join(other, "region_id", "left").select("region_id", F.coalesce("other_id", "region_id").alias("leaf_id"), (F.col("is_leaf") | F.col("other_id").isNotNull()).alias("of_leaf"))


def resolve_leaves(cells: DataFrame, regions: DataFrame, region_col: str = "region_id", strict: bool = False) -> DataFrame:
    """``cells`` with leaf_id and placement.

    placement: 'leaf', 'outside' (region 0), 'unlocated' (null region), 'unknown' (no such node), 'not_leaf' (a node with children but no
    ``-other`` child). leaf_id is 0 outside, null unless placed. ``strict`` raises at run time for null and unknown regions and non-leaves instead.
    Columns of these names are replaced. The map has one row per atlas node, so it is broadcast by its size and cells are not shuffled.
    """
    ids = leaf_map(regions).select(F.col("region_id").alias("__region"), "leaf_id", "of_leaf")
    joined = cells.drop("leaf_id", "placement").join(ids, F.col(region_col) == F.col("__region"), "left")
    where = F.col(region_col)
    placement = (
        F.when(where.isNull(), "unlocated").when(where == OUTSIDE, "outside").when(F.col("leaf_id").isNull(), "unknown").when(~F.col("of_leaf"), "not_leaf").otherwise("leaf")
    )
    if strict:
        bad = placement.isin("unlocated", "unknown", "not_leaf")
        placement = F.when(bad, F.raise_error(F.concat(F.lit("Region is "), placement, F.lit(": "), F.coalesce(where.cast("string"), F.lit("null"))))).otherwise(placement)
    leaf = F.when(F.col("placement") == "leaf", F.col("leaf_id")).when(F.col("placement") == "outside", F.lit(OUTSIDE))
    return joined.withColumn("placement", placement).withColumn("leaf_id", leaf).drop("__region", "of_leaf")


def locate(cells: DataFrame, annotation: DataFrame, name: str = "voxel_region") -> DataFrame:
    """``cells`` with the label of the voxel of their half-even rounded position; 0 outside the volume, null when a position is null or NaN.

    The volume is one array per (z, y) row, joined on it, so a shuffle, where the volume is too large to broadcast, moves rows and not voxels. Negative
    coordinates are outside. Repeated volume rows: the first in label order counts.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in "zyx"])
    whole = {c: F.when(known & (F.abs(F.col(c)) < 1e9), F.rint(c)).cast("int") for c in "zyx"}
    rows = annotation.groupBy(F.col("z").alias("__z"), F.col("y").alias("__y")).agg(F.min("labels").alias("__labels"))
    widest = rows.agg(F.max(F.size("__labels"))).first()[0] or 0
    placed = cells.withColumn("__z", whole["z"]).withColumn("__y", whole["y"]).withColumn("__x", whole["x"])
    joined = sized_join(placed, rows, ["__z", "__y"], "left", row_bytes=4 * widest + 32)
    label = F.when(F.col("__x") >= 0, F.try_element_at("__labels", F.col("__x") + 1))
    return joined.withColumn(name, F.when(known, F.coalesce(label, F.lit(OUTSIDE))).cast("int")).drop("__z", "__y", "__x", "__labels")
