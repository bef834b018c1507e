"""Summaries of many samples with the samples' metadata: collation, exclusions, wide tables, group means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .atlas import closure
from .latest import latest_rows


def latest_metadata(images: DataFrame, key: str = "image_name") -> DataFrame:
    """One row per sample: the last loaded (on a tie the greatest of the other columns); text trimmed; rows with a blank sample name are left out."""
    text = [c for c, t in images.dtypes if t == "string"]
    clean = images.select(*[F.trim(c).alias(c) if c in text else F.col(c) for c in images.columns]).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    rest = [F.col(c).asc_nulls_first() for c in images.columns if c not in (key, "loaded_at")]
    return latest_rows(clean, [key], [F.col("loaded_at").asc_nulls_first(), *rest])


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The last written row of every image, channel and region (on a tie the largest summary_row)."""
    return latest_rows(summaries, ["image_name", "channel", "id"], [F.col("loaded_at").asc_nulls_first(), F.col("summary_row").asc_nulls_first()])


def collate(metadata: DataFrame, summaries: DataFrame, channels: list[int], first_columns: int, key: str = "image_name") -> DataFrame:
    """Long table of all samples: the first metadata columns, channel, then the summary's columns (without its own name, channel and loading columns).

    A sample without a summary for a channel has no row for it; a sample may come in several channels. A summary column that clashes with a
    metadata column gets the suffix ``_summary``.
    """
    first = metadata.columns[:first_columns]
    sample = metadata.select(F.col(key).alias("__key"), *first)
    own = [c for c in summaries.columns if c not in (key, "channel", "loaded_at", "summary_row")]
    taken = {c.lower() for c in first}
    data = summaries.filter(F.col("channel").isin(*channels)).select(F.col(key).alias("__key"), "channel", *[F.col(c).alias(f"{c}_summary" if c.lower() in taken else c) for c in own])
    return sample.join(data, "__key").drop("__key")


def grouped_metadata(metadata: DataFrame, factors: list[str], excluded: list[dict[str, str]] | None = None, key: str = "image_name") -> DataFrame:
    """sample, factors (lower case, blank and null as ''), group_label (joined by '-') without samples of an excluded group.

    An excluded group is a conjunction of column = value, without case; several are alternatives.
    """
    lower = lambda c: F.lower(F.coalesce(F.trim(F.col(c)), F.lit("")))
    rows = metadata
    for group in excluded or []:
        met = F.lit(True)
        for column, value in group.items():
            met = met & (lower(column) == value.lower())
        rows = rows.filter(~met)
    made = rows.select(F.col(key).alias("sample"), *[lower(f).alias(f) for f in factors])
    return made.withColumn("group_label", F.concat_ws("-", *factors))


def excluded_regions(regions: DataFrame, exclude: list[int] | None = None, include: list[int] | None = None) -> DataFrame:
    """region_id of all regions left out: every excluded id with its subtree; for an included id (not a root) its siblings that are not included, with their subtrees."""
    exclude, include = list(exclude or []), list(include or [])
    inside = F.col("region_id").isin(*include) if include else F.lit(False)
    parents = regions.filter(inside & F.col("parent_id").isNotNull()).select("parent_id").distinct()
    siblings = regions.join(parents, "parent_id", "left_semi").filter(~inside).select("region_id")
    tops = siblings.unionByName(regions.filter(F.col("region_id").isin(*exclude) if exclude else F.lit(False)).select("region_id")).distinct()
    below = closure(regions).select(F.col("ancestor_id").alias("top"), "region_id")
    return below.join(tops.withColumnRenamed("region_id", "top"), "top").select("region_id").distinct()


def without_regions(obs: DataFrame, regions: DataFrame, exclude: list[int] | None = None, include: list[int] | None = None, column: str = "id") -> DataFrame:
    """``obs`` without excluded regions; regions the atlas does not know stay. The exclusions are atlas nodes, which Spark broadcasts by their size."""
    gone = excluded_regions(regions, exclude, include).withColumnRenamed("region_id", column)
    return obs.join(gone, column, "left_anti")


def with_leaf_flag(obs: DataFrame, regions: DataFrame, only_leafs: bool = True, column: str = "id") -> DataFrame:
    """``obs`` with testable: whether a region has no children (regions the atlas does not know count as leaves); true throughout unless ``only_leafs``."""
    if not only_leafs:
        return obs.withColumn("testable", F.lit(True))
    leaf = regions.select(F.col("region_id").alias(column), F.col("is_leaf").alias("testable"))
    return obs.join(leaf, column, "left").withColumn("testable", F.coalesce("testable", F.lit(True)))


def observations(metadata: DataFrame, summaries: DataFrame, factors: list[str], channels: list[int], excluded: list[dict[str, str]] | None = None) -> DataFrame:
    """Long form of all values: sample, factors, group_label, and the summary's columns (one row per sample, channel and region)."""
    samples = grouped_metadata(metadata, factors, excluded)
    data = summaries.filter(F.col("channel").isin(*channels)).withColumnRenamed("image_name", "sample")
    return data.join(samples, "sample")


def raw_wide(obs: DataFrame, keys: list[str], columns: list[str], samples: list[str] | None = None) -> DataFrame:
    """A row per region with one column ``sample:column`` per data column and sample, by column, group and sample. Values are unpivoted and pivoted over explicit labels."""
    if samples is None:
        samples = [r["sample"] for r in obs.select("group_label", "sample").distinct().orderBy("group_label", "sample").collect()]
    labels = [f"{s}:{c}" for c in columns for s in samples]
    parts = F.array(*[F.struct(F.concat(F.col("sample"), F.lit(f":{c}")).alias("label"), F.col(c).cast("double").alias("v")) for c in columns])
    return obs.select(*keys, F.inline(parts)).groupBy(*keys).pivot("label", labels).agg(F.first("v", ignorenulls=True))


def group_means(obs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, group_label, n_samples, mean_value of a data column; null values do not count in the mean."""
    return obs.groupBy(*keys, "group_label").agg(F.count("*").alias("n_samples"), F.avg(column).alias("mean_value"))


def group_means_wide(obs: DataFrame, keys: list[str], columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """A row per region with ``group:N`` per group and ``group:column`` (mean) per data column and group."""
    if groups is None:
        groups = [r[0] for r in obs.select("group_label").distinct().orderBy("group_label").collect()]
    aggregates = [F.count(F.lit(1)).alias("N"), *[F.avg(c).alias(c) for c in columns]]
    wide = obs.groupBy(*keys).pivot("group_label", groups).agg(*aggregates)
    named = [F.coalesce(F.col(f"`{g}_N`"), F.expr("0L")).alias(f"{g}:N") for g in groups] + [F.col(f"`{g}_{c}`").alias(f"{g}:{c}") for c in columns for g in groups]
    return wide.select(*keys, *named)


def sample_groups(obs: DataFrame, factors: list[str]) -> DataFrame:
    """Sample metadata of an analysis: sample and factors, each sample once."""
    return obs.select("sample", *factors).distinct()


def level_pairs(samples: DataFrame, factors: list[str]) -> DataFrame:
    """factor, level_a, level_b: every pair of different levels (a before b by name) of every factor; a factor of one level has none. Levels are aggregated map-side; null is none."""
    each = samples.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level_a")) for f in factors])))
    levels = each.filter("level_a is not null").distinct()
    return levels.join(levels.withColumnRenamed("level_a", "level_b"), "factor").filter("level_a < level_b")
