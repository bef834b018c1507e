"""The five commands as functions over DataFrames and files."""

from __future__ import annotations

import logging
import platform
import time
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import panels
from .operators import atlas, deseq, filters, measures, regions, samples, stats
from .session import Stash
from .sources import files, sinks

log = logging.getLogger("stratavox")


def _timed(run: Callable) -> Callable:
    def logged(*args, **kwargs):
        began = time.time()
        log.info("stratavox %s, pyspark %s, python %s", __version__, pyspark.__version__, platform.python_version())
        log.info("%s: %s", run.__name__, {k: v for k, v in kwargs.items() if not isinstance(v, DataFrame)})
        result = run(*args, **kwargs)
        log.info("%s took %.1f s", run.__name__, time.time() - began)
        return result

    logged.__name__, logged.__doc__ = run.__name__, run.__doc__
    return logged


def region_column(atlas_name: str = "") -> str:
    """region_id, or region_id_<atlas>."""
    return f"region_id_{atlas_name}" if atlas_name else "region_id"


@_timed
def locate_cells(*, cells: DataFrame, annotation: DataFrame, atlas_name: str = "", outline: DataFrame | None = None, output_path: str | None = None) -> DataFrame:
    """Cells with the region of their voxel; with an ``outline``, regions resolve to leaves and unknown ones raise. The output is in the order of z, x, y."""
    column = region_column(atlas_name)
    located = atlas.locate(cells, annotation, column)
    if outline is not None:
        placed = atlas.resolve_leaves(located, atlas.checked_tree(outline), column)
        unknown = F.raise_error(F.concat(F.lit("Unknown region: "), F.col(column).cast("string"))).cast("int")
        leaf = F.when(F.col("placement") == "unknown", unknown).when(F.col("placement") == "not_leaf", F.col(column)).otherwise(F.col("leaf_id"))
        located = placed.withColumn(column, leaf).drop("leaf_id", "placement")
    if output_path:
        sinks.write_cells(located, output_path, order=["z", "x", "y"])
    return located


@_timed
def filter_cells(*, cells: DataFrame, cell_filters: list[str], output_path: str | None = None, removed_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept and removed cells of a filter chain, optionally written."""
    kept, removed = filters.filter_cells(cells, cell_filters)
    sinks.write_split(kept, removed, output_path, removed_path)
    return kept, removed


def distributions(cells: DataFrame, measure: str) -> dict[str, DataFrame]:
    """The data behind a measure's distribution panel: log, linear, 1-99 % and 5-95 % histograms (with the scale of quantiles at the bins' ends), the inverse-gamma
    curve, and the panels' titles (panel, title)."""
    values = cells.select(measure).filter(F.col(measure).isNotNull() & ~F.isnan(measure))
    size = values.agg(F.count("*").alias("n"), F.min(measure).alias("low"), F.max(measure).alias("high")).first()
    bins = measures.bin_number(size["n"], 500)
    tables = {"log": measures.log_histogram(values, measure), "linear": measures.linear_histogram(values, measure), "inverse_gamma": measures.inverse_gamma_curve(values, measure)}
    titles = [("log", "Log x (>0)")]
    if size["n"]:
        titles.append(("linear", panels.range_title(size["low"], size["high"], measures.histogram_peak(values, measure, measures.MEASURES.get(measure)))))
    for low, high in ((0.01, 0.99), (0.05, 0.95)):
        name = f"q{low * 100:02.0f}_q{high * 100:02.0f}"
        first, last = measures.exact_quantiles(values, measure, [low, high])
        cut = measures.linear_histogram(values.filter(F.col(measure).between(first, last)) if size["n"] else values, measure, bins=bins)
        scale = (lambda c: panels.value_to_quantile(F.col(c), first, last, low, high)) if size["n"] else (lambda c: F.lit(None).cast("double"))
        tables[name] = cut.withColumns({"low_quantile": scale("low"), "high_quantile": scale("high")})
        titles.append((name, f"{low} - {high} quantiles"))
    return {**tables, "titles": cells.sparkSession.createDataFrame(titles, "panel string, title string")}


@_timed
def summarize_regions(
    *, cells: DataFrame, outline: DataFrame, volumes: DataFrame, output_path: str | None = None, cell_filters: list[str] | None = None, atlas_name: str = "", merge_tree: DataFrame | None = None, levels: bool = False
) -> DataFrame:
    """Counts rolled up over the atlas with volumes and densities: flat, in level layout, or for merged groups.

    ValueError for a broken outline, volumes that do not add up or are of unknown regions, unknown members of merged groups, and a root count that is not the
    number of cells inside. Cells on null and unknown regions or on non-leaves raise at run time.
    """
    if levels and merge_tree is not None:
        raise ValueError("Merged groups have no level layout")
    tree = atlas.checked_tree(outline)
    broken = regions.volume_mismatches(tree, regions.node_volumes(tree, volumes)).collect()
    if broken:
        raise ValueError(f"Volumes do not add up for {len(broken)} regions: {sorted(r['region_id'] for r in broken)}")
    unknown = volumes.select("region_id").join(tree.select("region_id"), "region_id", "left_anti").distinct().limit(20).collect()
    if unknown:
        raise ValueError(f"Volumes of unknown regions: {sorted(r[0] for r in unknown)}")
    kept = filters.filter_cells(cells, cell_filters)[0] if cell_filters else cells
    if merge_tree is not None:
        members = merge_tree.select(F.explode("member_ids").alias("region_id")).filter("region_id is not null").distinct()
        strange = members.join(tree.select("region_id"), "region_id", "left_anti").limit(20).collect()
        if strange:
            raise ValueError(f"Merged groups have unknown members: {sorted(r[0] for r in strange)}")
    placed = atlas.resolve_leaves(kept, tree, region_column(atlas_name), strict=True)
    summary = Stash(regions.region_summary(placed, tree, volumes), "summary").df
    counted = summary.join(tree.filter("parent_id IS NULL").select("region_id"), "region_id").agg(F.sum("n_cells")).first()[0] or 0
    # counted on its own, as a count taken on the way would count rows of repeated tasks twice
    inside = kept.filter(F.col(region_column(atlas_name)) != atlas.OUTSIDE).count()
    if counted != inside:
        raise ValueError(f"The roots count {counted} cells, but {inside} lie inside")
    result = regions.level_layout(summary, tree) if levels else regions.merged_groups(summary, merge_tree) if merge_tree is not None else summary
    if output_path:
        (sinks.write_levels if levels else sinks.write_flat)(result, output_path)
    return result


@_timed
def collate_summaries(*, spark: SparkSession, metadata_path: str, summaries_root: str, channels: list[int], lookup_column: str, first_columns: int, pattern: str, output_path: str | None = None) -> DataFrame | None:
    """Long table of all summaries with the first metadata columns, Channel and Summary filename; None, and no file, when nothing matches."""
    metadata = files.read_metadata(spark, metadata_path)
    index = _index(spark, metadata, lookup_column, summaries_root, channels, pattern)
    if not index:
        log.info("No summary was found")
        return None
    data = files.read_summaries(spark, index)
    first = metadata.columns[1 : 1 + first_columns]
    key = metadata.select("sample_ord", F.col(lookup_column).alias("__sample"), *[F.col(c).alias(f"__m{i}") for i, c in enumerate(first)])
    own = data.columns[4:]
    long = key.join(data, F.col("__sample") == F.col("sample")).select(
        *[F.col(f"__m{i}").alias(c) for i, c in enumerate(first)], F.col("channel").alias("Channel"), F.col("summary_filename").alias("Summary filename"), *[data[c] for c in own]
    )
    if output_path:
        sinks.write_csv_parts(long, output_path)
    return long


def _index(spark: SparkSession, metadata: DataFrame, lookup: str, root: str, channels: list[int], pattern: str) -> list[tuple[str, int, str]]:
    if lookup not in metadata.columns:
        raise ValueError(f"The metadata has no column {lookup}")
    names = [r[0] for r in metadata.orderBy("sample_ord").select(lookup).collect()]  # a line per sample
    return files.find_summaries(spark, root, [n for n in dict.fromkeys(names) if n], channels, pattern)


@_timed
def analyze_summaries(
    *, spark: SparkSession, metadata_path: str, lookup_column: str, factors: list[str], summaries_root: str, channels: list[int], pattern: str, outline: DataFrame, stat_column: str,
    average_columns: list[str] | None = None, region_column: str = "ID", excluded_groups: list[dict[str, str]] | None = None, include_regions: list[int] | None = None, exclude_regions: list[int] | None = None,
    only_leafs: bool = True, t_test: bool = False, false_discovery: bool = False, negative_binomial: bool = False,
    raw_path: str | None = None, means_path: str | None = None, matrix_path: str | None = None, samples_path: str | None = None, analyzed_path: str | None = None,
) -> dict[int, dict[str, DataFrame]] | None:
    """Per channel the tables raw, means, matrix, samples, tests, analyzed (and levels of the negative-binomial comparison), optionally written; None when nothing matches.

    ``analyzed`` holds a row per region with ``p: a vs. b``, ``p-corr: a vs. b`` and ``factor:a-vs-b:measure`` columns.
    """
    factors = [f.lower() for f in factors]
    if "channel" in factors:
        raise ValueError("A factor may not be named channel")
    metadata = files.read_metadata(spark, metadata_path)
    index = _index(spark, metadata, lookup_column, summaries_root, channels, pattern)
    if not index:
        log.info("No summary was found")
        return None
    lower = metadata.toDF(*[c.lower() for c in metadata.columns])
    groups = samples.grouped_metadata(lower.filter(F.col(lookup_column.lower()) != ""), factors, excluded_groups, lookup_column.lower())
    text = files.read_summaries(spark, index)
    names = {c.lower(): c for c in text.columns[4:]}
    data_columns = sorted({stat_column.lower(), *(c.lower() for c in average_columns or [])}, key=list(names).index)
    keys = [c for c in text.columns[4:] if c.lower() not in data_columns]
    if region_column not in keys:
        raise ValueError(f"The summaries have no region column {region_column}")
    typed = text.select("sample", "channel", "row_ord", F.col(region_column).cast("int").alias("__region"), *[F.col(k) for k in keys], *[F.col(names[c]).cast("double").alias(c) for c in data_columns])
    tree = atlas.checked_tree(outline)
    asked = sorted({*(exclude_regions or []), *(include_regions or [])})
    strange = set(asked) - {r[0] for r in tree.filter(F.col("region_id").isin(asked)).select("region_id").collect()} if asked else set()
    if strange:
        raise ValueError(f"Unknown regions to include or exclude: {sorted(strange)}")
    kept = samples.without_regions(typed.join(groups, "sample"), tree, exclude_regions, include_regions, "__region")
    obs = samples.with_leaf_flag(kept, tree, only_leafs, "__region")
    result = {}
    for channel in channels:
        own = obs.filter(F.col("channel") == channel)
        lines = ["row_ord", *keys]
        own_keys = ["row_ord", "__region", "testable"]
        tests = stats.welch(stats.group_moments(own, own_keys, "group_label", stat_column.lower()), own_keys).withColumnRenamed("__region", "region_id")
        tables = {
            "raw": samples.raw_wide(own, lines, data_columns), "means": samples.group_means_wide(own, lines, data_columns), "samples": samples.sample_groups(own, factors),
            "matrix": samples.raw_wide(own.filter("testable"), ["row_ord", "__region"], [stat_column.lower()]).withColumnRenamed("__region", "RegionID"),
            "tests": stats.benjamini_hochberg(tests, ["group_a", "group_b"], testable=F.col("testable")) if t_test or false_discovery else tests.limit(0),
        }
        if negative_binomial:
            counts = own.filter("testable").select(F.col("__region").alias("region_id"), "sample", F.col(stat_column.lower()).alias("n"))
            tables["levels"] = deseq.compare_levels(counts, tables["samples"], factors)
        rows = own.select("row_ord", F.col("__region").alias("region_id"), *[F.col(k) for k in keys if k.lower() != "region_id"]).dropDuplicates(["row_ord"])
        if t_test or false_discovery:
            rows = rows.join(stats.analyzed_wide(tables["tests"], ["row_ord"]), "row_ord", "left")
        tables["analyzed"] = stats.levels_wide(rows, tables["levels"]) if negative_binomial else rows
        for name, path in (("raw", raw_path), ("means", means_path), ("matrix", matrix_path), ("samples", samples_path), ("analyzed", analyzed_path)):
            if path:
                sinks.write_csv(tables[name], sinks.channel_path(path, channel, len(channels) > 1), order="row_ord" if "row_ord" in tables[name].columns else None)
        result[channel] = tables
    return result
