"""Queries of the point-analysis operators over the given tables, with their SQL.

Cells are current rows; summaries and metadata are the last written rows; regions come from the outline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atlas, deseq, filters, measures, regions, samples, stats
from ..operators.latest import current_cells
from ..session import Stash
from ..sources.tables import table

KEY_COLUMNS = ("cell_ord", "image_name", "channel", "det_no", "loaded_at")
FACTORS = ["condition_name"]
CHANNELS = [561, 640]
EXCLUDED_REGIONS = [907]
INCLUDED_REGIONS = [182]


def _cells(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_cells(table(spark, folder, "cells", *KEY_COLUMNS, *columns)).select("cell_ord", *columns)


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    """The outline's tree, written once per query: its windows would else be repeated in every branch of a plan."""
    return Stash(atlas.outline_tree(table(spark, folder, "atlas_outline")), "tree").df


def _placed(spark: SparkSession, folder: str, tree: DataFrame | None = None) -> DataFrame:
    return atlas.resolve_leaves(_cells(spark, folder, "region_id"), _tree(spark, folder) if tree is None else tree)


def _each(part: Callable[[str], DataFrame], names: Iterable) -> DataFrame:
    """The rows of ``part`` of every name, one after another."""
    return reduce(DataFrame.unionAll, [part(n) for n in names])


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """A wide table with one column per label as keys, label, value, empty fields included."""
    return wide.unpivot(keys, [f"`{c}`" for c in wide.columns if c not in keys], "label", "value")


# hierarchy


def tree_from_outline(spark, folder):
    return atlas.outline_tree(table(spark, folder, "atlas_outline")).drop("path")


def tree_closure(spark, folder):
    return atlas.closure(_tree(spark, folder))


def tree_preorder_depth(spark, folder):
    return _tree(spark, folder).select("ord", "region_id", "depth", F.array_join("path", "/").alias("path"))


def tree_validation_report(spark, folder):
    return atlas.tree_problems(_tree(spark, folder))


def tree_validation_planted(spark, folder):
    """The violations of an outline in which every 17th row has another id, every 13th another leaf mark and every 11th its neighbour's abbreviation."""
    outline = table(spark, folder, "atlas_outline")
    every = lambda k: F.pmod("ord", F.lit(k)) == 3
    planted = outline.withColumns({
        "id": F.when(every(17), F.col("id") + 1).otherwise(F.col("id")), "is_leaf": F.when(every(13), "").otherwise(F.col("is_leaf")),
        "abbreviation": F.when(every(11), F.concat(F.lit("x"), "abbreviation")).otherwise(F.col("abbreviation")),
    })
    return atlas.tree_problems(Stash(atlas.outline_tree(planted), "tree").df)


def leaf_resolution(spark, folder):
    return _placed(spark, folder).select("cell_ord", "leaf_id", "placement")


def locate_voxels(spark, folder):
    located = atlas.locate(_cells(spark, folder, "z", "y", "x"), table(spark, folder, "annotation"))
    return atlas.resolve_leaves(located, _tree(spark, folder), "voxel_region").select("cell_ord", "voxel_region", "leaf_id")


# filters


def _chained(spark, folder, texts):
    """Kept and removed cells. Where a threshold depends on the data, the current rows are written once, as several scans follow."""
    parsed = [filters.parse_filter(t) for t in texts]
    cells = _cells(spark, folder, *dict.fromkeys(f.column for f in parsed))
    if any(f.kind for f in parsed):
        cells = Stash(cells, "current").df
    return filters.filter_cells(cells, list(texts))


def _filtered(spark, folder, *texts):
    return _chained(spark, folder, texts)[0].select("cell_ord")


def filter_fixed(spark, folder):
    return _filtered(spark, folder, "r_xy>2", "center_intensity<=500")


def filter_percentile(spark, folder):
    return _filtered(spark, folder, "r_z>0", "r_z>=p25")


def filter_mean(spark, folder):
    return _filtered(spark, folder, "r_xy>0", "r_xy<mean")


def filter_peak(spark, folder):
    return _filtered(spark, folder, "r_xy>0", "r_xy>=peak")


CHAIN = ("r_xy>0", "r_xy_max_std<100", "center_intensity>0", "center_intensity>=p50", "r_xy<=p90")


def filter_chain(spark, folder):
    return _filtered(spark, folder, *CHAIN)


def filter_removed(spark, folder):
    return _chained(spark, folder, CHAIN)[1].select("cell_ord", "removed_stage")


# distributions


def _per_measure(spark, folder, part: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``part`` of every measure's current values inside its domain, one after another. Current rows are written once, as many scans follow."""
    cells = Stash(_cells(spark, folder, *measures.MEASURES), "measures").df

    def values(m: str) -> DataFrame:
        c, limits = F.col(m), measures.MEASURES[m]
        inside = c.isNotNull() & ~F.isnan(c)
        return cells.filter(inside & (c > limits[0]) & (c < limits[1]) if limits else inside).select(m)

    return _each(lambda m: part(values(m), m), measures.MEASURES)


def hist_peak(spark, folder):
    return _per_measure(spark, folder, lambda values, m: measures.peak_row(values, m, measures.MEASURES[m])).withColumn("peak", F.round("peak", 6))


def _histogram(bins: DataFrame, measure: str) -> DataFrame:
    return bins.select(F.lit(measure).alias("measure"), "bin", F.round("low", 6).alias("low"), "n", F.round("density", 6).alias("density"))


def hist_linear(spark, folder):
    return _per_measure(spark, folder, lambda values, m: _histogram(measures.linear_histogram(values, m), m))


def hist_log(spark, folder):
    return _per_measure(spark, folder, lambda values, m: _histogram(measures.log_histogram(values, m), m))


TRIMS = (1, 5)


def hist_trimmed(spark, folder):
    """Histograms of what lies between the p % and (100 - p) % quantiles."""

    def both(values: DataFrame, m: str) -> DataFrame:
        bins = measures.bin_number(values.count(), 500)
        return _each(lambda p: _histogram(measures.linear_histogram(measures.trimmed(values, m, p / 100, 1 - p / 100), m, bins=bins), m).withColumn("cut", F.lit(p)), TRIMS)

    return _per_measure(spark, folder, both)


def measure_summary(spark, folder):
    names = list(measures.MEASURES)
    values = Stash(_cells(spark, folder, *names), "measures").df
    found = measures.measure_summary(values, names)
    return found.select("measure", "n", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


# regions


def region_counts(spark, folder):
    return regions.leaf_counts(_placed(spark, folder))


def region_rollup(spark, folder):
    tree = _tree(spark, folder)
    return regions.roll_up(regions.leaf_counts(_placed(spark, folder, tree)), tree)


def region_outside(spark, folder):
    return regions.placement_counts(_placed(spark, folder))


def other_volume(spark, folder):
    return regions.node_volumes(_tree(spark, folder), table(spark, folder, "region_volumes"))


def volume_consistency(spark, folder):
    tree = _tree(spark, folder)
    return regions.volume_mismatches(tree, regions.node_volumes(tree, table(spark, folder, "region_volumes")))


def volume_violations(spark, folder):
    """Nodes that do not add up once every 7th region id counts two voxels and 0.5 mm3 more."""
    tree, volumes = _tree(spark, folder), table(spark, folder, "region_volumes")
    more = F.when(F.pmod("region_id", F.lit(7)) == 0, 1).otherwise(0)
    planted = volumes.withColumns({"aggregated_voxel_count": F.col("aggregated_voxel_count") + 2 * more, "aggregated_volume_mm3": F.col("aggregated_volume_mm3") + 0.5 * more})
    return regions.volume_mismatches(tree, regions.node_volumes(tree, planted))


def root_total(spark, folder):
    """The roots' counts and the number of cells placed below them, which must be equal."""
    tree = _tree(spark, folder)
    placed = _placed(spark, folder, tree)
    return regions.root_totals(regions.roll_up(regions.leaf_counts(placed), tree), tree, placed)


def _summary(spark, folder, tree=None):
    tree = _tree(spark, folder) if tree is None else tree
    return regions.region_summary(_placed(spark, folder, tree), tree, table(spark, folder, "region_volumes"))


def region_summary(spark, folder):
    return _rounded(_summary(spark, folder), "volume_mm3", "cells_per_mm3", "cells_per_voxel")


def region_density(spark, folder):
    return _rounded(_summary(spark, folder).select("region_id", "cells_per_mm3", "cells_per_voxel"), "cells_per_mm3", "cells_per_voxel")


def image_region_rollup(spark, folder):
    """Roll-up of every image and channel in one job."""
    cells = current_cells(table(spark, folder, "cells", *KEY_COLUMNS, "region_id"))
    keys, tree = ["image_name", "channel"], _tree(spark, folder)
    return regions.roll_up(regions.leaf_counts(atlas.resolve_leaves(cells, tree), keys), tree, keys)


def level_export(spark, folder):
    tree = _tree(spark, folder)
    return _rounded(regions.level_layout(_summary(spark, folder, tree), tree), "total_volume_mm3", "cell_density_mm3")


def merged_groups(spark, folder):
    return _rounded(regions.merged_groups(_summary(spark, folder), table(spark, folder, "merge_tree")), "volume_mm3", "cells_per_mm3")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# samples


def _metadata(spark, folder):
    return samples.latest_metadata(table(spark, folder, "images"))


def _summaries(spark, folder):
    return samples.latest_summaries(table(spark, folder, "summaries"))


def _obs(spark, folder, excluded=None):
    return samples.observations(_metadata(spark, folder), _summaries(spark, folder), FACTORS, CHANNELS, excluded)


def collate_long(spark, folder):
    return samples.collate(_metadata(spark, folder), _summaries(spark, folder), CHANNELS, 4)


EXCLUDED = [{"condition_name": "Saline", "sex": "f"}, {"genotype": "KO"}]


def exclude_groups(spark, folder):
    return samples.grouped_metadata(_metadata(spark, folder), ["condition_name", "genotype", "sex"], EXCLUDED)


def sample_metadata(spark, folder):
    return samples.sample_groups(_obs(spark, folder), FACTORS)


_OBS = ("sample", "channel", "id", "total_cells")


def exclude_regions(spark, folder):
    return samples.without_regions(_obs(spark, folder), _tree(spark, folder), exclude=EXCLUDED_REGIONS).select(*_OBS)


def include_regions(spark, folder):
    return samples.without_regions(_obs(spark, folder), _tree(spark, folder), include=INCLUDED_REGIONS).select(*_OBS)


def only_leafs(spark, folder):
    return samples.with_leaf_flag(_obs(spark, folder), _tree(spark, folder)).filter("testable").select(*_OBS)


def group_n(spark, folder):
    return samples.group_means(_obs(spark, folder), ["channel", "id"], "total_cells").withColumn("mean_value", F.round("mean_value", 6))


# wide tables come as one row per field, so that every field can be compared


def raw_wide(spark, folder):
    return _long(samples.raw_wide(_obs(spark, folder), ["channel", "id"], ["total_cells"]), ["channel", "id"])


def group_means_wide(spark, folder):
    wide = samples.group_means_wide(_obs(spark, folder), ["channel", "id"], ["total_cells"])
    numbers = wide.select("channel", "id", *[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns[2:]])
    return _long(numbers, ["channel", "id"]).withColumn("value", F.round("value", 6))


def stat_matrix(spark, folder):
    leaves = samples.with_leaf_flag(_obs(spark, folder), _tree(spark, folder)).filter("testable")
    return _long(samples.raw_wide(leaves, ["channel", "id"], ["total_cells"]), ["channel", "id"]).withColumnRenamed("id", "RegionID")


# comparisons


def _tests(spark, folder):
    return stats.welch(stats.group_moments(_obs(spark, folder), ["channel", "id"], "group_label", "total_cells"), ["channel", "id"])


def group_moments(spark, folder):
    return _rounded(stats.group_moments(_obs(spark, folder), ["channel", "id"], "group_label", "total_cells"), "mean", "variance")


def welch_t(spark, folder):
    return _rounded(_tests(spark, folder).drop("p"), "t", "df")


def welch_p(spark, folder):
    return _tests(spark, folder).drop("t", "df").withColumn("p", F.round("p", 4))


def bh_fdr(spark, folder):
    flagged = samples.with_leaf_flag(_tests(spark, folder), _tree(spark, folder))
    corrected = stats.benjamini_hochberg(flagged, ["channel", "group_a", "group_b"], testable=F.col("testable"))
    return corrected.select("channel", "id", "group_a", "group_b", F.round("p_corr", 4).alias("p_corr"))


def analyzed_wide(spark, folder):
    flagged = samples.with_leaf_flag(_tests(spark, folder), _tree(spark, folder))
    corrected = Stash(stats.benjamini_hochberg(flagged, ["channel", "group_a", "group_b"], testable=F.col("testable")), "tests").df
    return _long(stats.analyzed_wide(corrected, ["channel", "id"]), ["channel", "id"]).withColumn("value", F.round("value", 4))


def _counts(spark, folder):
    """Counts of leaf regions, written once as each channel reads them more than once."""
    leaves = samples.with_leaf_flag(_obs(spark, folder), _tree(spark, folder)).filter("testable AND total_cells IS NOT NULL")
    return Stash(leaves.select("channel", F.col("id").alias("region_id"), "sample", F.col("total_cells").alias("n"), "condition_name"), "analysis").df


def _by_channel(counts: DataFrame, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _each(lambda c: part(counts.filter(F.col("channel") == c).drop("channel")).withColumn("channel", F.lit(c)), CHANNELS)


def level_pairs(spark, folder):
    return samples.level_pairs(samples.grouped_metadata(_metadata(spark, folder), ["condition_name", "genotype", "sex"]), ["condition_name", "genotype", "sex"])


def deseq_size_factors(spark, folder):
    return _by_channel(_counts(spark, folder), deseq.size_factors).withColumn("size_factor", F.round("size_factor", 6))


def deseq_base_mean(spark, folder):
    return _by_channel(_counts(spark, folder), lambda own: deseq.base_means(own, deseq.size_factors(own))).withColumn("base_mean", F.round("base_mean", 6))


def deseq_wald(spark, folder):
    return _by_channel(_counts(spark, folder), lambda own: deseq.compare_levels(own, own.select("sample", "condition_name").distinct(), FACTORS))


def invgamma_pdf(spark, folder):
    """The fitted curve of every measure; x and density to 5 digits of their size."""
    digits = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.format_string("%.4e", c).cast("double")).alias(c)
    return _per_measure(spark, folder, lambda values, m: measures.inverse_gamma_curve(values, m).select(F.lit(m).alias("measure"), digits("x"), digits("density")))


_NAMES = (
    "tree_from_outline tree_closure tree_preorder_depth tree_validation_report tree_validation_planted leaf_resolution locate_voxels filter_fixed filter_percentile filter_mean filter_peak "
    "filter_chain filter_removed hist_peak hist_linear hist_log hist_trimmed measure_summary region_counts region_rollup region_outside other_volume volume_consistency volume_violations root_total "
    "region_summary region_density image_region_rollup level_export merged_groups collate_long exclude_groups sample_metadata exclude_regions include_regions only_leafs group_n raw_wide "
    "group_means_wide stat_matrix group_moments welch_t welch_p bh_fdr analyzed_wide level_pairs deseq_size_factors deseq_base_mean deseq_wald invgamma_pdf"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}

# SQL

_CELLS = """cell AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name, channel, det_no ORDER BY loaded_at DESC NULLS LAST, cell_ord DESC) AS rn FROM cells) WHERE rn = 1)"""
_LEVELS = [f"nullif(trim(regionlevel_{k:02d}), '')" for k in range(1, 8)]
TREE_SQL = f"""o AS (SELECT ord, id AS region_id, trim(abbreviation) AS acronym, coalesce({", ".join(_LEVELS)}, '') AS name,
    coalesce({", ".join(f"CASE WHEN {x} IS NOT NULL THEN {k} END" for k, x in enumerate(_LEVELS))}, 6) AS indent, lower(trim(coalesce(is_leaf, ''))) = 'leaf' AS marked_leaf FROM atlas_outline),
  up AS (SELECT c.ord, max(p.ord) AS parent_ord FROM o c JOIN o p ON p.ord < c.ord AND p.indent < c.indent GROUP BY c.ord),
  linked AS (SELECT o.*, p.region_id AS parent_id FROM o LEFT JOIN up USING (ord) LEFT JOIN o p ON p.ord = up.parent_ord),
  walk AS (SELECT region_id, region_id AS ancestor_id, 0 AS distance FROM linked UNION ALL
    SELECT w.region_id, l.parent_id, w.distance + 1 FROM walk w JOIN linked l ON l.region_id = w.ancestor_id WHERE l.parent_id IS NOT NULL),
  depths AS (SELECT region_id, max(distance) AS depth, string_agg(CAST(ancestor_id AS VARCHAR), '/' ORDER BY distance DESC) AS path FROM walk GROUP BY region_id),
  tree AS (SELECT l.ord, l.region_id, l.acronym, l.name, l.parent_id, d.depth, d.path, NOT EXISTS (SELECT 1 FROM linked c WHERE c.parent_id = l.region_id) AS is_leaf,
    l.marked_leaf, l.acronym LIKE '%-other' AS is_other FROM linked l JOIN depths d USING (region_id)),
  leafmap AS (SELECT t.region_id, coalesce(x.region_id, t.region_id) AS leaf_id, t.is_leaf OR x.region_id IS NOT NULL AS of_leaf FROM tree t LEFT JOIN tree x ON x.parent_id = t.region_id AND x.is_other)"""
_PLACE = """CASE WHEN {0} IS NULL THEN 'unlocated' WHEN {0} = 0 THEN 'outside' WHEN m.region_id IS NULL THEN 'unknown' WHEN NOT m.of_leaf THEN 'not_leaf' ELSE 'leaf' END"""
_PLACED = f"""placed AS (SELECT c.*, {_PLACE.format("c.region_id")} AS placement, CASE WHEN c.region_id = 0 THEN 0 WHEN m.of_leaf THEN m.leaf_id END AS leaf_id
    FROM cell c LEFT JOIN leafmap m ON m.region_id = c.region_id)"""
_ROLL = """counted AS (SELECT leaf_id AS region_id, count(*) AS n FROM placed WHERE placement = 'leaf' GROUP BY leaf_id),
  rolled AS (SELECT t.region_id, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_cells FROM tree t LEFT JOIN walk w ON w.ancestor_id = t.region_id LEFT JOIN counted c ON c.region_id = w.region_id GROUP BY t.region_id)"""
_VOLUME = """given AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY loaded_at DESC, aggregated_voxel_count DESC) AS rn FROM region_volumes) WHERE rn = 1),
  readv AS (SELECT t.region_id, t.parent_id, t.is_other, coalesce(g.aggregated_voxel_count, 0) AS voxels, coalesce(g.aggregated_volume_mm3, 0) AS mm3 FROM tree t LEFT JOIN given g USING (region_id)),
  normal AS (SELECT parent_id, sum(voxels) AS voxels, sum(mm3) AS mm3 FROM readv WHERE NOT is_other GROUP BY parent_id),
  volume AS (SELECT r.region_id, r.parent_id, CAST(CASE WHEN r.is_other THEN p.voxels - coalesce(n.voxels, 0) ELSE r.voxels END AS BIGINT) AS volume_voxels,
    CASE WHEN r.is_other THEN p.mm3 - coalesce(n.mm3, 0) ELSE r.mm3 END AS volume_mm3 FROM readv r LEFT JOIN readv p ON p.region_id = r.parent_id LEFT JOIN normal n ON n.parent_id = r.parent_id)"""
_SUMMARY = f"""{_CELLS}, {TREE_SQL}, {_PLACED}, {_ROLL}, {_VOLUME},
  summary AS (SELECT t.ord, t.region_id, t.acronym, t.name, v.volume_voxels, v.volume_mm3, r.n_cells, CASE WHEN v.volume_mm3 = 0 THEN 0 ELSE r.n_cells / v.volume_mm3 END AS cells_per_mm3,
    CASE WHEN v.volume_voxels = 0 THEN 0 ELSE r.n_cells / v.volume_voxels END AS cells_per_voxel FROM tree t JOIN volume v USING (region_id) JOIN rolled r USING (region_id))"""

_OK = "CAST({0} AS VARCHAR) <> 'nan'"


def _values(column: str) -> str:
    limits = measures.MEASURES[column]
    inside = f"AND {column} > {limits[0]} AND {column} < {limits[1]}" if limits else ""
    return f"""{_CELLS}, val AS (SELECT {column} AS v FROM cell WHERE {_OK.format(column)} {inside})"""


_EDGES = """size AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM {0}), shape AS (SELECT *, greatest(25, least({1}, {2} // 1000)) AS bins FROM size),
  spine AS (SELECT unnest(range(bins)) AS bin FROM shape), counts AS (SELECT least(CAST(floor((v - low) / (high - low) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM {0}, shape GROUP BY 1),
  hist AS (SELECT CAST(s.bin AS INT) AS bin, h.low + s.bin * (h.high - h.low) / h.bins AS low, h.low + (s.bin + 1) * (h.high - h.low) / h.bins AS high, coalesce(c.n, 0) AS n,
    coalesce(c.n, 0) / (h.n * ((h.high - h.low) / h.bins)) AS density FROM spine s CROSS JOIN shape h LEFT JOIN counts c USING (bin))"""
_PEAK = """@values, q AS (SELECT greatest(quantile_cont(v, 0.01), @low) AS a, least(quantile_cont(v, 0.99), @high) AS b FROM val), cutv AS (SELECT v FROM val, q WHERE v BETWEEN a AND b),
  @edges, smooth AS (SELECT bin, (low + high) / 2 AS centre, list_sort([coalesce(lag(n) OVER w, n), n, coalesce(lead(n) OVER w, n)])[2] AS m FROM hist WINDOW w AS (ORDER BY bin)),
  peak AS (SELECT centre AS peak FROM smooth ORDER BY m DESC, bin LIMIT 1)"""



def _peak(column: str) -> str:
    low, high = measures.MEASURES[column] or ("CAST('-inf' AS DOUBLE)", "CAST('inf' AS DOUBLE)")
    return _PEAK.replace("@values", _values(column)).replace("@low", str(low)).replace("@high", str(high)).replace("@edges", _EDGES.format("cutv", 1000, "n"))


_META = """meta AS (SELECT image_name, condition_name, genotype, sex FROM (SELECT trim(image_name) AS image_name, trim(condition_name) AS condition_name, trim(genotype) AS genotype, trim(sex) AS sex,
    row_number() OVER (PARTITION BY trim(image_name) ORDER BY loaded_at DESC NULLS LAST, trim(condition_name) DESC NULLS LAST, trim(genotype) DESC NULLS LAST, trim(sex) DESC NULLS LAST, acquired_at DESC NULLS LAST) AS rn
    FROM images WHERE trim(image_name) <> '') WHERE rn = 1),
  sums AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name, channel, id ORDER BY loaded_at DESC NULLS LAST, summary_row DESC) AS rn FROM summaries) WHERE rn = 1 AND channel IN (561, 640)),
  obs AS (SELECT s.image_name AS sample, s.channel, s.id, s.total_cells, lower(coalesce(m.condition_name, '')) AS group_label FROM sums s JOIN meta m USING (image_name))"""
_MOMENTS = f"""{_META}, moments AS (SELECT channel, id, group_label AS "group", count(total_cells) AS n, avg(total_cells) AS mean, coalesce(var_samp(total_cells), 'nan'::DOUBLE) AS variance FROM obs GROUP BY ALL HAVING count(total_cells) > 0)"""
_WELCH = f"""{_MOMENTS}, pairs AS (SELECT a.channel, a.id, a."group" AS group_a, b."group" AS group_b, a.n AS na, b.n AS nb, a.mean - b.mean AS d, a.variance / a.n AS va, b.variance / b.n AS vb
    FROM moments a JOIN moments b ON a.channel = b.channel AND a.id = b.id AND a."group" < b."group"),
  tests AS (SELECT channel, id, group_a, group_b, CASE WHEN na < 2 OR nb < 2 THEN 'nan'::DOUBLE WHEN va + vb = 0 THEN CASE WHEN d = 0 THEN 'nan'::DOUBLE WHEN d > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE d / sqrt(va + vb) END AS t,
    CASE WHEN na < 2 OR nb < 2 OR va + vb = 0 THEN 'nan'::DOUBLE ELSE (va + vb) ** 2 / (va ** 2 / greatest(na - 1, 1) + vb ** 2 / greatest(nb - 1, 1)) END AS df FROM pairs)"""
#: Student's t tail by Simpson's rule: with t = sqrt(df) / tan(angle) the density is a power of the sine, and angle = a0 u^4 makes it smooth at 0.
_P = f"""{_WELCH}, span AS (SELECT *, pi() / 2 - atan(abs(t) / sqrt(df)) AS a0 FROM tests WHERE CAST(df AS VARCHAR) <> 'nan'),
  area AS (SELECT channel, id, group_a, group_b, any_value(2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) / 12000) * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * 4 * (k / 4000.0) ** 3 * a0 * sin(a0 * (k / 4000.0) ** 4) ** (df - 1)) AS p
    FROM span, (SELECT unnest(range(4001)) AS k) GROUP BY channel, id, group_a, group_b),
  tested AS (SELECT t.channel, t.id, t.group_a, t.group_b, CASE WHEN a.p IS NOT NULL THEN a.p WHEN CAST(t.t AS VARCHAR) IN ('inf', '-inf') THEN 0 ELSE 'nan'::DOUBLE END AS p FROM tests t LEFT JOIN area a USING (channel, id, group_a, group_b))"""

_BH = f"""{_P}, flagged AS (SELECT *, CAST(p AS VARCHAR) <> 'nan' AND id NOT IN (SELECT region_id FROM tree WHERE NOT is_leaf) AS ok FROM tested),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY channel, group_a, group_b, ok) AS m, row_number() OVER (PARTITION BY channel, group_a, group_b, ok ORDER BY p) AS rk FROM flagged),
  corrected AS (SELECT *, CASE WHEN ok THEN round(least(1, min(p * m / rk) OVER (PARTITION BY channel, group_a, group_b, ok ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) ELSE -1 END AS p_corr FROM ranked)"""


def _deseq(channel: int) -> str:
    return f"""{TREE_SQL}, {_META}, cnt AS (SELECT id AS region_id, sample, total_cells AS n FROM obs WHERE channel = {channel} AND total_cells IS NOT NULL AND id NOT IN (SELECT region_id FROM tree WHERE NOT is_leaf)),
  logs AS (SELECT region_id, count(*) FILTER (n > 0) AS held, avg(CASE WHEN n > 0 THEN ln(n) END) AS mean_log FROM cnt GROUP BY region_id),
  whole AS (SELECT * FROM logs WHERE held = (SELECT count(DISTINCT sample) FROM cnt)),
  usable AS (SELECT * FROM whole UNION ALL SELECT * FROM logs WHERE held > 0 AND NOT EXISTS (SELECT 1 FROM whole)),
  sf AS (SELECT sample, exp(median(ln(n) - mean_log)) AS size_factor FROM cnt JOIN usable USING (region_id) WHERE n > 0 GROUP BY sample)"""


_R = f"WITH RECURSIVE {TREE_SQL}"
_OBS_SQL = "SELECT sample, channel, id, total_cells FROM obs"

_MISMATCH = f"""WITH RECURSIVE {TREE_SQL}, {_VOLUME}, child AS (SELECT parent_id AS region_id, sum(volume_voxels) AS child_voxels, sum(volume_mm3) AS child_mm3 FROM volume GROUP BY parent_id),
      judged AS (SELECT v.region_id, v.volume_voxels AS voxels, CAST(c.child_voxels AS BIGINT) AS child_voxels, abs(v.volume_mm3 - c.child_mm3) > 1e-9 * greatest(abs(v.volume_mm3), abs(c.child_mm3)) AS mm3_differs FROM volume v JOIN child c USING (region_id))
      SELECT * FROM judged WHERE voxels <> child_voxels OR mm3_differs"""
_VALIDATION = f"""{_R}, both_ AS (SELECT t.*, p.acronym AS parent_acronym, count(*) OVER (PARTITION BY t.region_id) AS n FROM tree t LEFT JOIN tree p ON p.region_id = t.parent_id)
      SELECT 'duplicate_id' AS rule, region_id FROM both_ WHERE n > 1 UNION ALL SELECT 'leaf_mark', region_id FROM both_ WHERE is_leaf <> marked_leaf
      UNION ALL SELECT 'other_id', region_id FROM both_ WHERE is_other AND region_id <> parent_id + 20000 UNION ALL SELECT 'other_acronym', region_id FROM both_ WHERE is_other AND acronym <> parent_acronym || '-other'
      UNION ALL SELECT 'second_root', region_id FROM both_ WHERE parent_id IS NULL AND ord > (SELECT min(ord) FROM both_)"""

SQL = {
    "tree_from_outline": f"{_R} SELECT ord, region_id, acronym, name, parent_id, CAST(depth AS INT) AS depth, is_leaf, marked_leaf, is_other FROM tree",
    "tree_closure": f"{_R} SELECT ancestor_id, region_id, CAST(distance AS INT) AS distance FROM walk",
    "tree_preorder_depth": f"{_R} SELECT ord, region_id, CAST(depth AS INT) AS depth, path FROM tree",
    "tree_validation_report": _VALIDATION,
    "tree_validation_planted": _VALIDATION.replace("FROM atlas_outline)", "FROM planted)").replace("WITH RECURSIVE ", """WITH RECURSIVE planted AS (SELECT * REPLACE (CASE WHEN ord % 17 = 3 THEN id + 1 ELSE id END AS id,
      CASE WHEN ord % 13 = 3 THEN '' ELSE is_leaf END AS is_leaf, CASE WHEN ord % 11 = 3 THEN 'x' || abbreviation ELSE abbreviation END AS abbreviation) FROM atlas_outline), """),
    "leaf_resolution": f"WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED} SELECT cell_ord, leaf_id, placement FROM placed",
    "locate_voxels": f"""WITH RECURSIVE {_CELLS}, {TREE_SQL}, spot AS (SELECT cell_ord, CASE WHEN {_OK.format("z")} AND {_OK.format("y")} AND {_OK.format("x")} THEN true END AS known, TRY_CAST(round_even(z, 0) AS INT) AS iz, TRY_CAST(round_even(y, 0) AS INT) AS iy, TRY_CAST(round_even(x, 0) AS INT) AS ix FROM cell),
      located AS (SELECT cell_ord, CASE WHEN known THEN CASE WHEN ix < 0 THEN 0 ELSE coalesce(a.labels[ix + 1], 0) END END AS voxel_region FROM spot LEFT JOIN annotation a ON a.z = iz AND a.y = iy)
      SELECT cell_ord, voxel_region, CASE WHEN voxel_region = 0 THEN 0 WHEN m.of_leaf THEN m.leaf_id END AS leaf_id FROM located LEFT JOIN leafmap m ON m.region_id = voxel_region""",
    "filter_fixed": f"WITH {_CELLS} SELECT cell_ord FROM cell WHERE {_OK.format('r_xy')} AND r_xy > 2 AND {_OK.format('center_intensity')} AND center_intensity <= 500",
    "filter_percentile": f"WITH {_CELLS}, a AS (SELECT cell_ord, r_z FROM cell WHERE {_OK.format('r_z')} AND r_z > 0) SELECT cell_ord FROM a WHERE r_z >= (SELECT quantile_cont(r_z, 0.25) FROM a)",
    "filter_mean": f"WITH {_CELLS}, a AS (SELECT cell_ord, r_xy FROM cell WHERE {_OK.format('r_xy')} AND r_xy > 0) SELECT cell_ord FROM a WHERE r_xy < (SELECT avg(r_xy) FROM a)",
    "filter_peak": f"WITH {_peak('r_xy').replace('r_xy > 1e-09 AND r_xy < 10000.0', 'r_xy > 0')} SELECT cell_ord FROM cell WHERE {_OK.format('r_xy')} AND r_xy > 0 AND r_xy >= (SELECT peak FROM peak)",
    "hist_peak": " UNION ALL ".join(f"SELECT * FROM (WITH {_peak(m)} SELECT '{m}' AS measure, round(peak, 6) AS peak FROM peak)" for m in measures.MEASURES),
    "hist_linear": " UNION ALL ".join(
        f"SELECT * FROM (WITH {_values(m)}, {_EDGES.format('val', 500, 'n')} SELECT '{m}' AS measure, bin, round(low, 6) AS low, n, round(density, 6) AS density FROM hist)" for m in measures.MEASURES
    ),
    "hist_log": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_values(m)}, shape AS (SELECT greatest(25, least(500, count(*) // 1000)) AS edges, floor(log10(min(v) FILTER (v > 0))) AS a, ceil(log10(max(v))) AS b FROM val),
      spine AS (SELECT CAST(k AS INT) AS bin, edges - 2 AS last, 10 ** (a + k * (b - a) / (edges - 1)) AS low, 10 ** (a + (k + 1) * (b - a) / (edges - 1)) AS high FROM (SELECT *, unnest(range(edges - 1)) AS k FROM shape)),
      counts AS (SELECT bin, count(*) AS n FROM val JOIN spine ON v >= low AND (v < high OR (bin = last AND v <= high)) GROUP BY bin)
      SELECT '{m}' AS measure, bin, round(low, 6) AS low, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT sum(n) FROM counts) * (high - low)), 6) AS density FROM spine LEFT JOIN counts USING (bin))"""
        for m in measures.MEASURES
    ),
    "hist_trimmed": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_values(m)}, q AS (SELECT quantile_cont(v, {t / 100}) AS a, quantile_cont(v, {1 - t / 100}) AS b FROM val), cutv AS (SELECT v FROM val, q WHERE v BETWEEN a AND b),
      {_EDGES.format("cutv", 500, "(SELECT count(*) FROM val)")} SELECT '{m}' AS measure, {t} AS cut, bin, round(low, 6) AS low, n, round(density, 6) AS density FROM hist)"""
        for m in measures.MEASURES
        for t in TRIMS
    ),
    "measure_summary": f"WITH {_CELLS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count(*) AS n, round(avg({c}), 4) AS mean, round(min({c}), 4) AS least, round(max({c}), 4) AS greatest, round(quantile_cont({c}, 0.01), 4) AS q01, "
        f"round(quantile_cont({c}, 0.05), 4) AS q05, round(quantile_cont({c}, 0.95), 4) AS q95, round(quantile_cont({c}, 0.99), 4) AS q99 FROM cell WHERE {_OK.format(c)}"
        for c in measures.MEASURES
    ),
    "region_counts": f"WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED}, {_ROLL} SELECT region_id, n FROM counted",
    "region_rollup": f"WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED}, {_ROLL} SELECT region_id, n_cells FROM rolled",
    "region_outside": f"WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED} SELECT placement, count(*) AS n FROM placed GROUP BY placement",
    "other_volume": f"WITH RECURSIVE {TREE_SQL}, {_VOLUME} SELECT region_id, volume_voxels, volume_mm3 FROM volume",
    "volume_consistency": _MISMATCH,
    "volume_violations": _MISMATCH.replace("FROM region_volumes)", "FROM planted)").replace("WITH RECURSIVE ", """WITH RECURSIVE planted AS (SELECT * REPLACE (aggregated_voxel_count + CASE WHEN region_id % 7 = 0 THEN 2 ELSE 0 END AS aggregated_voxel_count,
      aggregated_volume_mm3 + CASE WHEN region_id % 7 = 0 THEN 0.5 ELSE 0 END AS aggregated_volume_mm3) FROM region_volumes), """),
    "root_total": f"""WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED}, {_ROLL} SELECT t.region_id, r.n_cells, (SELECT count(*) FROM placed p JOIN walk w ON w.region_id = p.leaf_id AND w.ancestor_id = t.region_id WHERE p.placement = 'leaf') AS n_placed
      FROM tree t JOIN rolled r USING (region_id) WHERE t.parent_id IS NULL""",
    "region_summary": f"WITH RECURSIVE {_SUMMARY} SELECT ord, region_id, acronym, name, volume_voxels, round(volume_mm3, 6) AS volume_mm3, n_cells, round(cells_per_mm3, 6) AS cells_per_mm3, round(cells_per_voxel, 6) AS cells_per_voxel FROM summary",
    "region_density": f"WITH RECURSIVE {_SUMMARY} SELECT region_id, round(cells_per_mm3, 6) AS cells_per_mm3, round(cells_per_voxel, 6) AS cells_per_voxel FROM summary",
    "image_region_rollup": f"""WITH RECURSIVE {_CELLS}, {TREE_SQL}, {_PLACED} SELECT p.image_name, p.channel, w.ancestor_id AS region_id, count(*) AS n_cells
      FROM placed p JOIN walk w ON w.region_id = p.leaf_id WHERE p.placement = 'leaf' GROUP BY ALL""",
    "level_export": f"""WITH RECURSIVE {_SUMMARY} SELECT s.ord, s.region_id AS id, s.acronym AS abbreviation, CASE WHEN t.is_leaf THEN 'TRUE' ELSE 'FALSE' END AS leaf, coalesce(t.parent_id, -1) AS parent_id,
      CASE WHEN t.is_other THEN t.parent_id ELSE s.region_id END AS original_id, CASE WHEN t.is_other THEN p.acronym ELSE s.acronym END AS original_abbreviation, s.volume_voxels AS total_voxels,
      round(s.volume_mm3, 6) AS total_volume_mm3, s.n_cells AS total_cells, round(s.cells_per_mm3, 6) AS cell_density_mm3, {", ".join(f"CASE WHEN t.depth = {k} THEN s.name ELSE '' END AS region_level_{k + 1:02d}" for k in range(7))}
      FROM summary s JOIN tree t USING (region_id) LEFT JOIN tree p ON p.region_id = t.parent_id""",
    "merged_groups": f"""WITH RECURSIVE {_SUMMARY}, last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, len(member_ids) DESC, member_ids) AS rn FROM merge_tree) WHERE rn = 1),
      member AS (SELECT id AS group_id, abbreviation, description, unnest(member_ids) AS region_id FROM last_)
      SELECT group_id, m.abbreviation AS acronym, m.description AS name, count(s.n_cells) AS n_members, CAST(sum(s.volume_voxels) AS BIGINT) AS volume_voxels, round(sum(s.volume_mm3), 6) AS volume_mm3, CAST(sum(s.n_cells) AS BIGINT) AS n_cells,
      round(CASE WHEN sum(s.volume_mm3) = 0 THEN 0 ELSE sum(s.n_cells) / sum(s.volume_mm3) END, 6) AS cells_per_mm3, count(*) FILTER (s.n_cells IS NULL) AS n_unknown
      FROM member m LEFT JOIN summary s USING (region_id) WHERE m.region_id IS NOT NULL GROUP BY ALL HAVING count(s.n_cells) > 0""",
    "collate_long": f"""WITH {_META} SELECT m.image_name, m.condition_name, m.genotype, m.sex, s.channel, s.id, s.abbreviation, s.leaf, s.parent_id, s.original_id, s.original_abbreviation, s.total_voxels, s.total_volume_mm3, s.total_cells, s.cell_density_mm3,
      {", ".join(f"s.region_level_{k:02d}" for k in range(1, 8))} FROM sums s JOIN meta m USING (image_name)""",
    "exclude_groups": f"""WITH {_META}, low AS (SELECT image_name AS sample, lower(coalesce(condition_name, '')) AS condition_name, lower(coalesce(genotype, '')) AS genotype, lower(coalesce(sex, '')) AS sex FROM meta)
      SELECT *, condition_name || '-' || genotype || '-' || sex AS group_label FROM low WHERE NOT (condition_name = 'saline' AND sex = 'f') AND NOT (genotype = 'ko')""",
    "sample_metadata": f"WITH {_META} SELECT DISTINCT sample, group_label AS condition_name FROM obs",
    "exclude_regions": f"WITH RECURSIVE {TREE_SQL}, {_META} {_OBS_SQL} WHERE id NOT IN (SELECT region_id FROM walk WHERE ancestor_id = 907)",
    "include_regions": f"""WITH RECURSIVE {TREE_SQL}, {_META}, sib AS (SELECT region_id FROM tree WHERE parent_id = (SELECT parent_id FROM tree WHERE region_id = 182) AND region_id <> 182)
      {_OBS_SQL} WHERE id NOT IN (SELECT w.region_id FROM walk w JOIN sib ON sib.region_id = w.ancestor_id)""",
    "only_leafs": f"WITH RECURSIVE {TREE_SQL}, {_META} {_OBS_SQL} WHERE id NOT IN (SELECT region_id FROM tree WHERE NOT is_leaf)",
    "group_n": f"WITH {_META} SELECT channel, id, group_label, count(*) AS n_samples, round(avg(total_cells), 6) AS mean_value FROM obs GROUP BY ALL",
    "raw_wide": f"""WITH {_META}, grid AS (SELECT * FROM (SELECT DISTINCT channel, id FROM obs), (SELECT DISTINCT sample FROM obs))
      SELECT g.channel, g.id, g.sample || ':total_cells' AS label, CAST(o.total_cells AS DOUBLE) AS value FROM grid g LEFT JOIN obs o USING (channel, id, sample)""",
    "group_means_wide": f"""WITH {_META}, grid AS (SELECT * FROM (SELECT DISTINCT channel, id FROM obs), (SELECT DISTINCT group_label FROM obs)),
      made AS (SELECT g.channel, g.id, g.group_label, CAST(count(o.id) AS DOUBLE) AS n, round(avg(o.total_cells), 6) AS mean FROM grid g LEFT JOIN obs o USING (channel, id, group_label) GROUP BY ALL)
      SELECT channel, id, group_label || ':N' AS label, n AS value FROM made UNION ALL SELECT channel, id, group_label || ':total_cells', mean FROM made""",
    "stat_matrix": f"""WITH RECURSIVE {TREE_SQL}, {_META}, leaf AS (SELECT * FROM obs WHERE id NOT IN (SELECT region_id FROM tree WHERE NOT is_leaf)),
      grid AS (SELECT * FROM (SELECT DISTINCT channel, id FROM leaf), (SELECT DISTINCT sample FROM leaf))
      SELECT g.channel, g.id AS "RegionID", g.sample || ':total_cells' AS label, CAST(o.total_cells AS DOUBLE) AS value FROM grid g LEFT JOIN leaf o USING (channel, id, sample)""",
    "group_moments": f'WITH {_MOMENTS} SELECT channel, id, "group", n, round(mean, 6) AS mean, round(variance, 6) AS variance FROM moments',
    "level_pairs": f"WITH {_META}, lev AS ("
    + " UNION ".join(f"SELECT '{f}' AS factor, lower(coalesce({f}, '')) AS l FROM meta" for f in ("condition_name", "genotype", "sex"))
    + ") SELECT a.factor, a.l AS level_a, b.l AS level_b FROM lev a JOIN lev b ON a.factor = b.factor AND a.l < b.l",
    "deseq_size_factors": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_deseq(c)} SELECT {c} AS channel, sample, round(size_factor, 6) AS size_factor FROM sf)" for c in CHANNELS),
    "deseq_base_mean": " UNION ALL ".join(
        f"SELECT * FROM (WITH RECURSIVE {_deseq(c)} SELECT {c} AS channel, region_id, round(avg(n / size_factor), 6) AS base_mean FROM cnt JOIN sf USING (sample) GROUP BY region_id)" for c in CHANNELS
    ),
    "welch_t": f"WITH {_WELCH} SELECT channel, id, group_a, group_b, round(t, 6) AS t, round(df, 6) AS df FROM tests",
    "welch_p": f"WITH {_P} SELECT channel, id, group_a, group_b, round(p, 4) AS p FROM tested",
    "bh_fdr": f"WITH RECURSIVE {TREE_SQL}, {_BH} SELECT channel, id, group_a, group_b, p_corr FROM corrected",
    "analyzed_wide": f"""WITH RECURSIVE {TREE_SQL}, {_BH}, lines AS (SELECT DISTINCT channel, id FROM corrected), pair AS (SELECT DISTINCT group_a, group_b FROM corrected),
      made AS (SELECT l.channel, l.id, p.group_a || ' vs. ' || p.group_b AS pair, round(c.p, 4) AS p, c.p_corr FROM lines l CROSS JOIN pair p LEFT JOIN corrected c USING (channel, id, group_a, group_b))
      SELECT channel, id, 'p: ' || pair AS label, p AS value FROM made UNION ALL SELECT channel, id, 'p-corr: ' || pair, p_corr FROM made""",
}


def _curve_sql(m: str) -> str:
    """The inverse-gamma fit by the same trial locations; derivatives of log gamma are difference quotients, which Newton's steps correct."""
    digits = lambda c: f"CASE WHEN {c} = 0 THEN 0.0 ELSE CAST(printf('%.4e', {c}) AS DOUBLE) END"
    slope = "((lgamma(a * 1.00001) - lgamma(a * 0.99999)) / (a * 0.00002))"
    return f"""SELECT * FROM (WITH RECURSIVE {_values(m)}, span AS (SELECT min(v) AS low, max(v) AS high FROM val),
      bins AS (SELECT (least(floor((v - low) / (high - low) * 2048), 2047) + 0.5) / 2048 AS c, count(*) AS n FROM val, span GROUP BY 1),
      place AS (SELECT 0.5 / 2048 - 10 ** (-4 + 5.5 * k / 299) AS loc FROM (SELECT unnest(range(300)) AS k)),
      means AS (SELECT loc, sum(n / (c - loc)) / sum(n) AS mean, sum(n * -ln(c - loc)) / sum(n) AS mean_log FROM bins, place GROUP BY loc),
      walk AS (SELECT loc, mean, mean_log, ln(mean) - mean_log AS gap, (3 - (ln(mean) - mean_log) + sqrt((ln(mean) - mean_log - 3) ** 2 + 24 * (ln(mean) - mean_log))) / (12 * (ln(mean) - mean_log)) AS a, 0 AS i FROM means
        UNION ALL SELECT loc, mean, mean_log, gap, a * exp(ln((ln(a) - {slope}) / gap)), i + 1 FROM walk WHERE i < 40),
      fit AS (SELECT loc, a AS shape, a / mean AS scale FROM walk WHERE i = 40 ORDER BY a * ln(a / mean) - lgamma(a) + (a + 1) * mean_log - a DESC LIMIT 1),
      grid AS (SELECT low + g * (high - low) AS x, CASE WHEN g > loc THEN exp(shape * ln(scale) - lgamma(shape) - (shape + 1) * ln(g - loc) - scale / (g - loc)) ELSE 0 END AS density
        FROM (SELECT unnest(range(500)) / 499.0 AS g), span, fit)
      SELECT '{m}' AS measure, {digits("x")} AS x, {digits("density")} AS density FROM grid)"""


SQL["invgamma_pdf"] = " UNION ALL ".join(_curve_sql(m) for m in measures.MEASURES)


def _chain_sql(result: str) -> str:
    """Each stage as a table of its survivors; stage numbers are where a row falls out."""
    tests = []
    for i, text in enumerate(CHAIN, start=1):
        f = filters.parse_filter(text)
        limit = f"(SELECT quantile_cont({f.column}, {f.value / 100}) FROM s{i - 1})" if f.kind else f"{f.value}"
        tests.append(f"s{i} AS (SELECT * FROM s{i - 1} WHERE {_OK.format(f.column)} AND {f.column} {f.operator} {limit})")
    stage = "CASE " + " ".join(f"WHEN cell_ord NOT IN (SELECT cell_ord FROM s{i}) THEN {i}" for i in range(1, len(CHAIN) + 1)) + " END"
    return f"WITH {_CELLS}, s0 AS (SELECT * FROM cell), {', '.join(tests)} " + result.format(stage=stage, last=f"s{len(CHAIN)}")


SQL["filter_chain"] = _chain_sql("SELECT cell_ord FROM {last}")
SQL["filter_removed"] = _chain_sql("SELECT cell_ord, removed_stage FROM (SELECT cell_ord, {stage} AS removed_stage FROM s0) WHERE removed_stage IS NOT NULL")
