"""Queries of the general problems (2, 3, 4, 6) over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atlas import outline_tree
from ..operators.latest import current_cells
from ..operators.links import descendants, hierarchies, latest_links
from ..operators.orphans import atlas_references, orphan_references, orphan_report
from ..operators.skew import hot_keys, key_counts, ordered_profile
from ..operators.spatial import near_pairs, regions_of_points
from ..sources.tables import table
from .reference import TREE_SQL

NEAR = 0.75
HOT_PERMILLE = 40

_POSITION = ("cell_ord", "image_name", "channel", "det_no", "loaded_at", "z", "y", "x")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "cells", *_POSITION)
    pairs = near_pairs(current_cells(raw), "cell_ord", "image_name", NEAR, fit_on=raw)
    return pairs.select(F.col("id_a").alias("cell_ord_a"), F.col("id_b").alias("cell_ord_b"))


def p2_regions(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "cells", *_POSITION)
    return regions_of_points(current_cells(raw), "cell_ord", table(spark, folder, "annotation"), fit_on=raw).select(F.col("id").alias("cell_ord"), F.col("voxel_region").alias("region_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_keys(table(spark, folder, "cells", "region_id"), "region_id", HOT_PERMILLE).select("region_id")


def p3_region_counts(spark: SparkSession, folder: str) -> DataFrame:
    return key_counts(table(spark, folder, "cells", "region_id"), "region_id").select("region_id", "n_rows")


def p3_region_profile(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "cells", "region_id", "cell_ord", "center_intensity", "image_name")
    profile = ordered_profile(cells, "region_id", ["cell_ord"], "center_intensity", "image_name")
    return profile.withColumn("total", F.round("total", 2))


def _atlas_forests(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchies(latest_links(table(spark, folder, "atlas_nodes")), "atlas_name", "id", "parent_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _atlas_forests(spark, folder).filter("state = 'cycle'").select(F.col("scope").alias("atlas_name"), F.col("id").cast("int").alias("id"))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    solved = _atlas_forests(spark, folder)
    return solved.select(
        F.col("scope").alias("atlas_name"), F.col("id").cast("int").alias("id"), "state", F.col("root_id").cast("int").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path")
    )


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    pairs = descendants(_atlas_forests(spark, folder)).filter("distance > 0")
    return pairs.select(F.col("scope").alias("atlas_name"), F.col("ancestor_id").cast("int").alias("ancestor_id"), F.col("id").cast("int").alias("id"), F.col("distance").cast("int").alias("distance"))


def p4_outline(spark: SparkSession, folder: str) -> DataFrame:
    tree = outline_tree(table(spark, folder, "atlas_outline")).withColumn("atlas", F.lit("outline"))
    solved = hierarchies(tree, "atlas", "region_id", "parent_id")
    return solved.select(F.col("id").cast("int").alias("id"), F.col("root_id").cast("int").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"))


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    refs = atlas_references(
        table(spark, folder, "cells", "cell_ord", "region_id", "loaded_at"), table(spark, folder, "summaries", "summary_row", "id", "loaded_at"),
        table(spark, folder, "region_volumes", "region_id", "loaded_at"), table(spark, folder, "merge_tree", "id", "member_ids", "loaded_at"),
    )
    return refs, table(spark, folder, "atlas_outline", "id", "added_at", "retired_at")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*_references(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(*_references(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_regions, p3_found, p3_region_counts, p3_region_profile, p4_found, p4_paths, p4_descendants, p4_outline, p6_found, p6_report)}

#: DuckDB may answer isnan() from Parquet statistics, which leave NaN out; the SQL compares the text instead.
_CURRENT = """current_cells AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name, channel, det_no
  ORDER BY loaded_at DESC NULLS LAST, cell_ord DESC) AS rn FROM cells) WHERE rn = 1)"""

_LINKS = """valid AS (SELECT DISTINCT atlas_name, id, min(parent_id) AS parent_id FROM atlas_nodes n WHERE id IS NOT NULL AND revised_at =
    (SELECT max(revised_at) FROM atlas_nodes m WHERE m.atlas_name = n.atlas_name AND m.id = n.id) GROUP BY atlas_name, id),
  link AS (SELECT v.atlas_name, v.id, p.id AS parent_id FROM valid v LEFT JOIN valid p ON p.atlas_name = v.atlas_name AND p.id = v.parent_id AND v.parent_id <> -1),
  walk AS (SELECT atlas_name, id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path, [id] AS up FROM link WHERE parent_id IS NULL
    UNION ALL SELECT l.atlas_name, l.id, w.root_id, w.depth + 1, w.path || '/' || l.id, list_append(w.up, l.id)
    FROM walk w JOIN link l ON l.atlas_name = w.atlas_name AND l.parent_id = w.id)"""

_REFS = """refs AS (SELECT 'cells' AS ref_table, cell_ord AS ref_row, region_id AS ref_id, loaded_at FROM cells
    UNION ALL SELECT 'summaries', summary_row, id, loaded_at FROM summaries
    UNION ALL SELECT 'region_volumes', region_id, region_id, loaded_at FROM region_volumes
    UNION ALL SELECT 'merge_tree', id, unnest(member_ids), loaded_at FROM merge_tree),
  found AS (SELECT DISTINCT r.ref_table, CAST(r.ref_row AS BIGINT) AS ref_row, r.ref_id, strftime(r.loaded_at, '%Y-%m') AS load_month,
    CASE WHEN o.id IS NULL THEN 'missing' WHEN r.loaded_at < o.added_at THEN 'early' ELSE 'deleted' END AS reason
    FROM refs r LEFT JOIN atlas_outline o ON o.id = r.ref_id
    WHERE r.ref_id <> 0 AND (o.id IS NULL OR r.loaded_at < o.added_at OR r.loaded_at >= o.retired_at))"""

SQL = {
    "p2_found": f"""WITH {_CURRENT}, known AS (SELECT cell_ord, image_name, z, y, x, CAST(floor(z) AS INT) AS bz, CAST(floor(y) AS INT) AS by_, CAST(floor(x) AS INT) AS bx
        FROM current_cells WHERE NOT coalesce(CAST(z AS VARCHAR) = 'nan', false) AND NOT coalesce(CAST(y AS VARCHAR) = 'nan', false) AND NOT coalesce(CAST(x AS VARCHAR) = 'nan', false)),
      steps AS (SELECT unnest([-1, 0, 1]) AS s),
      spread AS (SELECT k.cell_ord, k.image_name, k.z, k.y, k.x, k.bz + a.s AS bz, k.by_ + b.s AS by_, k.bx + c.s AS bx FROM known k, steps a, steps b, steps c)
      SELECT k.cell_ord AS cell_ord_a, s.cell_ord AS cell_ord_b FROM known k JOIN spread s USING (image_name, bz, by_, bx)
      WHERE k.cell_ord < s.cell_ord AND (k.z - s.z) ** 2 + (k.y - s.y) ** 2 + (k.x - s.x) ** 2 <= 0.5625""",
    "p2_regions": f"""WITH {_CURRENT} SELECT c.cell_ord, CAST(CASE WHEN c.z IS NULL OR c.y IS NULL OR c.x IS NULL OR coalesce(CAST(c.z AS VARCHAR) = 'nan', false) OR coalesce(CAST(c.y AS VARCHAR) = 'nan', false) OR coalesce(CAST(c.x AS VARCHAR) = 'nan', false) THEN NULL
        WHEN round_even(c.x, 0) < 0 THEN 0 ELSE coalesce(a.labels[TRY_CAST(round_even(c.x, 0) AS INT) + 1], 0) END AS INT) AS region_id
      FROM current_cells c LEFT JOIN annotation a ON a.z = CASE WHEN coalesce(CAST(c.z AS VARCHAR) = 'nan', false) THEN NULL ELSE TRY_CAST(round_even(c.z, 0) AS INT) END
        AND a.y = CASE WHEN coalesce(CAST(c.y AS VARCHAR) = 'nan', false) THEN NULL ELSE TRY_CAST(round_even(c.y, 0) AS INT) END""",
    "p3_found": "SELECT region_id FROM cells WHERE region_id IS NOT NULL GROUP BY region_id HAVING count(*) * 25 >= (SELECT count(*) FROM cells)",
    "p3_region_counts": "SELECT region_id, count(*) AS n_rows FROM cells GROUP BY region_id",
    "p3_region_profile": """WITH good AS (SELECT region_id, cell_ord, image_name, CASE WHEN coalesce(CAST(center_intensity AS VARCHAR) = 'nan', false) THEN NULL ELSE center_intensity END AS v FROM cells),
      stepped AS (SELECT *, last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
        row_number() OVER w AS rn, lag(image_name) OVER w AS pl FROM good WINDOW w AS (PARTITION BY region_id ORDER BY cell_ord))
      SELECT region_id, count(*) AS n_rows, count(v) AS n_values, round(sum(v), 2) AS total, arg_min(v, cell_ord) AS first_value, arg_max(v, cell_ord) AS last_value,
        count(*) FILTER (v IS NOT NULL AND p IS NOT NULL) AS n_steps, count(*) FILTER (v > p) AS n_rises,
        count(*) FILTER (rn = 1 OR pl IS DISTINCT FROM image_name) AS n_runs FROM stepped GROUP BY region_id""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT v.atlas_name, v.id FROM valid v ANTI JOIN walk w ON w.atlas_name = v.atlas_name AND w.id = v.id",
    "p4_paths": f"""WITH RECURSIVE {_LINKS} SELECT v.atlas_name, v.id, CASE WHEN w.id IS NULL THEN 'cycle' ELSE 'root' END AS state, w.root_id, w.depth, w.path
      FROM valid v LEFT JOIN walk w ON w.atlas_name = v.atlas_name AND w.id = v.id""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}, opened AS (SELECT atlas_name, id, depth, unnest(up) AS ancestor_id, generate_subscripts(up, 1) - 1 AS place FROM walk)
      SELECT atlas_name, ancestor_id, id, CAST(depth - place AS INT) AS distance FROM opened WHERE depth > place""",
    "p4_outline": f"WITH RECURSIVE {TREE_SQL} SELECT region_id AS id, 1 AS root_id, CAST(depth AS INT) AS depth, path FROM tree",
    "p6_found": f"WITH {_REFS} SELECT * FROM found",
    "p6_report": f"WITH {_REFS} SELECT ref_table, load_month, reason, count(*) AS n_refs, count(DISTINCT ref_row) AS n_rows, count(DISTINCT ref_id) AS n_ids FROM found GROUP BY ALL",
}
