"""References to records that do not exist (problem 6).

Method: the distinct non-null foreign keys are anti-joined with the parent keys; the few suspect keys are joined back to the
referring rows for counts per table and period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stash
from .sized_join import sized_join


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan rows of ``refs`` with a ``reason``.

    refs: ref_table, ref_row, ref_id, loaded_at. parents: id, added_at, retired_at (either may be null: unlimited).
    Result: distinct ref_table, ref_row, ref_id, load_month (yyyy-MM, null when loaded_at is null), reason.

    * ``missing``: no parent has the id. ``early``: every parent row of the id is added after the reference was loaded.
      ``deleted``: otherwise, and none was still valid then (loaded at or after ``retired_at``).
    * A null ``ref_id`` is no reference. A null ``loaded_at`` can only be ``missing``.
    * Several parent rows of one id: the reference is good if any of them was valid at loading.
    * Repeated references give one row; empty tables give an empty result (all references are missing if there is no parent).

    Scale: keys are reduced to distinct ones by map-side aggregation before any shuffle, so a key that a third of all rows refer to
    costs one row per task. Distinct keys and suspect keys (missing, or with a limit in time) are written once, so the referring rows are
    read twice. Only suspects meet them again, by ``sized_join``: broadcast when their number is proven small, else a shuffle with salted hot keys.
    """
    keys = Stash(refs.select("ref_id").filter(F.col("ref_id").isNotNull()).distinct(), "keys").df
    held = parents.filter(F.col("id").isNotNull()).select(F.col("id").alias("ref_id"), "added_at", "retired_at")
    missing = keys.join(held.select("ref_id").distinct(), "ref_id", "left_anti")
    spans = held.groupBy("ref_id").agg(
        F.collect_set(F.struct("added_at", "retired_at")).alias("spans"),
        F.max(F.coalesce(F.col("added_at").isNotNull() | F.col("retired_at").isNotNull(), F.lit(False))).alias("limited"),
    )
    limited = keys.join(spans.filter("limited").drop("limited"), "ref_id")
    either = missing.withColumn("spans", F.lit(None).cast(limited.schema["spans"].dataType)).unionByName(limited)
    suspects = Stash(either, "suspects", {"n": F.count("*"), "most": F.max(F.size("spans"))})
    at = F.col("loaded_at")
    begun = lambda s: s["added_at"].isNull() | (s["added_at"] <= at)
    alive = lambda s: begun(s) & (s["retired_at"].isNull() | (at < s["retired_at"]))
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(at.isNull() | F.exists("spans", alive), None)
        .when(~F.exists("spans", begun), "early")
        .otherwise("deleted")
    )
    rows = refs.filter(F.col("ref_id").isNotNull()).select("ref_table", "ref_row", "ref_id", "loaded_at")
    found = sized_join(rows, suspects.df, ["ref_id"], row_bytes=24 * (suspects.seen["most"] or 0) + 16, rows=suspects.seen["n"]).withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return found.select("ref_table", "ref_row", "ref_id", F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "reason").distinct()


def orphan_report(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Counts per table, month and reason: orphan references, distinct rows and distinct ids."""
    return (
        orphan_references(refs, parents)
        .groupBy("ref_table", "load_month", "reason")
        .agg(F.count("*").alias("n_refs"), F.countDistinct("ref_row").alias("n_rows"), F.countDistinct("ref_id").alias("n_ids"))
    )


def atlas_references(cells: DataFrame, summaries: DataFrame, volumes: DataFrame, merge_tree: DataFrame) -> DataFrame:
    """All references to the outline as ref_table, ref_row, ref_id, loaded_at. Region 0 of cells and volumes is no reference."""

    def refs(df: DataFrame, name: str, row: str, ref: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(row).cast("long").alias("ref_row"), F.col(ref).cast("int").alias("ref_id"), "loaded_at")

    members = merge_tree.select("id", F.explode("member_ids").alias("member_id"), "loaded_at")
    return (
        refs(cells, "cells", "cell_ord", "region_id")
        .unionAll(refs(summaries, "summaries", "summary_row", "id"))
        .unionAll(refs(volumes, "region_volumes", "region_id", "region_id"))
        .unionAll(refs(members, "merge_tree", "id", "member_id"))
        .filter("ref_id <> 0")
    )
