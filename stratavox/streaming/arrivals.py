"""Cells that keep arriving: counts per region and image over event-time windows, and orphan references as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import POINT_KEY, current_cells
from ..operators.orphans import orphan_references

#: Groups of images; a batch rewrites the groups of its images only. Fixed, as the written tables depend on it.
BUCKETS = 256


def windowed_region_counts(arriving: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """window_start, image_name, region_id, n of the rows of a stream by ``detected_at``; a row read twice (same cell_ord) counts once.

    A view of what is delivered in time, with bounded state: rows later than the watermark are dropped by Spark, and a point that is delivered
    again under a new cell_ord counts again. ``keep_region_counts`` counts the current rows of points, however late. Null detection times
    fall into no window. Aggregation is map-side first, so a region with a third of the cells costs one row per task and window.
    """
    timed = arriving.withColumn("detected_at", F.col("detected_at").cast("timestamp")).withWatermark("detected_at", late)
    once = timed.dropDuplicatesWithinWatermark(["cell_ord"])
    counted = once.groupBy(F.window("detected_at", window).alias("w"), "image_name", "region_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "image_name", "region_id", "n")


def keep_region_counts(arriving: DataFrame, path: str, checkpoint: str, window: str = "1 day"):
    """A running query that keeps the counts of current rows of points per window, image and region under ``path``; ``kept_region_counts`` reads them.

    arriving: cell_ord, image_name, channel, det_no, region_id, detected_at, loaded_at. Rows of any age count: there is no watermark, and a point
    delivered again, unchanged or corrected, counts once, where its current row (``current_cells``) lies, whatever the order of arrival. Null
    detection times fall into no window.

    ``points`` holds the current rows, ``counts`` their counts, both in groups of images. A point and its counts lie in the group of
    its image, so a batch merges with, recounts and writes the groups of its images only. A batch's folders carry its number and are made
    from those of earlier batches, so a repeated batch writes the same again. Superseded folders are deleted once the batch that replaced them is
    committed. ``path`` belongs to one ``checkpoint`` and one ``window``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, window)

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, number: int, path: str, window: str = "1 day") -> None:
    """One batch of ``keep_region_counts``."""
    spark = batch.sparkSession
    group = F.pmod(F.xxhash64("image_name"), F.lit(BUCKETS)).cast("int")
    rows = batch.select("cell_ord", *POINT_KEY, "region_id", F.col("detected_at").cast("timestamp").alias("detected_at"), "loaded_at")
    held = _latest_folders(spark, f"{path}/points", number)
    _latest_folders(spark, f"{path}/counts", number)
    touched = [r[0] for r in rows.select(group).distinct().collect()]
    known = [held[b] for b in touched if b in held]
    if known:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*known))
    _write_groups(current_cells(rows).withColumn("bucket", group), f"{path}/points/batch={number}")
    written = spark.read.schema(f"{rows._jdf.schema().toDDL()}, bucket int").parquet(f"{path}/points/batch={number}")
    timed = written.filter(F.col("detected_at").isNotNull()).groupBy("bucket", F.window("detected_at", window).alias("w"), "image_name", "region_id")
    counts = timed.agg(F.count("*").alias("n")).select("bucket", F.col("w.start").alias("window_start"), "image_name", "region_id", "n")
    # a group without counts is written as a row without a window, so that it replaces its earlier counts
    empty = spark.createDataFrame([(b,) for b in touched], "bucket int").join(counts.select("bucket").distinct(), "bucket", "left_anti")
    _write_groups(counts.unionByName(empty, allowMissingColumns=True), f"{path}/counts/batch={number}")


def kept_region_counts(spark: SparkSession, path: str) -> DataFrame:
    """window_start, image_name, region_id, n of the current rows of all points, as of the last whole batch of ``keep_region_counts``."""
    folders = list(_folders(spark, f"{path}/counts", whole=True).values())
    latest = [versions[max(versions)] for versions in folders]
    shape = "window_start timestamp, image_name string, region_id int, n long"
    read = spark.read.schema(shape).parquet(*latest) if latest else spark.createDataFrame([], shape)
    return read.filter(F.col("window_start").isNotNull())


def _write_groups(df: DataFrame, folder: str) -> None:
    df.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)


def _folders(spark: SparkSession, folder: str, whole: bool = False) -> dict[int, dict[int, str]]:
    """Per group of images: batch number and folder of what batches have written; ``whole``: only batches whose writing has ended."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    glob = lambda pattern: [s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base, pattern)) or []]
    number = lambda p: int(p.getName().partition("=")[2])
    ended = {number(p.getParent()) for p in glob("batch=*/_SUCCESS")} if whole else None
    found: dict[int, dict[int, str]] = {}
    for p in glob("batch=*/bucket=*"):
        batch = number(p.getParent())
        if ended is None or batch in ended:
            found.setdefault(number(p), {})[batch] = p.toString()
    return found


def _latest_folders(spark: SparkSession, folder: str, number: int) -> dict[int, str]:
    """Per group of images the folder of the last batch before ``number``; earlier ones, which nothing needs once batch ``number`` begins, are deleted."""
    latest = {}
    for bucket, versions in _folders(spark, folder).items():
        if max(versions) > number:
            raise ValueError(f"{folder} holds batch {max(versions)}, which is later than batch {number}; it belongs to another checkpoint")
        before = sorted(v for v in versions if v < number)
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(versions[old])
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        if before:
            latest[bucket] = versions[before[-1]]
    return latest


def report_orphans(arriving: DataFrame, parents: DataFrame, path: str, checkpoint: str):
    """A running query that appends the orphan references of every micro-batch of ``arriving`` (ref_table, ref_row, ref_id, loaded_at) to ``path``.

    A batch's folder carries its number and is written anew when the batch is repeated, so each reference is reported once per batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        orphan_references(batch, parents).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
