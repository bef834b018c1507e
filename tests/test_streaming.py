import datetime as dt

import pytest

from stratavox.streaming.arrivals import keep_region_counts, kept_region_counts, merge_batch, report_orphans, windowed_region_counts

CELLS = "cell_ord long, image_name string, region_id int, detected_at timestamp"


def test_counts_and_repeated_deliveries(spark, tmp_path):
    day = lambda d: dt.datetime(2031, 1, d, 5)
    rows = [(1, "a", 5, day(1)), (1, "a", 5, day(1)), (2, "a", 5, day(1)), (3, "a", None, day(2)), (4, "b", 5, day(2)), (5, "b", 5, None)]
    spark.createDataFrame(rows, CELLS).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CELLS).parquet(str(tmp_path / "in"))
    query = windowed_region_counts(stream).writeStream.format("memory").queryName("region_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["window_start"].day, r["image_name"], r["region_id"] or 0, r["n"]) for r in spark.table("region_counts").collect())
    assert got == [(1, "a", 5, 2), (2, "a", 0, 1), (2, "b", 5, 1)]


def test_orphans_of_batches(spark, tmp_path):
    schema = "ref_table string, ref_row long, ref_id int, loaded_at timestamp"
    at = dt.datetime(2031, 1, 1)
    spark.createDataFrame([("t", 1, 1, at), ("t", 2, 2, at)], schema).write.parquet(str(tmp_path / "in"))
    parents = spark.createDataFrame([(1, None, None)], "id int, added_at timestamp, retired_at timestamp")
    query = report_orphans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), parents, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert [(r["ref_row"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "missing")]


POINTS = "cell_ord long, image_name string, channel int, det_no int, region_id int, detected_at timestamp, loaded_at timestamp"


def test_kept_counts_of_late_and_corrected_points(spark, tmp_path):
    at = lambda m, d: dt.datetime(2031, m, d, 5)
    batches = [
        [(1, "a", 561, 1, 5, at(1, 1), at(1, 2)), (2, "a", 561, 2, 5, at(1, 1), at(1, 2)), (3, "a", 640, 1, 5, at(1, 1), at(1, 2)), (4, "b", 561, 1, None, at(1, 2), at(1, 2)), (5, None, 561, 1, 7, None, at(1, 2))],
        # far later: the same points again, unchanged, under another region, and in another window
        [(6, "a", 561, 1, 5, at(1, 1), at(6, 1)), (7, "a", 561, 2, 6, at(1, 1), at(6, 1)), (8, "a", 640, 1, 5, at(1, 3), at(6, 1)), (9, "c", 561, 1, 8, at(6, 1), at(6, 1))],
        # a point of the first day that was not seen before, a correction that is older than the current row, a row without time that takes a point out
        [(10, "a", 561, 3, 5, at(1, 1), at(6, 2)), (0, "a", 561, 2, 9, at(1, 1), at(1, 1)), (11, "c", 561, 1, 8, None, at(6, 2)), (12, "b", 561, 1, 4, at(1, 2), at(6, 2)), (12, "b", 561, 1, 4, at(1, 2), at(6, 2))],
    ]
    want = [
        [(1, 1, "a", 5, 3), (1, 2, "b", 0, 1)],
        [(1, 1, "a", 5, 1), (1, 1, "a", 6, 1), (1, 2, "b", 0, 1), (1, 3, "a", 5, 1), (6, 1, "c", 8, 1)],
        [(1, 1, "a", 5, 2), (1, 1, "a", 6, 1), (1, 2, "b", 4, 1), (1, 3, "a", 5, 1)],
    ]
    path = str(tmp_path / "kept")
    assert kept_region_counts(spark, path).count() == 0
    read = lambda: sorted((r["window_start"].month, r["window_start"].day, r["image_name"], r["region_id"] or 0, r["n"]) for r in kept_region_counts(spark, path).collect())
    for rows, counts in zip(batches, want):
        spark.createDataFrame(rows, POINTS).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(POINTS).parquet(str(tmp_path / "in"))
        keep_region_counts(stream, path, str(tmp_path / "cp")).awaitTermination()
        assert read() == counts
    last = spark.createDataFrame(batches[-1], POINTS)
    merge_batch(last, 2, path)  # the batch is repeated after a failure
    assert read() == want[-1]
    with pytest.raises(ValueError, match="another checkpoint"):
        merge_batch(last, 1, path)
