"""Outputs: cells, kept and removed rows, region tables, collated tables."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is written as one CSV file (regions, groups); larger tables are written by their tasks as a folder.
ONE_FILE_ROWS = 200_000

# The header texts of the exported tables.
FLAT_HEADER = ["ID", "Abbreviation", "Name", "Total voxels", "Total volume (mm3)", "Total cells", "Cell density (mm3)"]
LEVEL_HEADER = ["ID", "Abbreviation", "Leaf", "Parent ID", "Original ID", "Original abbreviation", "Total voxels", "Total volume (mm3)", "Total cells", "Cell density (mm3)"]


def _same_place(df: DataFrame, path: str) -> bool:
    plain = lambda p: re.sub("/+", "/", p.removeprefix("file:")).rstrip("/")
    own = plain(path)
    return any(plain(f) == own or plain(f).startswith(own + "/") for f in df.inputFiles())


def write_cells(df: DataFrame, path: str, mode: str = "errorifexists", order: list[str] | None = None) -> None:
    """Cells as Parquet, with ``order`` in ranges of these columns, sorted within and from part to part. Writing over the table that is being read is refused."""
    if _same_place(df, path):
        raise ValueError(f"{path} is being read; write the cells elsewhere")
    (df.orderBy(*order) if order else df).write.mode(mode).parquet(path)


def write_split(kept: DataFrame, removed: DataFrame, kept_path: str | None, removed_path: str | None, mode: str = "errorifexists") -> None:
    """Two optional outputs of one filter."""
    for df, path in ((kept, kept_path), (removed, removed_path)):
        if path:
            write_cells(df, path, mode)


def write_csv(df: DataFrame, path: str, header: list[str] | None = None, order: str | None = None) -> None:
    """A table as one CSV file: lines in ``order``, minimal quotes, CRLF ends, floating numbers in their shortest exact form, null as ''.

    The rows of one file are bounded (``ONE_FILE_ROWS``); more are refused, ``write_csv_parts`` is for those.
    """
    if df.limit(ONE_FILE_ROWS + 1).count() > ONE_FILE_ROWS:
        raise ValueError(f"More than {ONE_FILE_ROWS} rows for one file: {path}")
    held = df.orderBy(order).drop(order) if order else df
    rows = held.collect()
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(header or held.columns)
    writer.writerows(["" if v is None else repr(v) if isinstance(v, float) else v for v in row] for row in rows)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    stream.write(bytearray(out.getvalue().encode()))
    stream.close()


def write_csv_parts(df: DataFrame, path: str) -> bool:
    """A long table as a folder of CSV parts, written by the tasks. An empty table writes nothing; tells whether it wrote."""
    if not df.limit(1).count():
        return False
    df.write.mode("errorifexists").option("header", True).csv(path)
    return True


def write_flat(summary: DataFrame, path: str) -> None:
    """The flat region table (``region_summary`` or merged groups) in 7 columns."""
    key = "region_id" if "region_id" in summary.columns else "group_id"
    order = "ord" if "ord" in summary.columns else key
    table = summary.select(F.col(order).alias("__ord"), key, "acronym", "name", "volume_voxels", "volume_mm3", "n_cells", "cells_per_mm3")
    write_csv(table, path, FLAT_HEADER, "__ord")


def write_levels(layout: DataFrame, path: str) -> None:
    """The level layout (``level_layout``): 10 columns and one per tree level."""
    levels = [c for c in layout.columns if c.startswith("region_level_")]
    write_csv(layout, path, LEVEL_HEADER + [f"Region level {c[-2:]}" for c in levels], "ord")


def channel_path(path: str, channel: object, several: bool) -> str:
    """``path`` with {channel} filled in its file name; several channels need the placeholder."""
    folder, _, name = path.rpartition("/")
    if several and "{channel}" not in name:
        raise ValueError(f"Several channels would overwrite one another in {path}; put {{channel}} into the file name")
    name = name.format(channel=channel)
    return f"{folder}/{name}" if folder else name
