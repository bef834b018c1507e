"""Text files of the field: outlines, volumes, merge trees, metadata, summaries, and cell detections in XML or YAML.

Dictionaries (outline, volumes, merge tree, metadata) have a line per node or sample; they are read whole, keep their line order and
become DataFrames. Summaries and cells stay distributed.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Stash

#: Lines of a dictionary file; more are refused, as a dictionary passes through the driver.
DICTIONARY_LINES = 1_000_000


def _lines(spark: SparkSession, path: str) -> list[list[str]]:
    n = spark.read.text(path).count()
    if n > DICTIONARY_LINES:
        raise ValueError(f"{path} has {n} lines; a dictionary has at most {DICTIONARY_LINES}")
    text = spark.read.text(path, wholetext=True).first()
    rows = list(csv.reader(io.StringIO(text[0] if text else "", newline="")))
    return [[cell.strip() for cell in row] for row in rows if row]


def _column(header: list[str], name: str, path: str) -> int:
    if name not in header:
        raise ValueError(f"{path} has no column {name}")
    return header.index(name)


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """Outline CSV (ID, Abbreviation, RegionLevel_01 … to the end, is_leaf) as ord, id, abbreviation, regionlevel_NN, is_leaf."""
    header, *rows = _lines(spark, path)
    at = {c: _column(header, c, path) for c in ("ID", "Abbreviation", "RegionLevel_01", "is_leaf")}
    width = max([len(header), *map(len, rows)]) - at["RegionLevel_01"]
    levels = [f"regionlevel_{k + 1:02d}" for k in range(width)]
    data = []
    for i, row in enumerate(rows):
        names = row[at["RegionLevel_01"] :] + [""] * width
        data.append((i, int(row[at["ID"]]), row[at["Abbreviation"]], *names[:width], row[at["is_leaf"]]))
    schema = "ord int, id int, abbreviation string, " + "".join(f"{c} string, " for c in levels) + "is_leaf string"
    return spark.createDataFrame(data, schema)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Volumes CSV as region_id, aggregated_voxel_count, aggregated_volume_mm3, loaded_at (line number, so that the last of repeated lines counts)."""
    header, *rows = _lines(spark, path)
    a, b, c = (_column(header, n, path) for n in ("region_id", "aggregated_voxel_count", "aggregated_volume_mm3"))
    return spark.createDataFrame([(int(r[a]), int(r[b]), float(r[c]), i) for i, r in enumerate(rows)], "region_id int, aggregated_voxel_count long, aggregated_volume_mm3 double, loaded_at long")


def read_merge_tree(spark: SparkSession, path: str) -> DataFrame:
    """Merge CSV (ID, Abbreviation, Description, then any number of members) as id, abbreviation, description, member_ids, loaded_at (line number)."""
    header, *rows = _lines(spark, path)
    a, b, c = (_column(header, n, path) for n in ("ID", "Abbreviation", "Description"))
    start = max(a, b, c) + 1
    data = [(int(r[a]), r[b], r[c], [int(m) for m in r[start:] if m], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id int, abbreviation string, description string, member_ids array<int>, loaded_at long")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata CSV as text columns under their own names, cells stripped, in line order (sample_ord)."""
    header, *rows = _lines(spark, path)
    data = [(i, *(r + [""] * len(header))[: len(header)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType([T.StructField("sample_ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in header]]))


def find_summaries(spark: SparkSession, root: str, samples: list[str], channels: list[int], pattern: str) -> list[tuple[str, int, str]]:
    """(sample, channel, file) of the one file under ``root`` that matches ``pattern`` with {name} and {channel}; no file: left out; several: ValueError."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for sample in samples:
        if not sample:
            continue
        for channel in channels:
            statuses = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, pattern.format(name=sample, channel=channel))) or []
            files = [s.getPath().toString() for s in statuses]
            if len(files) > 1:
                raise ValueError(f"Several files for sample {sample}, channel {channel}: {files}")
            found += [(sample, channel, files[0])] if files else []
    return found


def read_summaries(spark: SparkSession, index: list[tuple[str, int, str]]) -> DataFrame:
    """All summaries of an index as sample, channel, summary_filename, row_ord and the files' own columns as text. ValueError when headers differ.

    A file is one sample's atlas, so each is read whole, by any task, and split into numbered lines there. Quoted line breaks are not supported.
    """
    if not index:
        raise ValueError("No summary was found")
    files = spark.createDataFrame(index, "sample string, channel int, summary_filename string")
    whole = spark.read.text([f for _, _, f in index], wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    lines = whole.select(bare("path").alias("path"), F.split(F.regexp_replace("value", "(\r?\n)+$", ""), "\r?\n").alias("lines"))
    headers = [r[0] for r in lines.select(F.col("lines")[0]).distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"Summaries have different headers: {headers}")
    names = next(csv.reader([headers[0]]))
    opened = lines.select("path", F.posexplode("lines").alias("row_ord", "line")).filter("row_ord > 0")
    parsed = opened.select("path", (F.col("row_ord") - 1).alias("row_ord"), F.from_csv("line", _ddl(names)).alias("r"))
    located = files.withColumn("path", bare("summary_filename"))
    return parsed.join(located, "path").select("sample", "channel", "summary_filename", "row_ord", "r.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n}` STRING" for n in names)


def read_cells_xml(spark: SparkSession, path: str, cells_only: bool = True, cell_type: int = 2) -> DataFrame:
    """Detections of marker files (Marker_Type with Type and Marker elements of MarkerX, MarkerY, MarkerZ) as cell_ord, z, y, x.

    ``cells_only`` keeps markers of ``cell_type``. cell_ord is unique and rises within a file.
    """
    position = T.StructType([T.StructField(f"Marker{a}", T.DoubleType()) for a in "XYZ"])
    schema = T.StructType([T.StructField("Type", T.IntegerType()), T.StructField("Marker", T.ArrayType(position))])
    groups = spark.read.format("xml").option("rowTag", "Marker_Type").schema(schema).load(path)
    kept = groups.filter(F.col("Type") == cell_type) if cells_only else groups
    return kept.select(F.explode("Marker").alias("m")).select(F.monotonically_increasing_id().alias("cell_ord"), F.col("m.MarkerZ").alias("z"), F.col("m.MarkerY").alias("y"), F.col("m.MarkerX").alias("x"))


#: Number of the marker type that stands for a cell.
CELL_TYPE = 2


def read_cells_yaml(spark: SparkSession, path: str, cells_only: bool = False, cell_type: int = CELL_TYPE) -> DataFrame:
    """Detections of YAML files (a list of mappings with z, y, x, type and a metadata mapping) as z, y, x, type, metadata (map). Needs PyYAML where tasks run.

    ``cells_only`` keeps detections of ``cell_type``.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            for content in pdf["content"]:
                cells = yaml.load(bytes(content), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or []
                yield pd.DataFrame(
                    [(float(c["z"]), float(c["y"]), float(c["x"]), int(c.get("type", CELL_TYPE)), {k: float(v) for k, v in (c.get("metadata") or {}).items()}) for c in cells],
                    columns=["z", "y", "x", "type", "metadata"],
                )

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "z double, y double, x double, type int, metadata map<string, double>")
    return found.filter(F.col("type") == cell_type) if cells_only else found


def read_cells(spark: SparkSession, path: str, cells_only: bool = True) -> DataFrame:
    """Cells of a Parquet table, marker XML or YAML, by the end of the name. Detections become cell_ord, z, y, x and a column per measure of their
    metadata (whole-number ids such as region_id as int), written once, since they are parsed row by row. ``cells_only`` leaves out other types of detections."""
    name = path.rstrip("/").lower()
    if name.endswith(".xml"):
        return Stash(read_cells_xml(spark, path, cells_only), "detections").df
    if not name.endswith((".yml", ".yaml")):
        return spark.read.parquet(path)
    found = Stash(read_cells_yaml(spark, path, cells_only), "detections").df
    measures = sorted(r[0] for r in found.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().collect())  # columns, a handful
    typed = lambda m: F.col("metadata")[m].cast("int" if m == "region_id" or m.startswith("region_id_") else "double").alias(m)
    return found.select(F.monotonically_increasing_id().alias("cell_ord"), "z", "y", "x", *[typed(m) for m in measures if m not in ("cell_ord", "z", "y", "x")])


def plain_path(path: str) -> str:
    """A local path without its scheme; other paths as they are."""
    return re.sub("^file:/+", "/", path)


def discover(spark: SparkSession, root: str, suffix: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Files below ``root`` whose name ends with ``suffix`` and matches none of the ``exclude`` patterns (as good*, bad*), in name order."""
    from fnmatch import fnmatch

    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    walk = base.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(base, True)
    found = []
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName().endswith(suffix) and not any(fnmatch(path.getName(), p) for p in exclude):
            found.append(path.toString())
    return sorted(found)


def without_outputs(spark: SparkSession, jobs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (input, output) jobs whose output does not exist yet, so that a repeated run does only what is missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def missing(output: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(output)
        return not path.getFileSystem(conf).exists(path)

    return [job for job in jobs if missing(job[1])]
