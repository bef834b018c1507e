"""Label volumes as a Spark data source: chunked array folders, the same in a zip file, and stacks of image slices.

    spark.dataSource.register(LabelVolume)
    spark.read.format("label_volume").option("path", "atlas.zarr").option("item", "data").load()

Rows are z, y, labels: one image row each. A partition is one layer of chunks along z (or one image file), so tasks decode only their own
part, and a filter on z leaves the other layers unread.
"""

from __future__ import annotations

import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

IMAGES = (".tif", ".tiff")


class _Folder:
    """Files of a folder, or of a zip file, by relative name."""

    def __init__(self, path: str):
        self.path, self.zip = path, zipfile.ZipFile(path) if path.endswith(".zip") else None

    def read(self, name: str) -> bytes | None:
        if self.zip is None:
            p = Path(self.path, name)
            return p.read_bytes() if p.exists() else None
        return self.zip.read(name) if name in self.zip.NameToInfo else None


def _decoded(data: bytes, codec: str | None) -> bytes:
    if codec in (None, "bytes"):
        return data
    if codec in ("zlib", "gzip"):
        return zlib.decompress(data, wbits=47)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"Unknown compression: {codec}")


class _Array:
    """A chunked 3-D array, by its description (format 2 or 3)."""

    def __init__(self, folder: _Folder, item: str):
        self.folder, self.item = folder, item.strip("/")
        prefix = f"{self.item}/" if self.item else ""
        if (old := folder.read(f"{prefix}.zarray")) is not None:
            d = json.loads(old)
            self.shape, self.chunks, self.dtype, self.fill = d["shape"], d["chunks"], np.dtype(d["dtype"]), d["fill_value"] or 0
            self.codec = (d.get("compressor") or {}).get("id")
            sep = d.get("dimension_separator", ".")
            self.name = lambda at: prefix + sep.join(map(str, at))
            if d.get("order", "C") != "C" or d.get("filters"):
                raise ValueError("Only plain arrays in C order are read")
        elif (new := folder.read(f"{prefix}zarr.json")) is not None:
            d = json.loads(new)
            self.shape, self.chunks, self.dtype, self.fill = d["shape"], d["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(d["data_type"]), d["fill_value"] or 0
            codecs = [c["name"] for c in d["codecs"]]
            endian = next((c.get("configuration", {}).get("endian", "little") for c in d["codecs"] if c["name"] == "bytes"), "little")
            self.dtype = self.dtype.newbyteorder("<" if endian == "little" else ">")
            self.codec = next((c for c in codecs if c not in ("bytes", "crc32c")), None)
            sep = d.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
            self.name = lambda at: prefix + sep.join(["c", *map(str, at)])
        else:
            raise ValueError(f"No array {item!r} in {folder.path}")
        if len(self.shape) != 3:
            raise ValueError(f"A label volume has three dimensions, not {len(self.shape)}")

    def layer(self, k: int) -> np.ndarray:
        depth, height, width = self.chunks
        out = np.full((min(depth, self.shape[0] - k * depth), self.shape[1], self.shape[2]), self.fill, dtype=self.dtype)
        for i in range(-(-self.shape[1] // height)):
            for j in range(-(-self.shape[2] // width)):
                data = self.folder.read(self.name((k, i, j)))
                if data is not None:
                    chunk = np.frombuffer(_decoded(data, self.codec), self.dtype).reshape(self.chunks)
                    part = out[:, i * height : (i + 1) * height, j * width : (j + 1) * width]
                    part[:] = chunk[: part.shape[0], : part.shape[1], : part.shape[2]]
        return out


# The TIFF tags and field sizes that are needed.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _STRIP_ROWS, _COUNTS, _SAMPLE_FORMAT = 256, 257, 258, 259, 273, 278, 279, 339
_FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}


def read_pages(path: str) -> Iterator[np.ndarray]:
    """Pages of a grey-scale TIFF file in strips, uncompressed or deflated."""
    data = Path(path).read_bytes()
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError(f"{path} is not a plain TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        tags = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _FIELD:
                size = struct.calcsize(_FIELD[kind]) * count
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{_FIELD[kind]}", data, where)
        packed = tags.get(_COMPRESSION, (1,))[0]
        if packed not in (1, 8, 32946):
            raise ValueError(f"{path}: compression {packed} is not read")
        strips = [data[o : o + c] for o, c in zip(tags[_OFFSETS], tags[_COUNTS])]
        raw = b"".join(s if packed == 1 else zlib.decompress(s) for s in strips)
        letter = {1: "u", 2: "i", 3: "f"}[tags.get(_SAMPLE_FORMAT, (1,))[0]]
        yield np.frombuffer(raw, np.dtype(f"{order}{letter}{tags[_BITS][0] // 8}")).reshape(tags[_HEIGHT][0], tags[_WIDTH][0])
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


class Layer(InputPartition):
    def __init__(self, k: int, first: int, last: int, path: str):
        self.k, self.first, self.last, self.path = k, first, last, path


class LabelVolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.item = options["path"], options.get("item", "data")
        self.low, self.high = -(1 << 60), 1 << 60

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of z narrow the layers that are read; Spark still tests the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Layer]:
        chunked = self.path.rstrip("/").endswith((".zarr", ".zarr.zip"))
        if chunked:
            array = _Array(_Folder(self.path), self.item)
            depth = array.chunks[0]
            every = [Layer(k, k * depth, min((k + 1) * depth, array.shape[0]) - 1, self.path) for k in range(-(-array.shape[0] // depth))]
        elif os.path.isdir(self.path):
            files = sorted(p for p in Path(self.path).iterdir() if p.suffix.lower() in IMAGES)
            every = [Layer(-1, i, i, str(p)) for i, p in enumerate(files)]
        else:
            every = [Layer(-2, 0, 1 << 60, self.path)]
        return [p for p in every if p.last >= self.low and p.first <= self.high] or [Layer(-3, 0, 0, self.path)]

    def read(self, partition: Layer) -> Iterator[pa.RecordBatch]:
        """One Arrow batch a page; labels stay numbers in one buffer."""
        if partition.k == -3:
            return
        pages = _Array(_Folder(self.path), self.item).layer(partition.k) if partition.k >= 0 else read_pages(partition.path)
        for dz, page in enumerate(pages):
            height, width = page.shape
            labels = pa.ListArray.from_arrays(pa.array(np.arange(height + 1, dtype=np.int32) * width), pa.array(page.astype(np.int32).ravel()))
            columns = [pa.array(np.full(height, partition.first + dz, dtype=np.int32)), pa.array(np.arange(height, dtype=np.int32)), labels]
            yield pa.RecordBatch.from_arrays(columns, names=["z", "y", "labels"])


class LabelVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_volume"

    def schema(self) -> str:
        return "z int, y int, labels array<int>"

    def reader(self, schema) -> LabelVolumeReader:
        return LabelVolumeReader(self.options)


def read_label_volume(spark, path: str, item: str = "data"):
    """z, y, labels of a volume: a ``.zarr`` folder, a ``.zarr.zip`` file, a folder of image slices in name order, or one multi-page image."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelVolume)
    return spark.read.format("label_volume").option("path", path).option("item", item).load()
