"""The data source ``ppm``: binary PPM photos as rows, one file to a partition, scaled while they are read.

``spark.dataSource.register(PpmSource)``, then ``spark.read.format("ppm").option("maxSide", 1600).load(path)``; path is a file, a folder, or a
pattern of the last part, in any file system that Arrow opens. Options: ``maxSide`` (long edge, 1600), ``space`` (sRGB). Columns that a schema
given to the reader leaves out aren't made: without ``rgb`` only the head of a file is read.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pigmenta.sources.photos import BAND, LONG_EDGE, PHOTO, Scaler
from pigmenta.sources.ppm import HEADER

_HEAD = 4096


def read_head(file: BinaryIO) -> tuple[int, int, bytes]:
    """Width, height, and what was read behind the head."""
    data = file.read(_HEAD)
    m = HEADER.match(data)
    if not m or int(m[3]) != 255:
        raise ValueError("not an 8-bit binary PPM")
    return int(m[1]), int(m[2]), data[m.end() :]


def read_scaled(file: BinaryIO, most: int) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a photo that is scaled while it is read, a band of rows at a time."""
    w, h, rest = read_head(file)
    scaler = Scaler(w, h, most)
    for y in range(0, h, BAND):
        size = min(BAND, h - y) * w * 3
        band = rest[:size]
        rest = rest[size:]
        if len(band) < size:
            band += file.read(size - len(band))
        if len(band) < size:
            raise ValueError("truncated")
        scaler.feed(np.frombuffer(band, np.uint8).reshape(-1, w, 3))
    return scaler.width, scaler.height, scaler.result()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.most, self.space = options["path"], int(options.get("maxside", LONG_EDGE)), options.get("space", "sRGB")
        self.schema = schema

    def partitions(self) -> list[_File]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        folder, _, pattern = path.rpartition("/") if re.search(r"[*?[]", path) else (path, "", "*")
        info = system.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [_File(path)]
        found = system.get_file_info(fs.FileSelector(folder))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        row: dict[str, Any] = {"photo_id": partition.path, "space": self.space}
        with system.open_input_file(partition.path) as file:
            try:
                if "rgb" in self.schema.names:
                    row["width"], row["height"], rgb = read_scaled(file, self.most)
                    row["rgb"] = rgb.tobytes()
                else:
                    w, h, _ = read_head(file)
                    scaler = Scaler(w, h, self.most)
                    row["width"], row["height"] = scaler.width, scaler.height
            except ValueError as e:
                row["error"] = str(e)
        yield pa.RecordBatch.from_pylist([{c: row.get(c) for c in self.schema.names}], schema=to_arrow_schema(self.schema))


class PpmSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "ppm"

    def schema(self) -> str:
        return PHOTO

    def reader(self, schema: StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema)
