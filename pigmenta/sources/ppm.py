"""Binary PPM (P6, 8-bit) photos as rows, and saved projects as JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = re.compile(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", re.DOTALL)


def decode_ppm(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and height x width x 3 channels."""
    m = HEADER.match(data)
    if not m or int(m[3]) != 255:
        raise ValueError("not an 8-bit binary PPM")
    w, h = int(m[1]), int(m[2])
    if len(data) - m.end() < w * h * 3:
        raise ValueError("truncated")
    return w, h, np.frombuffer(data, np.uint8, w * h * 3, m.end()).reshape(h, w, 3)


PIXELS = "path string, error string, y int, x int, r int, g int, b int"


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """A row for each pixel of the PPM files at ``path``; an unreadable file gives one row with ``error``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PIXELS.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5]
        for b in it:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    w, h, rgb = decode_ppm(content.as_py())
                except ValueError as e:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, str(e), *[None] * 5), kinds, strict=True)], names)
                    continue
                for y in range(0, h, 64):
                    rows, cols = np.mgrid[y : min(y + 64, h), 0:w]
                    part = rgb[y : y + 64].reshape(-1, 3).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.nulls(len(part), pa.string()), pa.array(rows.ravel().astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), *(pa.array(part[:, c].copy()) for c in range(3))], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, PIXELS)


PROJECT = """version int, photos array<struct<id:string,created:double,width:int,height:int,white:array<double>,whiteAt:array<double>,whiteClipped:boolean,whiteBasis:string>>,
samples array<struct<id:string,kind:string,label:string,photoID:string,tap:struct<x:double,y:double,r:double>,lab:array<double>,available:boolean,created:double>>,
locks map<string,string>, _broken string"""


def read_projects(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved projects, one to a file or, as ``write_projects`` saves them, one to a line; one that can't be read keeps its text in ``_broken``, and the file is left as it is."""
    return spark.read.schema(PROJECT).json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").withColumn("path", F.input_file_name())


def split_projects(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects that were read, and (path, text) of files to be kept aside: no JSON, or (text null) JSON that lacks the version, photos, samples or locks."""
    sound = F.expr("_broken IS NULL AND version IS NOT NULL AND photos IS NOT NULL AND samples IS NOT NULL AND locks IS NOT NULL")
    return projects.where(sound).drop("_broken"), projects.where(~sound).select("path", F.col("_broken").alias("text"))


def write_projects(projects: DataFrame, path: str) -> None:
    """Save projects as JSON, one to a line, in a new folder; readers find all of it or nothing, as its files are moved there when the job commits.

    Projects must be those of ``split_projects``: what could not be read is not saved as an empty project.
    """
    projects.drop("path").write.mode("errorifexists").json(path)
