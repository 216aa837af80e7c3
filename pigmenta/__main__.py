"""Text reports about photos: ``python -m pigmenta white|sample|sort PHOTO [X,Y,R ...] [--p3] [--white X,Y,Z] [--fallback X,Y,Z]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.functions.kernels import lab_hex
from pigmenta.operators.measure import measure_taps, measure_whites
from pigmenta.operators.segment import analyse_photos
from pigmenta.sources.photos import read_photos, read_ppm_photos


class Failure(Exception):
    """What stops a report, in words for the user."""


def triple(text: str) -> list[float]:
    """Three numbers between commas; parts that are no numbers are passed over."""
    found = []
    for part in text.split(","):
        try:
            found.append(float(part))
        except ValueError:
            continue
    if len(found) != 3:
        raise argparse.ArgumentTypeError(f"expected three comma-separated numbers, got {text}")
    return found


def shown(lab: list[float]) -> str:
    return f"L {lab[0]:5.1f}  a {lab[1]:6.1f}  b {lab[2]:6.1f}  {lab_hex(np.array(lab))}"


def _white(value: list[float] | None) -> Column:
    return F.lit(None).cast("array<double>") if value is None else F.array(*map(F.lit, value))


def _xyz(w: list[float]) -> str:
    return "white " + ",".join(f"{v:.4f}" for v in w)


def _yes(v: bool) -> str:
    return "true" if v else "false"


def report(spark: SparkSession, photo: DataFrame, command: str, spots: list[str], white: list[float] | None = None, fallback: list[float] | None = None) -> Iterator[str]:
    """Lines about one photo row."""
    broken = photo.where("error IS NOT NULL").select("error").head()
    if broken:
        raise Failure(broken.error)
    if command == "sort":
        got = analyse_photos(photo.withColumn("tapped", _white(white)).withColumn("fallback", _white(fallback))).head()
        if got is None or got.status != "ok":
            raise Failure("no beans found on a plain surface")
        yield f"{len(got.beans)} beans, {len(got.clumps)} clumps, suggested groups: {got.suggested}"
        yield f"sheet: {shown(got.sheet)}  white paper={_yes(got.white_paper)} calibrated={_yes(got.calibrated)}"
        for p in got.partitions:
            yield f"k={p.k}  counts {p.counts}  closest ΔE {'-' if p.separation is None else f'{p.separation:.1f}'}"
            if p.k == got.suggested:
                yield from (f"   group {g}: {shown(c)}" for g, c in enumerate(p.centroids))
        return
    auto = measure_whites(photo).head()
    if auto is None:
        raise Failure("no such photo")
    if command == "white":
        yield f"{_xyz(auto.white)}  found={_yes(auto.found)} clipped={_yes(auto.clipped)}"
        return
    yield f"{_xyz(white or auto.white)}" + ("  (given)" if white else f"  (automatic, found={_yes(auto.found)})")
    name = photo.select("photo_id").head()[0]
    taps = spark.createDataFrame([(i, name, *triple(s)) for i, s in enumerate(spots)], "id int, photo_id string, x double, y double, r double")
    seen = {r.id: r.lab for r in measure_taps(photo.withColumn("white", _white(white or auto.white)), taps).collect()}
    yield from (f"{s:<16} {shown(seen[i])}" if i in seen else f"{s}: outside the photo" for i, s in enumerate(spots))


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="pigmenta")
    parser.add_argument("command", choices=("white", "sample", "sort"))
    parser.add_argument("photo")
    parser.add_argument("spots", nargs="*", help="x,y,r")
    parser.add_argument("--p3", action="store_true", help="channels are Display P3")
    parser.add_argument("--white", type=triple)
    parser.add_argument("--fallback", type=triple)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    read = read_ppm_photos if a.photo.lower().endswith((".ppm", ".pnm")) else read_photos
    try:  # reading a path that isn't there fails at once
        for line in report(spark, read(spark, a.photo, "displayP3" if a.p3 else "sRGB"), a.command, a.spots, a.white, a.fallback):
            print(line)
    except (Failure, argparse.ArgumentTypeError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
