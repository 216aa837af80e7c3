"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (of values, before Spark's own overhead) up to which a checked table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 96 << 20
#: Most keys that ``spread_join`` broadcasts.
HEAVY_KEYS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of documents that is split into fewer parts than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, named by the cluster; a temporary one only for a local master (tests)."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _bytes_of(df: DataFrame) -> Column:
    """Size of a row's values."""
    out = F.lit(16)
    for f in df.schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            own = F.octet_length(c)
        elif isinstance(kind, T.ArrayType):
            own = F.octet_length(F.array_join(c, " ")) if isinstance(kind.elementType, T.StringType) else F.size(c) * 16
        else:
            own = F.lit(16)
        out = out + F.coalesce(own, F.lit(0))
    return out


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, which must be cheap to read, marked for broadcast if its values take at most ``most`` bytes."""
    size = df.agg(F.sum(_bytes_of(df).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def heavy_from(rows: int) -> int:
    """Rows of a key from which it counts as heavy: at most ``HEAVY_KEYS`` keys of ``rows`` rows can be."""
    return max(1000, rows // HEAVY_KEYS)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, heavy: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and in ``n`` the key's rows in ``left``.

    The few keys of more than ``heavy`` rows (see ``heavy_from``) are broadcast, so that no key's rows meet in one task.
    """
    often = F.broadcast(right.where(F.col(n) > heavy))
    rest = left.join(often, on, "left_anti").join(right.where(F.col(n) <= heavy), on, how)
    return left.join(often, on).unionByName(rest)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n


def class_sample(df: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, chosen by a hash of ``key``; all rows of smaller classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    share = F.lit(float(per_class)) / F.col("_n")
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(counts), label).where(place < share).drop("_n")


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(a: np.ndarray, b: np.ndarray, turn: int = 31) -> np.ndarray:
    """Hash of the ordered pair (a, b), elementwise."""
    r = (b << np.uint64(turn)) | (b >> np.uint64(64 - turn))
    x = a * _A + r * _B
    x ^= x >> np.uint64(29)
    return x * _C


def window_hashes(h: np.ndarray, length: int, turn: int = 31) -> np.ndarray:
    """Hash of every run of ``length`` consecutive elements, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while size <= length:
        if length & size:
            part = power[done : done + n]
            out = part if out is None else mixed(out, part, turn)
            done += size
        if size * 2 <= length:
            power = mixed(power[: len(power) - size], power[size:], turn)
        size *= 2
    return out


def run_prints(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each whole run: a polynomial in its values."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _A))
    out = np.add.reduceat((values[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xC2B2AE3D27D4EB4F)
