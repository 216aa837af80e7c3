"""Changes of a project's records as functions from DataFrames to DataFrames.

samples: id, kind, label, photo_id, tap_x, tap_y, available, created.
locks: flavor_key, paper_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flavor_key(label: str | Column) -> Column:
    """Any run of Unicode white space as one space, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))


def delete_photo(photos: DataFrame, samples: DataFrame, photo_id: str) -> tuple[DataFrame, DataFrame]:
    """The photo goes; its samples keep their colour but lose photo and tap."""
    own = F.col("photo_id").eqNullSafe(photo_id)
    blank = {c: F.when(~own, F.col(c)) for c in ("photo_id", "tap_x", "tap_y")}
    return photos.where(F.col("id") != photo_id), samples.withColumns(blank)


def set_available(samples: DataFrame, sample_id: str, available: bool) -> DataFrame:
    return samples.withColumn("available", F.when(F.col("id") == sample_id, F.lit(available)).otherwise(F.col("available")))


def delete_sample(samples: DataFrame, locks: DataFrame, sample_id: str) -> tuple[DataFrame, DataFrame]:
    """The sample goes, and locks on it."""
    return samples.where(F.col("id") != sample_id), locks.where(F.col("paper_id") != sample_id)


def rename(samples: DataFrame, locks: DataFrame, sample_id: str, label: str) -> tuple[DataFrame, DataFrame]:
    """New label; an empty one, or the present one, changes nothing.

    If the sample was the last with its flavour key, the key's lock moves to the new key, unless that has a lock already, which then stays.
    Sheets have no lock to move.
    """
    label = label.strip()
    if not label:
        return samples, locks
    new = samples.withColumn("label", F.when(F.col("id") == sample_id, F.lit(label)).otherwise(F.col("label")))
    beans = lambda df: df.where("kind <> 'paper'").select(flavor_key("label").alias("flavor_key")).distinct()
    fresh = flavor_key(F.lit(label))
    gone = beans(samples.where(F.col("id") == sample_id)).where(F.col("flavor_key") != fresh).join(beans(new), "flavor_key", "left_anti")
    moved = locks.join(gone, "flavor_key", "left_semi").select(fresh.alias("flavor_key"), "paper_id")
    moved = moved.join(locks.select("flavor_key"), "flavor_key", "left_anti").select("flavor_key", "paper_id")
    return new, locks.join(gone, "flavor_key", "left_anti").select("flavor_key", "paper_id").unionByName(moved)


def by_id(records: DataFrame, wanted: str | None, key: str = "id") -> DataFrame:
    """The record of an id: no row for an unknown or null one."""
    return records.where(F.col(key) == F.lit(wanted))


def partition_for(partitions: DataFrame, k: int, grp: int | None = None) -> DataFrame:
    """Rows (photo_id, k, grp, ...) of each photo's partition into ``k`` groups, or of its first one if it has none of that count; only group ``grp`` if given."""
    best = partitions.groupBy("photo_id").agg(F.coalesce(F.max(F.when(F.col("k") == k, F.lit(k))), F.min("k")).alias("k"))
    shown = partitions.join(best, ["photo_id", "k"], "left_semi")
    return shown if grp is None else shown.where(F.col("grp") == grp)


def set_lock(locks: DataFrame, flavor: str, paper_id: str | None) -> DataFrame:
    """Lock a flavour to a sheet, which any other flavour then loses; None unlocks."""
    rest = locks.where(F.col("flavor_key") != flavor)
    if paper_id is None:
        return rest
    one = locks.sparkSession.createDataFrame([(flavor, paper_id)], "flavor_key string, paper_id string")
    return rest.where(F.col("paper_id") != paper_id).select("flavor_key", "paper_id").union(one)


def next_number(samples: DataFrame, prefix: str) -> DataFrame:
    """One more than the largest number that follows ``prefix`` in a label; 1 if there is none."""
    rest = F.substr("label", F.lit(len(prefix) + 1))
    return samples.where(F.col("label").startswith(prefix)).agg((F.coalesce(F.max(rest.try_cast("int")), F.lit(0)) + 1).alias("n"))
