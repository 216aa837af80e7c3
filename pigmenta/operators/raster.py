"""Connected components of a mask, and the nearest site of every cell, on frames of any size.

Components are labelled tile by tile, one tile to a task; a graph of the tiles' components that touch across a border says which are
one. For the nearest site, windows over columns find the nearest one above and below, and each row then takes the lower envelope of the
parabolas over its columns, one row of cells to a call. ``label`` and ``nearest_site`` do the same on the arrays of a photo that is
in memory already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.operators.tables import checkpointed

#: Cells of a tile's side.
TILE = 1024


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1 in raster order of each component's first cell, 0 outside; runs of rows joined by union-find."""
    h, w = mask.shape
    up: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    above: list[int] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        own = []
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            up.append(k)
            own.append(k)
            for j in above:
                if runs[j][1] < b + diagonal and a < runs[j][2] + diagonal:
                    x, z = sorted((root(j), root(k)))
                    up[z] = x
        above = own
    out, names = np.zeros((h, w), np.int32), {}
    for k, (y, a, b) in enumerate(runs):
        out[y, a:b] = names.setdefault(root(k), len(names) + 1)
    return out


LABELS = "photo_id long, y int, x int, label int"


def _in_tiles(cells: DataFrame, diagonal: bool, tile: int) -> DataFrame:
    """Cells with the first cell (in raster order, as one number) of their component within the tile, and its label there."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        mask = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        names = label(mask, diagonal)
        place = names[y - y.min(), x - x.min()]
        first = np.full(place.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, place, y << 32 | x)
        return pdf.assign(node=first[place], label=place)[["photo_id", "y", "x", "node", "label"]]

    tiled = cells.select("photo_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    return tiled.groupBy("photo_id", "ty", "tx").applyInPandas(one, "photo_id long, y int, x int, node long, label int")


def _touching(nodes: DataFrame, diagonal: bool, tile: int) -> DataFrame:
    """Pairs (photo_id, a, b) of components of different tiles that hold neighbouring cells."""
    steps = [(-1, 0), (0, -1), *([(-1, -1), (-1, 1)] if diagonal else [])]
    edge = nodes.where(f"y % {tile} IN (0, {tile - 1}) OR x % {tile} IN (0, {tile - 1})")
    moved = edge.select("photo_id", F.col("node").alias("a"), F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("at")).select("photo_id", "a", "at.y", "at.x")
    return moved.join(edge, ["photo_id", "y", "x"]).where("a <> node").select("photo_id", "a", F.col("node").alias("b")).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(photo_id, node, root) of every node of a graph: the least node it is linked with, by rounds of taking neighbours' roots and roots' roots."""
    both = checkpointed(edges.unionByName(edges.select("photo_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = checkpointed(both.select("photo_id", F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(state.select("photo_id", F.col("node").alias("b"), F.col("root").alias("seen")), ["photo_id", "b"]).groupBy("photo_id", "a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "node")
        met = state.join(near, ["photo_id", "node"])
        offers = met.select("photo_id", "node", "seen").unionByName(met.select("photo_id", F.col("root").alias("node"), "seen")).groupBy("photo_id", "node").agg(F.min("seen").alias("seen"))
        lower = state.join(offers, ["photo_id", "node"], "left").select("photo_id", "node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = lower.select("photo_id", F.col("node").alias("root"), F.col("root").alias("next"))
        new = checkpointed(lower.join(jump, ["photo_id", "root"], "left").select("photo_id", "node", "old", F.coalesce("next", "root").alias("root")))
        state = new.select("photo_id", "node", "root")
        if new.where("root <> old").isEmpty():
            return state


def components(cells: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(photo_id, y, x) of the cells in a mask, to their component (see ``LABELS``), numbered from 1 in raster order of its first cell."""
    nodes = _in_tiles(cells, diagonal, tile)
    if cells.where(f"y >= {tile} OR x >= {tile}").isEmpty():  # every frame is one tile
        return nodes.select("photo_id", "y", "x", "label")
    nodes = checkpointed(nodes.drop("label"))
    roots = _roots(_touching(nodes, diagonal, tile))
    nodes = nodes.join(roots, ["photo_id", "node"], "left").select("photo_id", "y", "x", F.coalesce("root", "node").alias("node"))
    names = nodes.groupBy("photo_id", "node").agg(F.lit(1).alias("one")).select("photo_id", "node", F.row_number().over(Window.partitionBy("photo_id").orderBy("node")).alias("label"))
    return nodes.join(names, ["photo_id", "node"]).select("photo_id", "y", "x", "label")


_FAR = np.int64(1) << 40


def nearest_site(sites: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance, row and column of the nearest site for the ``wanted`` cells; ties go to the lowest column, then above.

    Nearest site within each column, then columns at growing distance until no wanted cell can gain.
    """
    (h, w), rows = sites.shape, np.arange(sites.shape[0])[:, None]
    above = np.maximum.accumulate(np.where(sites, rows, -_FAR), 0)
    below = np.minimum.accumulate(np.where(sites, rows, _FAR)[::-1], 0)[::-1]
    row = np.where(rows - above <= below - rows, above, below)
    gap = np.minimum(np.minimum(rows - above, below - rows), 1 << 20)
    flat = gap * gap
    best, col = flat.copy(), np.broadcast_to(np.arange(w), (h, w)).copy()
    for d in range(1, w):
        if not wanted.any() or d * d > best[wanted].max():
            break
        left = flat[:, :-d] + d * d
        better = left <= best[:, d:]
        best[:, d:][better] = left[better]
        col[:, d:][better] = np.broadcast_to(np.arange(w - d), left.shape)[better]
        right = flat[:, d:] + d * d
        better = right < best[:, :-d]
        best[:, :-d][better] = right[better]
        col[:, :-d][better] = np.broadcast_to(np.arange(d, w), right.shape)[better]
    return best, np.take_along_axis(row, col, 1), col


def envelope(columns: np.ndarray, heights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` the place in ``columns`` (growing) with the least height plus squared distance; of equal ones the first.

    Each column's parabola is pushed once and taken away at most once, so time goes with the columns.
    """
    stack, start = [0], [np.iinfo(np.int64).min]
    xs, hs = columns.tolist(), heights.tolist()
    for r in range(1, len(xs)):
        while True:
            q = stack[-1]
            last = (xs[r] ** 2 + hs[r] - xs[q] ** 2 - hs[q]) // (2 * (xs[r] - xs[q]))  # up to here q is no worse
            if last >= start[-1] or len(stack) == 1:
                break
            stack.pop()
            start.pop()
        stack.append(r)
        start.append(last + 1)
    return np.array(stack)[np.searchsorted(np.array(start), wanted, "right") - 1]


def nearest_seeds(cells: DataFrame) -> DataFrame:
    """(photo_id, y, x, site), all cells of a photo, to each one's nearest site: squared distance d2, site_y, site_x; a photo without sites gives no rows.

    Of equally near sites the one in the lowest column counts, in a column the one above.
    """
    column = Window.partitionBy("photo_id", "x").orderBy("y")
    here = F.when(F.col("site"), F.col("y"))
    above, below = F.last(here, True).over(column), F.first(here, True).over(column.rowsBetween(0, Window.unboundedFollowing))
    up = cells.select("photo_id", "y", "x", above.alias("above"), below.alias("below"))
    nearer = F.when(F.col("below").isNull() | (F.col("y") - F.col("above") <= F.col("below") - F.col("y")), F.col("above")).otherwise(F.col("below"))
    rows = up.select("photo_id", "y", F.struct("x", nearer.alias("s")).alias("c")).groupBy("photo_id", "y").agg(F.sort_array(F.collect_list("c")).alias("row"))
    lists = rows.select("photo_id", "y", F.col("row.x").alias("xs"), F.transform("row", lambda c: F.coalesce(c["s"], F.lit(-1))).alias("ss"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for y, xs, ss in zip(pdf["y"], pdf["xs"], pdf["ss"], strict=True):
                x, s = np.asarray(xs, np.int64), np.asarray(ss, np.int64)
                have = np.flatnonzero(s >= 0)
                if not len(have):
                    found.append(([], [], []))
                    continue
                at = have[envelope(x[have], (s[have] - y) ** 2, x)]
                found.append((((x - x[at]) ** 2 + (s[at] - y) ** 2).tolist(), s[at].tolist(), x[at].tolist()))
            yield pd.DataFrame({"photo_id": pdf["photo_id"], "y": pdf["y"], "xs": pdf["xs"], **{c: [f[i] for f in found] for i, c in enumerate(("d2", "site_y", "site_x"))}})

    out = lists.mapInPandas(each, "photo_id long, y int, xs array<int>, d2 array<int>, site_y array<int>, site_x array<int>").where("size(d2) > 0")
    return out.select("photo_id", "y", F.inline(F.arrays_zip(F.col("xs").alias("x"), "d2", "site_y", "site_x"))).toDF("photo_id", "y", "x", "d2", "site_y", "site_x")


def distances(cells: DataFrame) -> DataFrame:
    """(photo_id, y, x, site), all cells of a photo, to each one's squared distance d2 from the nearest site; a photo without sites gives no rows."""
    return nearest_seeds(cells).select("photo_id", "y", "x", "d2")


def every_nth(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th of the cells (photo_id, y, x) of each photo in raster order, the first one included.

    Rows are counted first and added up, so no window is longer than a photo's number of rows or a row's number of cells.
    """
    totals = cells.groupBy("photo_id", "y").agg(F.count("*").alias("n"))
    before = totals.select("photo_id", "y", F.coalesce(F.sum("n").over(Window.partitionBy("photo_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = cells.withColumn("own", F.row_number().over(Window.partitionBy("photo_id", "y").orderBy("x")) - 1)
    return own.join(before, ["photo_id", "y"]).where((F.col("before") + F.col("own")) % step == 0).drop("own", "before")
