"""Ward clustering cut at every group count, the suggested count, and principal axes.

A photo's objects are merged in one task by nearest-neighbour chains: time goes with the square of their number, memory with the number
itself. What follows from the groups (medians, order, distances, the suggestion) is SQL in ``plans.grouping``; ``group`` does the
same on arrays for the photo kernel.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.functions.kernels import ciede2000

GROUPS = 6
LIGHTNESS = 0.7
# Least silhouette and colour distance of a suggested count; least variance of an axis that is stretched.
LEAST_SCORE, LEAST_SEPARATION = 0.5, 2.0
LEAST_VARIANCE = 2.25


def ward_merges(points: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of groups, each named by its first point, in the order of growing cost at which Ward's method joins them.

    A chain goes from group to nearest group until two are nearest to each other; those are joined at once. Ward's cost of a join never
    falls below that of the joins before it, so the joins, sorted by cost, are those of always taking the cheapest pair. Of
    equally near groups the chain prefers where it came from, then the first; so among equal costs the order may differ from taking
    the first cheapest pair.
    """
    n = len(points)
    centre, size, alive = np.array(points, float), np.ones(n), np.arange(n)
    cost, made = np.zeros(n), []
    chain: list[int] = []
    place = np.arange(n)  # of a group among the living
    while len(alive) > 1:
        if not chain:
            chain.append(int(alive[0]))
        tip = chain[-1]
        near = size[alive] * size[tip] / (size[alive] + size[tip]) * ((centre[alive] - centre[tip]) ** 2).sum(1)
        near[place[tip]] = np.inf
        best = int(near.argmin())
        if len(chain) > 1 and near[place[chain[-2]]] <= near[best]:
            a, b = sorted((chain.pop(), chain.pop()))
            joined = max(float(near[place[b if tip == a else a]]), cost[a], cost[b])  # rounding can't let a join precede its parts
            centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
            size[a] += size[b]
            cost[a] = joined
            made.append((joined, a, b))
            alive = np.delete(alive, place[b])
            place[alive] = np.arange(len(alive))
        else:
            chain.append(int(alive[best]))
    order = np.argsort([c for c, _, _ in made], kind="stable") if made else []
    return [made[i][1:] for i in order]


def cuts(merges: list[tuple[int, int]], n: int, most: int) -> dict[int, np.ndarray]:
    """Group of each point when 1, 2, .. up to ``most`` groups are left, numbered by first appearance."""
    first, out = np.arange(n), {}  # the first point of each point's group, so groups sort as they appear
    for left in range(n, 0, -1):
        if left <= most:
            out[left] = np.unique(first, return_inverse=True)[1]
        if left > 1:
            a, b = merges[n - left]
            first[first == b] = a
    return dict(sorted(out.items()))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit vectors (columns) whose largest component is positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1].copy()
    for j in range(vectors.shape[1]):
        if vectors[np.abs(vectors[:, j]).argmax(), j] < 0:
            vectors[:, j] *= -1
    return values, vectors


def silhouettes(points: np.ndarray, groupings: list[np.ndarray], block: int = 512) -> list[float]:
    """Mean silhouette of each grouping, distances a block of points at a time; a lone object scores 0."""
    ones = [np.eye(g.max() + 1)[g] for g in groupings]
    sizes, total = [o.sum(0) for o in ones], np.zeros(len(groupings))
    for at in range(0, len(points), block):
        part = slice(at, at + block)
        far = np.sqrt(((points[part, None] - points[None]) ** 2).sum(2))
        for i, (g, one, size) in enumerate(zip(groupings, ones, sizes, strict=True)):
            own_group, sums = g[part], far @ one
            own = sums[np.arange(len(own_group)), own_group] / np.maximum(size[own_group] - 1, 1)
            near = np.where(one[part] > 0, np.inf, sums / size).min(1)
            score = (near - own) / np.maximum(np.maximum(own, near), 1e-12)
            total[i] += np.where(size[own_group] > 1, score, 0.0).sum()
    return (total / len(points)).tolist()


class Partition(NamedTuple):
    """Objects in ``k`` groups numbered light to dark, with median colours and sizes; distance of the two closest groups."""

    k: int
    assignment: np.ndarray
    centroids: np.ndarray
    counts: np.ndarray
    separation: float | None
    score: float | None


class Grouped(NamedTuple):
    """``enhanced`` are colours with equal spread along the principal axes, ``principal`` places on the first two."""

    enhanced: np.ndarray
    principal: np.ndarray
    partitions: list[Partition]
    suggested: int


def group(labs: np.ndarray) -> Grouped:
    """Groups of Lab colours at every count, and the suggested count: the best silhouette among those far enough apart."""
    n = len(labs)
    features = labs * [LIGHTNESS, 1, 1]
    enhanced, principal = labs.copy(), np.zeros((n, 2))
    if n >= 3:
        off = features - features.mean(0)
        values, axes = eigen(off.T @ off / (n - 1))
        spread = (off @ axes / np.sqrt(np.maximum(values, LEAST_VARIANCE))) @ axes.T
        enhanced = np.column_stack([np.clip(62 + 15 * spread[:, 0], 25, 92), 36 * spread[:, 1:]])
        principal = off @ axes[:, :2]
    partitions = [Partition(1, np.zeros(n, int), np.median(labs, 0)[None] if n else np.zeros((0, 3)), np.array([n]), None, None)]
    if n < 2:
        return Grouped(enhanced, principal, partitions, 1)
    at = cuts(ward_merges(features), n, GROUPS)
    scored = [k for k in at if 1 < k < n]
    scores = dict(zip(scored, silhouettes(features, [at[k] for k in scored]), strict=True)) if scored else {}
    suggested, best = 1, LEAST_SCORE
    for k, raw in at.items():
        if k == 1:
            continue
        middle = np.array([np.median(labs[raw == g], 0) for g in range(k)])
        order = np.argsort(-middle[:, 0], kind="stable")
        assignment, middle = np.argsort(order)[raw], middle[order]
        i, j = np.triu_indices(k, 1)
        apart = float(ciede2000(middle[i], middle[j]).min())
        score = scores.get(k)
        partitions.append(Partition(k, assignment, middle, np.bincount(assignment, minlength=k), apart, score))
        if score is not None and score > best and apart >= LEAST_SEPARATION:
            suggested, best = k, score
    return Grouped(enhanced, principal, partitions, suggested)


CUT = "photo_id long, k int, object_id long, grp int, score double"


def ward_groups(objects: DataFrame, most: int = GROUPS) -> DataFrame:
    """(photo_id, object_id, lab_l, lab_a, lab_b) to each object's group at every count up to ``most`` (see ``CUT``); lightness counts 0.7.

    ``score`` is the grouping's mean silhouette, null for one group and for groups of one object each.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("object_id")
        n = len(pdf)
        points = pdf[["lab_l", "lab_a", "lab_b"]].to_numpy(float) * [LIGHTNESS, 1, 1]
        at = cuts(ward_merges(points), n, min(most, n))
        scored = [k for k in at if 1 < k < n]
        scores = dict(zip(scored, silhouettes(points, [at[k] for k in scored]), strict=True)) if scored else {}
        return pd.concat([pd.DataFrame({"photo_id": pdf["photo_id"], "k": k, "object_id": pdf["object_id"], "grp": g, "score": scores.get(k, np.nan)}) for k, g in at.items()])

    cut = objects.groupBy("photo_id").applyInPandas(one, CUT)
    return cut.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
