"""Groups of look-alike objects: Ward's groups at every count, their order and distances, the suggested count, and principal axes.

The text over given labels runs in both engines. For the labels themselves Spark has a kernel (``operators.grouping``), and the text for
DuckDB joins the two cheapest groups of every photo in each step of a recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.functions.color import ciede2000_stages, nest
from pigmenta.functions.linear import eigen_stages
from pigmenta.operators.grouping import GROUPS, LEAST_SCORE, LEAST_SEPARATION, LEAST_VARIANCE, LIGHTNESS, ward_groups
from pigmenta.operators.records import partition_for
from pigmenta.operators.tables import checkpointed

Run = Callable[[SparkSession, str, str], DataFrame]

# Cost of joining two groups, and the joined group.
_PAIR = "2e0 * a.size * b.size / (a.size + b.size) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_JOINED = "{'a': a.rep, 'b': b.rep, 'size': a.size + b.size, " + ", ".join(f"'{c}': (a.size * a.{c} + b.size * b.{c}) / (a.size + b.size)" for c in "xyz") + "}"


def _ward(objects: str) -> str:
    """CTEs up to ``l``: photo_id, k, object_id, grp, by recursion."""
    return f"""
WITH RECURSIVE o AS MATERIALIZED ({objects}),
r AS (SELECT photo_id, object_id, count(*) OVER (PARTITION BY photo_id) AS left_, row_number() OVER (PARTITION BY photo_id ORDER BY object_id) AS rep, CAST(1 AS DOUBLE) AS size, {LIGHTNESS}e0 * lab_l AS x, lab_a AS y, lab_b AS z FROM o
UNION ALL SELECT r.photo_id, object_id, left_ - 1, CASE WHEN rep = j.b THEN j.a ELSE rep END, CASE WHEN rep IN (j.a, j.b) THEN j.size ELSE r.size END, CASE WHEN rep IN (j.a, j.b) THEN j.x ELSE r.x END, CASE WHEN rep IN (j.a, j.b) THEN j.y ELSE r.y END, CASE WHEN rep IN (j.a, j.b) THEN j.z ELSE r.z END
FROM r JOIN (SELECT a.photo_id, arg_min({_JOINED}, {{'c': {_PAIR}, 'a': a.rep, 'b': b.rep}}) AS j FROM (SELECT DISTINCT photo_id, rep, size, x, y, z FROM r) AS a JOIN (SELECT DISTINCT photo_id, rep, size, x, y, z FROM r) AS b ON a.photo_id = b.photo_id AND a.rep < b.rep GROUP BY a.photo_id) AS best ON best.photo_id = r.photo_id),
l AS MATERIALIZED (SELECT photo_id, CAST(left_ AS INT) AS k, object_id, CAST(dense_rank() OVER (PARTITION BY photo_id, left_ ORDER BY rep) - 1 AS INT) AS grp FROM r WHERE left_ <= {GROUPS})"""


_SCORES = f"""
f AS (SELECT l.photo_id, l.k, l.object_id, l.grp, {LIGHTNESS}e0 * lab_l AS x, lab_a AS y, lab_b AS z, count(*) OVER (PARTITION BY l.photo_id, l.k, l.grp) AS size FROM l JOIN o ON o.photo_id = l.photo_id AND o.object_id = l.object_id),
far AS (SELECT p.photo_id, p.k, p.object_id, p.grp, p.size, q.grp AS other, q.size AS many, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) AS total FROM f p JOIN f q ON p.photo_id = q.photo_id AND p.k = q.k GROUP BY p.photo_id, p.k, p.object_id, p.grp, p.size, q.grp, q.size),
own AS (SELECT photo_id, k, object_id, max(CASE WHEN other = grp AND size > 1 THEN total / (size - 1) END) AS own, min(CASE WHEN other <> grp THEN total / many END) AS near FROM far GROUP BY photo_id, k, object_id),
sc AS (SELECT photo_id, k, avg(coalesce((near - own) / greatest(own, near, 1e-12), 0e0)) AS score FROM own GROUP BY photo_id, k)"""

#: Over o (objects), l (labels) and sc (scores): groups light to dark, and the count that the running best of the accepted scores suggests.
_GROUPS = (
    "c AS (SELECT l.photo_id, l.k, l.grp, count(*) AS size, min(l.object_id) AS first_id, {pct}(lab_l, 0.5) AS cl, {pct}(lab_a, 0.5) AS ca, {pct}(lab_b, 0.5) AS cb FROM l JOIN o ON o.photo_id = l.photo_id AND o.object_id = l.object_id GROUP BY l.photo_id, l.k, l.grp), "
    "d AS (SELECT *, CAST(row_number() OVER (PARTITION BY photo_id, k ORDER BY cl DESC, first_id) - 1 AS INT) AS place, sum(size) OVER (PARTITION BY photo_id, k) AS n FROM c), "
    f"s AS (SELECT photo_id, k, min(delta_e) AS separation FROM ({nest('SELECT p.photo_id, p.k, p.cl AS l1, p.ca AS a1, p.cb AS b1, q.cl AS l2, q.ca AS a2, q.cb AS b2 FROM d p JOIN d q ON p.photo_id = q.photo_id AND p.k = q.k AND p.place < q.place', ciede2000_stages(('l1', 'a1', 'b1'), ('l2', 'a2', 'b2')))}) AS e GROUP BY photo_id, k), "
    "w AS (SELECT photo_id, k, count(*) AS found, max(n) AS n FROM d GROUP BY photo_id, k), "
    f"q AS (SELECT w.photo_id, w.k, separation, CASE WHEN w.k < n THEN score END AS score, CASE WHEN w.k < n AND separation >= {LEAST_SEPARATION}e0 AND min(CASE WHEN found = w.k THEN 1 ELSE 0 END) OVER (PARTITION BY w.photo_id ORDER BY w.k) = 1 THEN score END AS accepted FROM w LEFT JOIN s ON s.photo_id = w.photo_id AND s.k = w.k LEFT JOIN sc ON sc.photo_id = w.photo_id AND sc.k = w.k), "
    "g AS ("
    + nest(
        "SELECT photo_id, " + ", ".join(f"max(CASE WHEN k = {k} THEN accepted END) AS s{k}" for k in range(2, GROUPS + 1)) + f", {LEAST_SCORE}e0 AS best1, 1 AS take1 FROM q GROUP BY photo_id",
        [{f"best{k}": f"CASE WHEN s{k} > best{k - 1} THEN s{k} ELSE best{k - 1} END", f"take{k}": f"CASE WHEN s{k} > best{k - 1} THEN {k} ELSE take{k - 1} END"} for k in range(2, GROUPS + 1)],
    )
    + "), "
    f"z AS (SELECT d.photo_id, d.k, d.place AS grp, CAST(size AS INT) AS size, round(cl, 6) AS lab_l, round(ca, 6) AS lab_a, round(cb, 6) AS lab_b, round(separation, 6) AS separation, round(CASE WHEN d.k > 1 THEN score END, 6) AS score, d.k = take{GROUPS} AS suggested FROM d JOIN q ON q.photo_id = d.photo_id AND q.k = d.k JOIN g ON g.photo_id = d.photo_id) SELECT * FROM z"
)


def _axes(objects: str) -> str:
    """A row a photo: eigenvalues and axes of the features, their means, and the number of objects."""
    sums = f"SELECT photo_id, count(*) AS n, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz, covar_samp(x, x) AS cxx, covar_samp(x, y) AS cxy, covar_samp(x, z) AS cxz, covar_samp(y, y) AS cyy, covar_samp(y, z) AS cyz, covar_samp(z, z) AS czz FROM (SELECT photo_id, {LIGHTNESS}e0 * lab_l AS x, lab_a AS y, lab_b AS z FROM ({objects}) AS o) AS f GROUP BY photo_id"
    return nest(sums, eigen_stages("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))


def texts(objects: str) -> dict[str, str]:
    entry = ", ".join([*(f"round(e{i}, 5) AS e{i}" for i in (1, 2, 3)), *(f"round(v{i}{c}, 5) AS v{i}{c}" for i in (1, 2, 3) for c in "xyz")])
    along = lambda i: " + ".join(f"({f} - o{c}) * v{i}{c}" for f, c in zip((f"{LIGHTNESS}e0 * lab_l", "lab_a", "lab_b"), "xyz", strict=True))
    placed = nest(f"SELECT o.photo_id, o.object_id, o.lab_l, o.lab_a, o.lab_b, n, {', '.join(f'e{i}, {along(i)} AS t{i}' for i in (1, 2, 3))}, {', '.join(f'v{i}{c}' for i in (1, 2, 3) for c in 'xyz')} FROM ({objects}) AS o JOIN ({_axes(objects)}) AS a ON a.photo_id = o.photo_id", [{f"h{i}": f"t{i} / sqrt(greatest(e{i}, {LEAST_VARIANCE}e0))" for i in (1, 2, 3)}, {f"d{c}": " + ".join(f"h{i} * v{i}{c}" for i in (1, 2, 3)) for c in "xyz"}])
    few = lambda value, else_: f"round(CASE WHEN n < 3 THEN {else_} ELSE {value} END, 5)"
    return {
        "principal_axes": f"SELECT photo_id, {entry} FROM ({_axes(objects)}) AS a WHERE n >= 3",
        # Fewer than three objects keep their own colour and the origin.
        "enhanced_colours": f"SELECT photo_id, object_id, {few('least(greatest(62e0 + 15e0 * dx, 25e0), 92e0)', 'lab_l')} AS enhanced_l, {few('36e0 * dy', 'lab_a')} AS enhanced_a, {few('36e0 * dz', 'lab_b')} AS enhanced_b, {few('t1', '0e0')} AS principal_x, {few('t2', '0e0')} AS principal_y FROM ({placed}) AS p",
    }


def oracle_sql(objects: str) -> dict[str, str]:
    shown = "coalesce(max(CASE WHEN k = 1 + photo_id % 9 THEN k END), min(k))"
    return {
        "ward_cut": f"{_ward(objects)} SELECT photo_id, k, object_id, grp FROM l",
        # Photos ask for 1 to 9 groups; where there is no such partition the first is shown.
        "shown_groups": f"{_ward(objects)} SELECT l.photo_id, l.k, l.object_id, l.grp FROM l JOIN (SELECT photo_id, {shown} AS k FROM l GROUP BY photo_id) AS s ON s.photo_id = l.photo_id AND s.k = l.k",
        "one_group": f"{_ward(objects)} SELECT photo_id, k, object_id, grp FROM l WHERE k = 3 AND grp = 1",
        "group_suggestion": f"{_ward(objects)},{_SCORES}, {_GROUPS}",
    }


def suggest(spark: SparkSession, objects: DataFrame, labels: DataFrame, filled: Callable[[str], str]) -> DataFrame:
    """Groups and the suggested count from objects and labels with scores (see ``operators.grouping.ward_groups``)."""
    scores = "SELECT DISTINCT photo_id, k, score FROM {labels}"
    objects, labels = checkpointed(objects), checkpointed(labels)  # read several times
    return spark.sql(filled(f"WITH o AS (SELECT * FROM {{objects}}), l AS (SELECT * FROM {{labels}}), sc AS ({scores}), {_GROUPS}"), objects=objects, labels=labels)


def queries(run: Run, objects: str, filled: Callable[[str], str]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ward_groups(run(spark, sf_dir, objects)).drop("score")

    def suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
        of = run(spark, sf_dir, objects)
        return suggest(spark, of, ward_groups(of), filled)

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = cut(spark, sf_dir)
        asked = labels.groupBy("photo_id").agg(F.coalesce(F.max(F.when(F.col("k") == 1 + F.col("photo_id") % 9, F.col("k"))), F.min("k")).alias("k"))
        return labels.join(asked, ["photo_id", "k"], "left_semi").select("photo_id", "k", "object_id", "grp")

    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return partition_for(cut(spark, sf_dir), 3, 1).select("photo_id", "k", "object_id", "grp")

    return {"ward_cut": cut, "group_suggestion": suggestion, "shown_groups": shown, "one_group": one}
