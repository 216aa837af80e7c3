"""Matches of several projects: every nation is a project whose sheets are its suppliers; all flavours take part in each.

The locks are those of FIXTURES.md, in each project: the first two flavours hold its two lowest sheets, available or not. The SQL finds the
optimum by trying all ways to give the remaining sheets to flavours, which only small tables allow; Spark's plan is the auction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pigmenta.operators import assignment

Run = Callable[..., DataFrame]

_LOCKED = "SELECT project, flavor, paper FROM (SELECT project, paper, row_number() OVER (PARTITION BY project ORDER BY paper) AS i FROM (SELECT DISTINCT s_nationkey AS project, s_suppkey AS paper FROM supplier) AS d) AS p JOIN (SELECT flavor, row_number() OVER (ORDER BY flavor) AS i FROM (SELECT DISTINCT {key} AS flavor FROM (SELECT p_name AS label FROM part) AS n) AS d) AS f ON p.i = f.i WHERE p.i <= 2"


def project_costs(costs: str) -> str:
    return f"SELECT s_nationkey AS project, flavor, label, first_seq AS ord, paper, available, delta_e FROM ({costs}) AS k JOIN supplier ON s_suppkey = paper"


def _solved(costs: str) -> str:
    """CTEs up to ``m``: project, flavor, label, ord, paper, delta_e, locked."""
    return f"""
WITH RECURSIVE c AS MATERIALIZED ({project_costs(costs)}),
l AS MATERIALIZED ({_LOCKED}),
free AS (SELECT project, paper, row_number() OVER (PARTITION BY project ORDER BY paper) AS i, count(*) OVER (PARTITION BY project) AS k FROM (SELECT DISTINCT c.project, c.paper FROM c WHERE available AND NOT EXISTS (SELECT 1 FROM l WHERE l.project = c.project AND l.paper = c.paper)) AS d),
near AS (SELECT project, i, paper, flavor, cost FROM (SELECT c.project, i, k, c.paper, flavor, delta_e * delta_e AS cost, row_number() OVER (PARTITION BY c.project, c.paper ORDER BY delta_e, flavor) AS place FROM c JOIN free ON free.project = c.project AND free.paper = c.paper WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.project = c.project AND l.flavor = c.flavor)) AS n WHERE place <= k),
t AS (SELECT project, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS fl, CAST([] AS BIGINT[]) AS pp, CAST(0 AS DOUBLE) AS total FROM (SELECT DISTINCT project FROM c) AS d UNION ALL SELECT t.project, near.i, list_append(fl, flavor), list_append(pp, paper), total + cost FROM t JOIN near ON near.project = t.project AND near.i = t.i + 1 WHERE NOT list_contains(fl, flavor)),
best AS (SELECT t.project, arg_min(fl, total) AS fl, arg_min(pp, total) AS pp FROM t JOIN (SELECT project, max(i) AS i FROM t GROUP BY project) AS e ON t.project = e.project AND t.i = e.i GROUP BY t.project),
held AS (SELECT project, unnest(fl) AS flavor, unnest(pp) AS paper, FALSE AS locked FROM best UNION ALL SELECT project, flavor, paper, TRUE AS locked FROM l),
f AS (SELECT DISTINCT project, flavor, label, ord FROM c),
m AS MATERIALIZED (SELECT f.project, f.flavor, f.label, f.ord, held.paper, c.delta_e, coalesce(locked, FALSE) AS locked FROM f LEFT JOIN held ON held.project = f.project AND held.flavor = f.flavor LEFT JOIN c ON c.project = f.project AND c.flavor = f.flavor AND c.paper = held.paper)"""


def oracle_sql(costs: str) -> dict[str, str]:
    solved = _solved(costs)
    return {
        "match_projects": solved + """,
near5 AS (SELECT * FROM (SELECT c.project, c.flavor, c.label, c.paper, c.delta_e, row_number() OVER (PARTITION BY c.project, c.flavor ORDER BY c.delta_e, c.paper) AS place FROM c WHERE available OR EXISTS (SELECT 1 FROM l WHERE l.project = c.project AND l.paper = c.paper)) AS n WHERE place <= 5)
SELECT m.project, m.ord, m.flavor, coalesce(m.paper, -1) AS paper, round(m.delta_e, 6) AS delta_e, m.locked, CAST(coalesce(near5.place, 0) AS INT) AS place, coalesce(near5.paper, -1) AS near_paper, round(near5.delta_e, 6) AS near_delta_e, CASE WHEN h.label <> m.label THEN h.label ELSE '' END AS taken_by
FROM m LEFT JOIN near5 ON near5.project = m.project AND near5.flavor = m.flavor LEFT JOIN m AS h ON h.project = m.project AND h.paper = near5.paper""",
        "match_project_summaries": solved + """
SELECT m.project, count(*) AS flavors, count(m.paper) AS matched, round(coalesce(avg(m.delta_e), 0), 6) AS mean_delta_e, CASE WHEN max(m.delta_e) > 5 THEN arg_max(flavor, m.delta_e) ELSE '' END AS worst, CASE WHEN max(m.delta_e) > 5 THEN round(max(m.delta_e), 6) END AS worst_delta_e, CAST(greatest(max(coalesce(a.n, 0)) - count(m.paper), 0) AS BIGINT) AS spare
FROM m LEFT JOIN (SELECT s_nationkey AS project, count(*) AS n FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey) AS a ON a.project = m.project GROUP BY m.project""",
        # That an assignment is best can't be computed here for the whole table, but any prices prove it: no gap to their bound.
        "assignment_certificates": """
SELECT project, flavors, papers, least(flavors, papers) AS matched, least(flavors, papers) AS sheets, CAST(0 AS DOUBLE) AS gap FROM (SELECT s_nationkey AS project, count(*) AS papers FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey UNION ALL SELECT -1 AS project, count(*) AS papers FROM supplier WHERE s_acctbal >= 0) AS p CROSS JOIN (SELECT count(DISTINCT {key}) AS flavors FROM (SELECT p_name AS label FROM part) AS n) AS f""",
    }


def queries(run: Run, costs: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, project_costs("SELECT * FROM {costs}"), costs=costs(spark, sf_dir))

    def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
        of = paired(spark, sf_dir)
        return assignment.match_projects(None, of, run(spark, sf_dir, _LOCKED))

    def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = matched(spark, sf_dir).select("project", "ord", "flavor", "paper", F.round("delta_e", 6).alias("delta_e"), "locked", F.explode_outer("alternates").alias("a"))
        none = F.lit(-1).cast("long")  # for no sheet
        return rows.select("project", "ord", "flavor", F.coalesce("paper", none).alias("paper"), "delta_e", "locked", F.coalesce("a.place", F.lit(0)).alias("place"), F.coalesce("a.paper", none).alias("near_paper"), F.round("a.delta_e", 6).alias("near_delta_e"), F.coalesce("a.taken_by", F.lit("")).alias("taken_by"))

    def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
        available = run(spark, sf_dir, "SELECT s_nationkey AS project, count(*) AS available FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey")
        return assignment.summarise_projects(matched(spark, sf_dir), available).withColumn("worst", F.coalesce("worst", F.lit("")))

    def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of every nation's project, and of one (-1) that holds all sheets."""
        of = paired(spark, sf_dir).where("available").select("project", "flavor", "paper", "delta_e")
        of = of.unionByName(of.withColumn("project", F.lit(-1).cast(of.schema["project"].dataType)))
        proof = assignment.certify(of, assignment.assign_projects(of))
        return proof.select("project", "flavors", "papers", "matched", "sheets", F.abs(F.round(F.col("total") - F.col("bound"), 3)).alias("gap"))

    return {"match_projects": projects, "match_project_summaries": summaries, "assignment_certificates": certificates}
