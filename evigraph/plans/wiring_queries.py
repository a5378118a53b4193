"""Queries about how an application is put together: mounts of routers, over a hierarchy of part keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mounts as M
from ..sources.corpus import table


def _routers(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("router"), F.concat(F.lit("/"), F.substring("p_brand", 7, 2)).alias("prefix"), F.array("p_name").alias("dependencies"))


def _links(spark, sf, circles):
    """A key is mounted by the key without its last digit; by a key of the size of its part, if smaller (diamonds); and some mount a key above them (circles)."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS k", "CAST(p_size AS bigint) AS size", "p_type AS kind")
    tens = p.where("k >= 10").selectExpr("k DIV 10 AS parent", "k AS child", "0 AS place", "concat('/t', k % 3) AS prefix", "array(kind) AS dependencies", "k % 4 != 0 AS inherit")
    sizes = p.where("size < k AND k % 2 = 0").selectExpr("size AS parent", "k AS child", "1 AS place", "'' AS prefix", "CAST(array() AS array<string>) AS dependencies", "true AS inherit")
    back = p.where("k >= 100 AND k % 67 = 0").selectExpr("k AS parent", "k DIV 10 AS child", "2 AS place", "'/back' AS prefix", "array('again') AS dependencies", "true AS inherit")
    lone = p.where("k < 10 AND k % 4 = 3").selectExpr("k AS parent", "k AS child", "3 AS place", "'/self' AS prefix", "CAST(array() AS array<string>) AS dependencies", "true AS inherit")
    links = tens.unionByName(sizes)
    return links.unionByName(back).unionByName(lone) if circles else links


def router_mounts(spark, sf):
    """Every way in which a router is served."""
    ways, _ = M.mount_variants(_routers(spark, sf), _links(spark, sf, True))
    return ways.select("router", "prefix", F.array_join("dependencies", ",").alias("dependencies"))


def router_mount_issues(spark, sf):
    """Routers that are not served, as they are mounted in circles alone, or in too many ways."""
    _, issues = M.mount_variants(_routers(spark, sf), _links(spark, sf, True), most=6)
    return issues


def router_effective(spark, sf):
    """The first prefix and the common dependencies of every router."""
    found = M.effective_mounts(_routers(spark, sf), _links(spark, sf, False))
    return found.select("router", "prefix", F.array_join(F.array_sort("dependencies"), ",").alias("dependencies"), "cyclic")


QUERIES = {f.__name__: f for f in (router_mounts, router_mount_issues, router_effective)}

_LINKS_SQL = """p AS (SELECT p_partkey AS k, p_size::BIGINT AS size, p_type AS kind, '/' || substr(p_brand, 7, 2) AS prefix, [p_name] AS deps FROM part),
acyclic AS (SELECT k // 10 AS parent, k AS child, 0 AS place, '/t' || (k % 3) AS prefix, [kind] AS deps, k % 4 != 0 AS inherit FROM p WHERE k >= 10
  UNION ALL SELECT size, k, 1, '', []::VARCHAR[], true FROM p WHERE size < k AND k % 2 = 0),
links AS (SELECT * FROM acyclic UNION ALL SELECT k, k // 10, 2, '/back', ['again'], true FROM p WHERE k >= 100 AND k % 67 = 0 UNION ALL SELECT k, k, 3, '/self', []::VARCHAR[], true FROM p WHERE k < 10 AND k % 4 = 3)"""
_WAYS_SQL = f"""WITH RECURSIVE {_LINKS_SQL},
walk AS (
  SELECT k AS router, prefix, deps, [k] AS passed FROM p WHERE k NOT IN (SELECT child FROM links)
  UNION SELECT l.child, w.prefix || l.prefix || p.prefix, list_concat(list_concat(CASE WHEN inherit THEN w.deps ELSE [] END, l.deps), p.deps), list_append(w.passed, l.child)
  FROM walk w JOIN links l ON l.parent = w.router JOIN p ON p.k = l.child WHERE NOT list_contains(w.passed, l.child)
),
ways AS (SELECT DISTINCT router, prefix, deps FROM walk)"""
ORACLES = {
    "router_mounts": f"{_WAYS_SQL} SELECT router, prefix, array_to_string(deps, ',') AS dependencies FROM ways",
    "router_mount_issues": f"""{_WAYS_SQL}, n AS (SELECT router, count(*) AS n FROM ways GROUP BY router),
below AS (SELECT router FROM n WHERE n > 6 UNION SELECT l.child FROM below b JOIN links l ON l.parent = b.router)
SELECT k AS router, 'cycle' AS issue FROM p WHERE k NOT IN (SELECT router FROM ways) AND k NOT IN (SELECT router FROM below)
UNION ALL SELECT DISTINCT router, 'too_many' FROM below""",
    "router_effective": f"""WITH RECURSIVE {_LINKS_SQL},
walk AS (SELECT k AS router, list_sort(deps) AS deps FROM p WHERE k NOT IN (SELECT child FROM acyclic)
  UNION SELECT l.child, list_sort(list_distinct(list_concat(list_concat(w.deps, l.deps), p.deps))) FROM walk w JOIN acyclic l ON l.parent = w.router JOIN p ON p.k = l.child),
n AS (SELECT router, count(*) AS n FROM walk GROUP BY router),
common AS (SELECT router, string_agg(d, ',' ORDER BY d) AS dependencies FROM (SELECT router, d, count(*) AS times FROM (SELECT router, unnest(deps) AS d FROM walk) GROUP BY ALL) JOIN n USING (router) WHERE times = n GROUP BY router),
chain AS (SELECT k AS router, prefix FROM p WHERE k NOT IN (SELECT child FROM acyclic)
  UNION ALL SELECT f.child, c.prefix || f.prefix || p.prefix FROM chain c JOIN (SELECT * FROM acyclic QUALIFY row_number() OVER (PARTITION BY child ORDER BY place, parent) = 1) f ON f.parent = c.router JOIN p ON p.k = f.child)
SELECT router, prefix, coalesce(dependencies, '') AS dependencies, false AS cyclic FROM chain LEFT JOIN common USING (router)""",
}
