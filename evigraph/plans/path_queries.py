"""Queries about paths named by their ends, over a tree of files made of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import suffixes as S
from ..sources.corpus import PAGE_ROUTES_SQL, page_routes


def _files(spark, sf):
    """page_id, host, lang, name and path of a file for each page; one in four is called ``index.tsx``, in a folder with its number."""
    r = page_routes(spark, sf).select("page_id", "host", F.regexp_extract("path", "^/([^/]*)", 1).alias("lang"), F.regexp_extract("path", "([0-9]+)", 1).alias("number"))
    named = r.withColumn("name", F.expr("CASE WHEN page_id % 4 = 1 THEN concat(number, '/index.tsx') ELSE concat(number, '.ts') END"))
    return named.withColumn("path", F.concat_ws("/", F.lit("web"), "host", "lang", "name"))


def related_files(spark, sf):
    """What notes on pages name: whole paths, ends of two or of one name, the name that thousands of files have, and files that do not exist."""
    f = _files(spark, sf)
    token = "CASE page_id % 6 WHEN 0 THEN path WHEN 1 THEN concat(lang, '/', name) WHEN 2 THEN name WHEN 3 THEN 'index.tsx' WHEN 4 THEN concat('gone/', name) ELSE concat('./', host, '/', lang, '/', name) END"
    return S.by_end(f.select(F.col("page_id").alias("q"), F.expr(token).alias("token")), f.select("path"))


def deployed_files(spark, sf):
    """What deployments run: paths below a release folder, of another tree, with a name alone, that climb, or that are not there."""
    f = _files(spark, sf)
    token = (
        "CASE page_id % 6 WHEN 0 THEN concat('/srv/release/', path) WHEN 1 THEN concat('/opt/', lang, '/', name) WHEN 2 THEN concat('~\\\\\\\\web\\\\\\\\', host, '\\\\\\\\', lang, '\\\\\\\\', name)"
        " WHEN 3 THEN concat('../x/', name) WHEN 4 THEN concat('/srv/web/', host, '/missing.ts') ELSE concat(lang, '/', name) END"
    )
    return S.deployed_files(f.select(F.col("page_id").alias("q"), F.expr(token).alias("token")), f.select("path"))


QUERIES = {f.__name__: f for f in (related_files, deployed_files)}

_FILES_SQL = f"""{PAGE_ROUTES_SQL},
r AS (SELECT page_id, host, regexp_extract(path, '^/([^/]*)', 1) AS lang, regexp_extract(path, '([0-9]+)', 1) AS number FROM routes),
n AS (SELECT *, CASE WHEN page_id % 4 = 1 THEN number || '/index.tsx' ELSE number || '.ts' END AS name FROM r),
f AS (SELECT *, 'web/' || host || '/' || lang || '/' || name AS path FROM n),
e AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS tail FROM (SELECT DISTINCT path FROM f)),
c AS (SELECT tail, count(*) AS hits, min(path) AS one FROM e GROUP BY tail)"""
ORACLES = {
    "related_files": f"""WITH {_FILES_SQL},
t AS (SELECT page_id AS q, CASE page_id % 6 WHEN 0 THEN path WHEN 1 THEN lang || '/' || name WHEN 2 THEN name WHEN 3 THEN 'index.tsx' WHEN 4 THEN 'gone/' || name ELSE host || '/' || lang || '/' || name END AS tail FROM f)
SELECT q, CASE WHEN tail IN (SELECT path FROM f) THEN tail WHEN hits = 1 THEN one END AS path, coalesce(hits, 0) AS hits,
       CASE WHEN tail IN (SELECT path FROM f) THEN 'exact' WHEN hits = 1 THEN 'unique' WHEN hits > 1 THEN 'ambiguous' ELSE 'none' END AS state
FROM t LEFT JOIN c USING (tail)""",
    "deployed_files": f"""WITH {_FILES_SQL},
t AS (SELECT page_id AS q, page_id % 6 AS kind, path, string_split(name, '/')[-1] AS last, CASE page_id % 6 WHEN 4 THEN 'missing.ts' WHEN 5 THEN lang || '/' || name ELSE string_split(name, '/')[-1] END AS tail FROM f)
SELECT q, CASE WHEN kind IN (0, 2) THEN path WHEN hits = 1 THEN one END AS path, CASE WHEN kind IN (0, 2) THEN 'mapped' WHEN hits = 1 THEN CASE WHEN tail = one THEN 'exact' ELSE 'unique' END WHEN hits > 1 THEN 'ambiguous' ELSE 'blocking' END AS state
FROM t LEFT JOIN c USING (tail)""",
}
