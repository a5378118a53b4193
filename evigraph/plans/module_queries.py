"""Queries that resolve imports and re-exports, over trees of files made of pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modules as M
from ..sources.corpus import PAGE_ROUTES_SQL, page_routes, table

#: Text patterns of module names and where they lead, in the configuration that all others extend.
PATTERNS = (("@web/*", ("dist/*", "*")), ("@web/en/*", ("nowhere/*",)), ("home", ("missing", "home")))
#: Those of hosts for mobiles.
MOBILE = (("@web/*", ("../*",)),)


def _sites(spark, sf):
    """Pages as source files: page_id, folder, stem (host, language and number) and path."""
    r = page_routes(spark, sf).select("page_id", "host", F.regexp_extract("path", "^/([^/]*)", 1).alias("lang"), F.regexp_extract("path", "([0-9]+)", 1).alias("number"))
    stem = r.withColumn("stem", F.concat_ws("/", "host", "lang", "number"))
    ending = F.expr("CASE page_id % 4 WHEN 1 THEN '/index.tsx' WHEN 2 THEN '.js' ELSE '.ts' END")
    return stem.select("page_id", "host", "stem", F.concat(F.lit("web/"), "stem", ending).alias("path"))


def _patterns(rows) -> str:
    shown = ", ".join(f"named_struct('pattern', '{p}', 'targets', array({', '.join(repr(t) for t in targets)}))" for p, targets in rows)
    return f"array({shown})"


def script_imports(spark, sf):
    """Each page imports the page with the next number in one of seven spellings."""
    sites = _sites(spark, sf)
    to = sites.select((F.col("page_id") - 1).alias("page_id"), F.col("stem").alias("next"))
    spelled = "CASE page_id % 7 WHEN 0 THEN concat('../../', next) WHEN 1 THEN concat('@web/', next) WHEN 2 THEN concat('@web/en/', next) WHEN 3 THEN next WHEN 4 THEN 'react' WHEN 5 THEN 'home' ELSE concat('./../.././', next, '/') END"
    imports = sites.join(to, "page_id").select(F.col("page_id").alias("import_id"), "path", F.expr(spelled).alias("module"))
    files = sites.select("path").unionByName(spark.sql("SELECT 'web/home/index.js' AS path"))
    fixed = spark.sql(f"SELECT 'base' AS folder, CAST(NULL AS string) AS extends, '../web' AS base_url, {_patterns(PATTERNS)} AS patterns")
    root = fixed.select(F.lit("web").alias("folder"), F.lit("base").alias("extends"), F.lit(None).cast("string").alias("base_url"), F.when(F.lit(False), F.col("patterns")).alias("patterns"))
    mobile = sites.where("host LIKE 'm.%'").select(F.concat(F.lit("web/"), "host").alias("folder"), F.lit("web").alias("extends"), F.lit(None).cast("string").alias("base_url"), F.expr(_patterns(MOBILE)).alias("patterns")).distinct()
    return M.resolve_script_imports(imports, files, fixed.unionByName(root).unionByName(mobile))


def _modules(spark, sf):
    """Parts as Python modules: key, service, module name and path."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS k", "concat('svc', substring(p_brand, 7, 2)) AS svc", "concat('s', p_size % 10) AS sub")
    return p.selectExpr("k", "svc", "sub", "concat(svc, '/app/', sub, '/m', k, '.py') AS path")


def python_imports(spark, sf):
    """Each part imports the next one: from its package root, relatively, from a shared folder that may exist twice, or from elsewhere."""
    m = _modules(spark, sf)
    to = m.select((F.col("k") - 1).alias("k"), F.col("sub").alias("n_sub"))
    imports = m.join(to, "k").selectExpr(
        "k AS import_id", "path", "CASE k % 4 WHEN 0 THEN concat('app.', n_sub, '.m', k + 1) WHEN 1 THEN concat(n_sub, '.m', k + 1) WHEN 2 THEN concat('shared.m', k - k % 10) ELSE 'os.path' END AS module", "CASE k % 4 WHEN 1 THEN 2 ELSE 0 END AS level"
    )
    inner = m.selectExpr("concat(svc, '/app/', sub, '/__init__.py') AS path")
    outer = m.where("svc NOT LIKE '%2'").selectExpr("concat(svc, '/app/__init__.py') AS path")
    shared = m.where("k % 10 = 0").selectExpr("concat('src/shared/m', k, '.py') AS path").unionByName(m.where("k % 20 = 0").selectExpr("concat('shared/m', k, '.py') AS path"))
    files = m.select("path").unionByName(inner.distinct()).unionByName(outer.distinct()).unionByName(shared)
    return M.resolve_python_imports(imports, files)


def export_origins(spark, sf):
    """Files in chains of 64: some end at a definition, some in a circle, some pass all names on; names change from hop to hop."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS k", "p_partkey % 64 AS place", "(p_partkey DIV 64) % 3 AS kind", "concat('f', p_partkey) AS file")
    defs = p.where("(place = 63 AND kind != 1) OR (place = 40 AND k % 5 = 0)").selectExpr("file", "concat('n', k % 5) AS name")
    named = p.where("kind != 2 AND place != 63").selectExpr("file", "0 AS place", "concat('n', k % 5) AS public", "concat('f', k + 1) AS target", "concat('n', (k + 1) % 5) AS imported")
    back = p.where("kind = 1 AND place = 63").selectExpr("file", "0 AS place", "concat('n', k % 5) AS public", "concat('f', k - 63) AS target", "concat('n', (k - 63) % 5) AS imported")
    stars = p.where("kind = 2 AND place != 63").selectExpr("file", "1 AS place", "'*' AS public", "concat('f', k + 1) AS target", "'*' AS imported")
    whole = p.where("place = 10").selectExpr("file", "2 AS place", "'whole' AS public", "concat('f', k + 3) AS target", "'*' AS imported")
    wanted = p.selectExpr("file", "explode(array(concat('n', k % 5), concat('n', (k + 2) % 5), 'whole')) AS name")
    return M.export_origins(wanted, defs, named.unionByName(back).unionByName(stars).unionByName(whole))


QUERIES = {f.__name__: f for f in (script_imports, python_imports, export_origins)}

_ENDINGS = "[" + ", ".join(f"'{e}'" for e in M.SCRIPT_ENDINGS) + "]"
ORACLES = {
    "script_imports": f"""WITH {PAGE_ROUTES_SQL},
s AS (SELECT page_id, host, host || '/' || regexp_extract(path, '^/([^/]*)', 1) || '/' || regexp_extract(path, '([0-9]+)', 1) AS stem FROM routes),
f AS (SELECT *, 'web/' || stem || CASE page_id % 4 WHEN 1 THEN '/index.tsx' WHEN 2 THEN '.js' ELSE '.ts' END AS path FROM s),
i AS (SELECT a.page_id, a.page_id % 7 AS kind, a.host, a.page_id % 4 = 1 AS deep, a.host LIKE 'm.%' AS mobile, b.stem AS next FROM f a JOIN f b ON b.page_id = a.page_id + 1),
b AS (SELECT page_id, kind, CASE
    WHEN kind IN (0, 6) THEN [CASE WHEN deep THEN 'web/' || host || '/' || next ELSE 'web/' || next END]
    WHEN kind = 1 AND mobile THEN ['web/' || next] WHEN kind = 1 THEN ['web/dist/' || next, 'web/' || next] WHEN kind = 2 AND mobile THEN ['web/en/' || next] WHEN kind = 2 THEN ['web/nowhere/' || next]
    WHEN kind = 3 THEN ['web/' || next] WHEN kind = 5 AND NOT mobile THEN ['web/missing', 'web/home'] WHEN kind = 5 THEN ['web/home'] ELSE ['web/react'] END AS bases,
  kind IN (0, 1, 2, 6) OR (kind = 5 AND NOT mobile) AS must FROM i),
t AS (SELECT page_id, n, unnest(list_concat(list_concat([bases[n]], list_transform({_ENDINGS}, lambda e: bases[n] || e)), list_transform({_ENDINGS}, lambda e: bases[n] || '/index' || e))) AS target, generate_subscripts(list_concat(list_concat([''], {_ENDINGS}), {_ENDINGS}), 1) AS try
  FROM (SELECT *, unnest(range(1, len(bases) + 1)) AS n FROM b)),
m AS (SELECT page_id, arg_min(target, [n, try]) AS target FROM t WHERE target IN (SELECT path FROM f UNION ALL SELECT 'web/home/index.js') GROUP BY page_id)
SELECT page_id AS import_id, target, target IS NOT NULL OR must AS local FROM b LEFT JOIN m USING (page_id)""",
    "python_imports": """WITH m AS (SELECT p_partkey AS k, 'svc' || substr(p_brand, 7, 2) AS svc, 's' || (p_size % 10) AS sub FROM part),
i AS (SELECT a.k, a.svc, a.sub, b.sub AS n_sub FROM m a JOIN m b ON b.k = a.k + 1),
f AS (SELECT svc || '/app/' || sub || '/m' || k || '.py' AS path FROM m),
t AS (SELECT k, CASE k % 4 WHEN 0 THEN CASE WHEN svc NOT LIKE '%2' THEN svc || '/app/' || n_sub || '/m' || (k + 1) || '.py' END WHEN 1 THEN svc || '/app/' || n_sub || '/m' || (k + 1) || '.py' END AS target FROM i)
SELECT k AS import_id, CASE WHEN k % 4 = 2 THEN CASE WHEN (k - k % 10) % 20 = 10 AND k - k % 10 IN (SELECT k FROM m) THEN 'src/shared/m' || (k - k % 10) || '.py' END WHEN target IN (SELECT path FROM f) THEN target END AS target FROM t""",
    "export_origins": """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey % 64 AS place, (p_partkey // 64) % 3 AS kind, 'f' || p_partkey AS file FROM part),
own AS (SELECT file, 'n' || (k % 5) AS name FROM p WHERE (place = 63 AND kind != 1) OR (place = 40 AND k % 5 = 0)),
named AS (SELECT file, 'n' || (k % 5) AS name, 'f' || (k + 1) AS tf, 'n' || ((k + 1) % 5) AS tn FROM p WHERE kind != 2 AND place != 63
  UNION ALL SELECT file, 'n' || (k % 5), 'f' || (k - 63), 'n' || ((k - 63) % 5) FROM p WHERE kind = 1 AND place = 63
  UNION ALL SELECT file, 'whole', 'f' || (k + 3), '*' FROM p WHERE place = 10),
star AS (SELECT file, 'f' || (k + 1) AS tf FROM p WHERE kind = 2 AND place != 63),
wanted AS (SELECT file, unnest(['n' || (k % 5), 'n' || ((k + 2) % 5), 'whole']) AS name FROM p),
w AS (SELECT file AS f0, name AS n0, file AS f, name AS n, 0 AS d FROM wanted
  UNION ALL SELECT f0, n0, coalesce(named.tf, star.tf), coalesce(named.tn, w.n), d + 1 FROM w LEFT JOIN named ON named.file = w.f AND named.name = w.n LEFT JOIN star ON star.file = w.f AND named.tf IS NULL
  WHERE d < 140 AND w.n != '*' AND coalesce(named.tf, star.tf) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.file = w.f AND own.name = w.n)),
e AS (SELECT f0, n0, arg_max(f, d) AS f, arg_max(n, d) AS n, max(d) AS d FROM w GROUP BY ALL)
SELECT f0 AS file, n0 AS name, CASE WHEN own.file IS NOT NULL OR n = '*' THEN f END AS origin, CASE WHEN own.file IS NOT NULL OR n = '*' THEN n END AS origin_name,
       CASE WHEN own.file IS NOT NULL THEN 'found' WHEN n = '*' THEN 'module' WHEN d = 140 THEN 'circle' ELSE 'missing' END AS state
FROM e LEFT JOIN own ON own.file = e.f AND own.name = e.n""",
}
