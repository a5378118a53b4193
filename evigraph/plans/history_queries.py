"""Queries about exposure of files and the history of schemas, over parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure as X
from ..operators import schema_history as H
from ..sources.corpus import table


def _tree(spark, sf):
    """Parts as files: a file imports those with three times its key, and one more; some also the one before."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_size AS bigint) AS size", "p_brand AS brand")
    files = p.selectExpr("id", "size % 3 = 0 AS routes", "id % 41 = 2 AS app", "id % 97 = 5 AS entry", "false AS dynamic")
    imports = p.selectExpr("id AS src", "explode(array(id * 3, id * 3 + 1)) AS dst").unionByName(p.where("id % 11 = 0").selectExpr("id AS src", "id - 1 AS dst"))
    return files, imports


def _manifests(spark, sf, blocked):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS manifest", "s_suppkey * 7 AS id", "s_nationkey % 5 = 0 AS auxiliary", "s_nationkey % 2 = 0 AS server")
    return s.withColumn("blocking", F.col("manifest") == 1 if blocked else F.lit(False))


def liveness_reasons(spark, sf):
    files, imports = _tree(spark, sf)
    return X.liveness(files, imports, files.where("app OR entry")).withColumnRenamed("id", "file_id")


def route_exposure(spark, sf):
    files, imports = _tree(spark, sf)
    return X.route_exposure(files, imports, _manifests(spark, sf, False)).withColumnRenamed("id", "file_id")


def route_exposure_unknown(spark, sf):
    """As ``route_exposure``, with a manifest that cannot be read: nothing is called undeployed."""
    files, imports = _tree(spark, sf)
    return X.route_exposure(files, imports, _manifests(spark, sf, True)).withColumnRenamed("id", "file_id")


def exposure_demotion(spark, sf):
    """Findings, one a line of an order, in files that are parts: how many have which exposure and remark."""
    files, imports = _tree(spark, sf)
    exposed = X.route_exposure(files, imports, _manifests(spark, sf, False))
    findings = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.lit("authenticated").alias("exposure"), F.concat(F.lit("flag "), "l_returnflag").alias("message"))
    return X.demote(findings, exposed).groupBy("exposure", "message").agg(F.count("*").alias("n"))


def _changes(spark, sf):
    """Events of a user as changes of a table, in their order."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    kinds = "CASE event_type WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'create' ELSE 'add' END WHEN 'click' THEN 'rename' WHEN 'error' THEN CASE WHEN k % 23 = 0 THEN 'reshape' ELSE 'drop' END END AS kind"
    changes = e.where("event_type IN ('signup', 'click', 'error')").selectExpr(
        "concat('p', user_id % 2) AS package", "concat('t', user_id) AS table_name", "event_id AS seq", kinds,
        "CASE WHEN k % 17 != 0 THEN transform(filter(sequence(0, 9), x -> (x + k) % 3 != 0), x -> concat('c', x)) END AS columns",
        "concat('c', k % 10) AS column_name", "concat('c', (k + 3) % 10) AS new_name", "CASE k % 13 WHEN 0 THEN 'tests/x.sql' WHEN 1 THEN concat('ddl', user_id % 5, '.sql') ELSE 'db/schema.sql' END AS path",
    )
    refs = e.where("event_type IN ('view', 'purchase')").selectExpr(
        "event_id AS ref_id", "concat('p', user_id % 2) AS package", "concat('t', user_id) AS table_name", "CASE WHEN k % 31 = 0 THEN 'xmin' ELSE concat('c', k % 12) END AS column_name", "event_id AS seq",
        "CASE k % 19 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'db/migrations/1.sql' WHEN 2 THEN concat('ddl', user_id % 5, '.sql') ELSE 'app/a.py' END AS path",
        "CASE WHEN k % 5 = 0 THEN array(concat('t', user_id + 2)) WHEN k % 5 = 1 THEN array('nowhere') END AS outer_tables", "k % 29 = 0 AS redirected",
    )
    return changes, refs


def column_intervals(spark, sf):
    columns, _ = H.column_intervals(_changes(spark, sf)[0])
    return columns


def reference_verdicts(spark, sf):
    """Every reference, judged by what its table was when it was made."""
    changes, refs = _changes(spark, sf)
    foreign = spark.sql("SELECT 't7' AS table_name")
    return H.judge_references(refs, changes, foreign)


QUERIES = {f.__name__: f for f in (liveness_reasons, route_exposure, route_exposure_unknown, exposure_demotion, column_intervals, reference_verdicts)}

_TREE_SQL = """f AS (SELECT p_partkey AS id, p_size % 3 = 0 AS routes, p_partkey % 41 = 2 AS app, p_partkey % 97 = 5 AS entry FROM part),
e AS (SELECT * FROM (SELECT id AS src, unnest([id * 3, id * 3 + 1]) AS dst FROM f UNION ALL SELECT id, id - 1 FROM f WHERE id % 11 = 0) WHERE dst IN (SELECT id FROM f) AND src != dst),
seen AS (SELECT id FROM f WHERE app OR entry UNION SELECT dst FROM seen JOIN e ON src = id),
by_ AS (SELECT dst AS id, min(src) AS m FROM e GROUP BY dst),
dead AS (SELECT f.id, coalesce(m::VARCHAR, 'nothing imports it') AS reason FROM f LEFT JOIN by_ USING (id) WHERE f.id NOT IN (SELECT id FROM seen))"""
_LIVE_SQL = """t AS (SELECT s_suppkey AS manifest, s_suppkey * 7 AS id, s_nationkey % 5 = 0 AS aux, s_nationkey % 2 = 0 AS server FROM supplier),
live AS (SELECT id FROM f WHERE entry OR id IN (SELECT id FROM t) UNION SELECT dst FROM live JOIN e ON src = id),
said AS (SELECT min([manifest, id]) AS m FROM t WHERE NOT aux AND (server OR id IN (SELECT id FROM f WHERE app OR entry)) AND id IN (SELECT id FROM f))"""
_EXPOSED_SQL = """SELECT id AS file_id, 'unreachable' AS exposure, reason FROM dead WHERE id IN (SELECT id FROM f WHERE routes)"""
_UNDEPLOYED_SQL = """SELECT id, 'undeployed', m[1] || ' runs ' || m[2] FROM f, said WHERE routes AND m IS NOT NULL AND id IN (SELECT id FROM seen) AND id NOT IN (SELECT id FROM live)"""
_CHANGES_SQL = """ev AS (SELECT event_id, user_id, event_type, (props ->> '$.k')::BIGINT AS k FROM events),
ch AS (SELECT 'p' || (user_id % 2) AS package, 't' || user_id AS t, event_id AS seq,
    CASE event_type WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'create' ELSE 'add' END WHEN 'click' THEN 'rename' WHEN 'error' THEN CASE WHEN k % 23 = 0 THEN 'reshape' ELSE 'drop' END END AS kind,
    CASE WHEN k % 17 != 0 THEN list_transform(list_filter(range(10), lambda x: (x + k) % 3 != 0), lambda x: 'c' || x) END AS cols, 'c' || (k % 10) AS c, 'c' || ((k + 3) % 10) AS c2,
    CASE k % 13 WHEN 0 THEN 'tests/x.sql' WHEN 1 THEN 'ddl' || (user_id % 5) || '.sql' ELSE 'db/schema.sql' END AS path FROM ev WHERE event_type IN ('signup', 'click', 'error'))"""
ORACLES = {
    "liveness_reasons": f"WITH RECURSIVE {_TREE_SQL} SELECT id AS file_id, 'reached' AS state, NULL::VARCHAR AS reason FROM seen UNION ALL SELECT id, 'dead', reason FROM dead",
    "route_exposure": f"WITH RECURSIVE {_TREE_SQL}, {_LIVE_SQL} {_EXPOSED_SQL} UNION ALL {_UNDEPLOYED_SQL}",
    "route_exposure_unknown": f"WITH RECURSIVE {_TREE_SQL} {_EXPOSED_SQL}",
    "exposure_demotion": f"""WITH RECURSIVE {_TREE_SQL}, {_LIVE_SQL}, x AS ({_EXPOSED_SQL} UNION ALL {_UNDEPLOYED_SQL})
SELECT coalesce(exposure, 'authenticated') AS exposure, 'flag ' || l_returnflag || CASE exposure WHEN 'unreachable' THEN '{X.UNREACHABLE_NOTE}' WHEN 'undeployed' THEN replace('{X.UNDEPLOYED_NOTE}', '{{}}', reason) ELSE '' END AS message, count(*) AS n
FROM lineitem LEFT JOIN x ON file_id = l_partkey GROUP BY ALL""",
    "column_intervals": f"""WITH {_CHANGES_SQL},
o AS (SELECT package, t, seq, unnest(cols) AS c, true AS open FROM ch WHERE kind = 'create' UNION ALL SELECT package, t, seq, CASE kind WHEN 'add' THEN c ELSE c2 END, true FROM ch WHERE kind IN ('add', 'rename')
  UNION ALL SELECT package, t, seq, c, false FROM ch WHERE kind IN ('drop', 'rename')),
s AS (SELECT package, t, c, seq, bool_or(open) AS open FROM o GROUP BY ALL)
SELECT package, t AS table_name, c AS column_name, seq AS since, least(
    (SELECT min(n.seq) FROM s n WHERE n.package = s.package AND n.t = s.t AND n.c = s.c AND n.seq > s.seq), (SELECT min(n.seq) FROM ch n WHERE n.package = s.package AND n.t = s.t AND n.kind = 'create' AND n.seq > s.seq)) AS until FROM s WHERE open""",
    "reference_verdicts": f"""WITH {_CHANGES_SQL}, known AS (SELECT * FROM ch WHERE path NOT LIKE 'tests/%'),
r AS (SELECT event_id AS id, 'p' || (user_id % 2) AS package, 't' || user_id AS t, CASE WHEN k % 31 = 0 THEN 'xmin' ELSE 'c' || (k % 12) END AS c, CASE k % 19 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'db/migrations/1.sql' WHEN 2 THEN 'ddl' || (user_id % 5) || '.sql' ELSE 'app/a.py' END AS path,
    CASE WHEN k % 5 = 0 THEN ['t' || (user_id + 2)] WHEN k % 5 = 1 THEN ['nowhere'] ELSE [] END AS outers, k % 29 = 0 AS redirected FROM ev WHERE event_type IN ('view', 'purchase')),
a AS (SELECT id, package, t, c, 0 AS depth FROM r UNION ALL SELECT id, package, unnest(outers), c, 1 FROM r),
s AS (SELECT a.*, max(h.seq) FILTER (WHERE kind = 'create') AS made, max(h.seq) FILTER (WHERE kind = 'reshape') AS shaped, arg_max(h.cols, h.seq) FILTER (WHERE kind = 'create' AND h.cols IS NOT NULL) AS cols,
    max(h.seq) FILTER (WHERE kind = 'create' AND h.cols IS NOT NULL) AS made_known, max(h.seq) FILTER (WHERE (kind = 'add' AND h.c = a.c) OR (kind = 'rename' AND h.c2 = a.c)) AS opened,
    max(h.seq) FILTER (WHERE kind IN ('drop', 'rename') AND h.c = a.c AND NOT (kind = 'rename' AND h.c2 = a.c)) AS closed
  FROM a LEFT JOIN known h ON h.package = a.package AND h.t = a.t AND h.seq <= a.id GROUP BY ALL),
v AS (SELECT *, made IS NOT NULL OR shaped IS NOT NULL AS there, coalesce(made = made_known AND (shaped IS NULL OR shaped < made), false) AS known,
    CASE WHEN coalesce(opened, -1) > greatest(coalesce(closed, -1), coalesce(made, -1)) THEN true WHEN coalesce(closed, -1) > coalesce(made, -1) THEN false ELSE coalesce(made = made_known AND list_contains(cols, c), false) END AS has FROM s),
w AS (SELECT id, bool_or(there) FILTER (WHERE depth = 0) AS there, bool_or(known) FILTER (WHERE depth = 0) AS known, bool_or(has) FILTER (WHERE depth = 0) AS has, coalesce(bool_or(NOT known OR has) FILTER (WHERE depth = 1), false) AS outer_ FROM v GROUP BY id)
SELECT id AS ref_id, CASE WHEN c = 'xmin' THEN 'system' WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE 'db/migrations/%' THEN 'migration' WHEN (path, t) IN (SELECT (path, t) FROM ch) THEN 'own_ddl' WHEN redirected THEN 'redirected' WHEN t = 't7' THEN 'foreign'
  WHEN NOT there THEN 'no_table' WHEN NOT known THEN 'opaque' WHEN has THEN 'declared' WHEN outer_ THEN 'outer' ELSE 'unknown' END AS verdict FROM r JOIN w USING (id)""",
}
