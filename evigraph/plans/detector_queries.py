"""Queries of the detectors: orders as routes, lines as migration steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..sources.corpus import table


def _routes(spark, sf):
    """Orders as routes of their customer's file; what they check follows their keys."""
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS file", "o_orderkey AS line", "CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'DELETE' END AS method", "concat('/', o_orderpriority, '/', o_orderkey % 100) AS path",
        "o_orderkey % 3 != 0 AS authenticated", "o_orderkey % 5 = 0 AS optional", "CASE WHEN o_orderkey % 4 != 0 THEN concat('id', o_orderkey % 2) END AS object_param", "o_orderkey % 7 = 0 AS reads_caller", "o_orderkey % 6 = 0 AS checks_caller",
    )


_ROUTES = """routes AS (SELECT o_custkey AS file, o_orderkey AS line, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'DELETE' END AS method, '/' || o_orderpriority || '/' || (o_orderkey % 100) AS path,
  o_orderkey % 3 != 0 AS authenticated, o_orderkey % 5 = 0 AS optional, CASE WHEN o_orderkey % 4 != 0 THEN 'id' || (o_orderkey % 2) END AS object_param, o_orderkey % 7 = 0 AS reads_caller, o_orderkey % 6 = 0 AS checks_caller FROM orders)"""


def _steps(spark, sf):
    """Lines as steps of migrations: the order is the file, the part the table."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS file", "l_linenumber AS line", "l_orderkey * 10 + l_linenumber AS seq", "concat('s', l_suppkey % 3, '.t', l_partkey) AS table_name", "concat('c', l_suppkey % 20) AS column_name", "l_returnflag AS flag",
        "CASE l_suppkey % 4 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'force' ELSE 'no force' END AS action", "l_linestatus = 'O' AS yes", "l_quantity",
    )


_STEPS = """steps AS (SELECT l_orderkey AS file, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS seq, 's' || (l_suppkey % 3) || '.t' || l_partkey AS table_name, 'c' || (l_suppkey % 20) AS column_name, l_returnflag AS flag,
  CASE l_suppkey % 4 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'force' ELSE 'no force' END AS action, l_linestatus = 'O' AS yes, l_quantity FROM lineitem)"""


def open_routes(spark, sf):
    return D.open_routes(_routes(spark, sf), spark.sql("SELECT '/1-URGENT/9' AS path"))


def unchecked_objects(spark, sf):
    return D.unchecked_objects(_routes(spark, sf))


def privileged_fields(spark, sf):
    s = _steps(spark, sf).select("file", "line", F.col("column_name").alias("field"), F.col("yes").alias("request"))
    return D.privileged_fields(s, spark.sql("SELECT * FROM VALUES ('c3'), ('c17'), ('c3') AS p(field)"))


def long_revisions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.lit(1).alias("line"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand").alias("revision"))
    return D.long_revisions(p, 26)


def columns_without_default(spark, sf):
    s = _steps(spark, sf)
    return D.columns_without_default(s.where("flag = 'A'").withColumns({"nullable": F.col("yes"), "has_default": F.col("l_quantity") > 40}), s.where("flag = 'N'"))


def unforced_security(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber AS line", "concat(lpad(l_orderkey, 12, '0'), lpad(l_linenumber, 3, '0'), l_partkey, '/', l_suppkey) AS seq", "l_partkey AS table_name", "CASE l_suppkey % 4 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'force' ELSE 'no force' END AS action")
    return D.unforced_security(s)


def owner_views(spark, sf):
    s = _steps(spark, sf).withColumnsRenamed({"table_name": "view", "yes": "invoker"})
    return D.owner_views(s.where("flag = 'R'"), s.where("flag = 'A' AND l_quantity > 30"))


def blocking_indexes(spark, sf):
    s = _steps(spark, sf)
    return D.blocking_indexes(s.where("flag = 'N'").withColumn("concurrently", F.col("yes")), s.where("flag = 'R'"))


def unsecured_tables(spark, sf):
    s = _steps(spark, sf)
    return D.unsecured_tables(s.where("flag = 'N'"), s.where("flag = 'R' AND l_quantity > 25"), ("s1", "s2"))


QUERIES = {f.__name__: f for f in (open_routes, unchecked_objects, privileged_fields, long_revisions, columns_without_default, unforced_security, owner_views, blocking_indexes, unsecured_tables)}

_CHANGES = "method IN ('POST', 'PUT', 'PATCH', 'DELETE')"
ORACLES = {
    "open_routes": f"""WITH {_ROUTES} SELECT CASE WHEN {_CHANGES} THEN 'security/unauthenticated-mutation-route' ELSE 'security/unauthenticated-object-read' END AS rule, CASE WHEN {_CHANGES} THEN 'high' ELSE 'medium' END AS severity,
CASE WHEN {_CHANGES} AND NOT optional THEN 'medium' ELSE 'low' END AS confidence, file, line, path AS subject FROM routes WHERE NOT authenticated AND path != '/1-URGENT/9' AND ({_CHANGES} OR object_param IS NOT NULL)""",
    "unchecked_objects": f"""WITH {_ROUTES} SELECT 'security/object-route-without-ownership-check' AS rule, 'high' AS severity, ['low', 'medium', 'high'][1 + ({_CHANGES})::INT + EXISTS (SELECT 1 FROM routes s WHERE s.checks_caller AND s.file = r.file AND s.object_param = r.object_param)::INT] AS confidence,
file, line, path AS subject FROM routes r WHERE authenticated AND object_param IS NOT NULL AND NOT reads_caller AND NOT checks_caller""",
    "privileged_fields": f"WITH {_STEPS} SELECT 'security/caller-settable-privileged-field' AS rule, 'medium' AS severity, 'medium' AS confidence, file, line, column_name AS subject FROM steps WHERE yes AND column_name IN ('c3', 'c17')",
    "long_revisions": "SELECT 'migrations/revision-id-too-long' AS rule, 'high' AS severity, 'high' AS confidence, p_partkey AS file, 1 AS line, p_name || ' ' || p_type || ' ' || p_brand AS subject FROM part WHERE length(p_name || ' ' || p_type || ' ' || p_brand) > 26",
    "columns_without_default": f"WITH {_STEPS} SELECT 'migrations/not-null-column-without-default' AS rule, 'high' AS severity, 'medium' AS confidence, file, line, table_name || '.' || column_name AS subject FROM steps WHERE flag = 'A' AND NOT yes AND l_quantity <= 40 AND (file, table_name) NOT IN (SELECT (file, table_name) FROM steps WHERE flag = 'N')",
    "unforced_security": """WITH s AS (SELECT l_orderkey AS file, l_linenumber AS line, lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 3, '0') || l_partkey || '/' || l_suppkey AS seq, l_partkey AS t, l_suppkey % 4 AS a FROM lineitem),
e AS (SELECT t, arg_max(a, seq) AS a, arg_max(file, seq) AS file, arg_max(line, seq) AS line FROM s WHERE a < 2 GROUP BY t), f AS (SELECT t, arg_max(a, seq) AS a FROM s WHERE a > 1 GROUP BY t)
SELECT 'migrations/rls-without-force' AS rule, 'medium' AS severity, 'medium' AS confidence, file, line, e.t AS subject FROM e LEFT JOIN f USING (t) WHERE e.a = 0 AND coalesce(f.a, 3) = 3""",
    "owner_views": f"WITH {_STEPS} SELECT 'migrations/view-without-security-invoker' AS rule, 'medium' AS severity, 'medium' AS confidence, file, line, table_name AS subject FROM steps WHERE flag = 'R' AND NOT yes AND table_name NOT IN (SELECT table_name FROM steps WHERE flag = 'A' AND l_quantity > 30 AND yes)",
    "blocking_indexes": f"WITH {_STEPS} SELECT DISTINCT 'migrations/index-not-concurrent' AS rule, 'low' AS severity, 'low' AS confidence, file, line, table_name AS subject FROM steps WHERE flag = 'N' AND NOT yes AND (file, table_name) NOT IN (SELECT (file, table_name) FROM steps WHERE flag = 'R')",
    "unsecured_tables": f"WITH {_STEPS} SELECT 'migrations/table-without-rls' AS rule, 'medium' AS severity, 'low' AS confidence, file, line, table_name AS subject FROM steps WHERE flag = 'N' AND (starts_with(table_name, 's1.') OR starts_with(table_name, 's2.')) AND table_name NOT IN (SELECT table_name FROM steps WHERE flag = 'R' AND l_quantity > 25 AND action = 'enable')",
}
