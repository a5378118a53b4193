"""The driver's tables as evidence: a graph over their foreign keys, findings from events, routes from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Events before this count as the baseline.
CUTOFF = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Unions of the session no longer take over the partitioning of their parts: where a part's joins are planned anew at run time, Spark 4.1 now and then
    zips parts of unequal numbers of partitions and fails."""
    ship(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges src, dst, kind, resolution, evidence, origin and the emission order ``seq`` over the star schema. Keys may repeat."""
    t = lambda name: table(spark, sf_dir, name)

    def edges(df: DataFrame, src: str, dst: str, kind: str, resolution: str, evidence: str, origin: str, seq: str) -> DataFrame:
        return df.selectExpr(f"{src} AS src", f"{dst} AS dst", f"'{kind}' AS kind", f"{resolution} AS resolution", f"{evidence} AS evidence", f"{origin} AS origin", f"{seq} AS seq")

    lines = t("lineitem")
    parts = [
        edges(t("nation"), "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)", "REFERENCES", "'exact'", "'nation'", "'ast'", "CAST(n_nationkey AS bigint)"),
        edges(t("customer"), "concat('nation:', c_nationkey)", "concat('customer:', c_custkey)", "CONTAINS", "'declared'", "'customer'", "'policy'", "c_custkey"),
        edges(t("supplier"), "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)", "IMPORTS", "'exact'", "'supplier'", "'import_binding'", "s_suppkey"),
        edges(
            t("orders"), "concat('customer:', o_custkey)", "concat('orders:', o_orderkey)", "CALLS", "CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'probable' ELSE 'ambiguous' END", "'orders'",
            "'name_resolution'", "o_orderkey",
        ),
        edges(
            lines, "concat('orders:', l_orderkey)", "concat('part:', l_partkey)", "TOUCHES_STORE", "CASE l_returnflag WHEN 'R' THEN 'exact' WHEN 'A' THEN 'declared' ELSE 'heuristic' END",
            "concat('line:', l_linenumber)", "CASE WHEN l_linestatus = 'O' THEN 'regex' ELSE 'ast' END", "CAST(l_extendedprice * 100 AS bigint)",
        ),
        edges(lines, "concat('part:', l_partkey)", "concat('supplier:', l_suppkey)", "RENDERS", "'ambiguous'", "'lineitem'", "'heuristic'", "CAST(l_extendedprice * 100 AS bigint)"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FK_EDGES_SQL = """
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'REFERENCES' AS kind, 'exact' AS resolution, 'nation' AS evidence, 'ast' AS origin, n_nationkey::BIGINT AS seq FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', 'declared', 'customer', 'policy', c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IMPORTS', 'exact', 'supplier', 'import_binding', s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'CALLS', CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'probable' ELSE 'ambiguous' END, 'orders', 'name_resolution', o_orderkey FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'TOUCHES_STORE', CASE l_returnflag WHEN 'R' THEN 'exact' WHEN 'A' THEN 'declared' ELSE 'heuristic' END, 'line:' || l_linenumber,
                   CASE WHEN l_linestatus = 'O' THEN 'regex' ELSE 'ast' END, trunc(l_extendedprice * 100)::BIGINT FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'RENDERS', 'ambiguous', 'lineitem', 'heuristic', trunc(l_extendedprice * 100)::BIGINT FROM lineitem
)"""


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings tool, rule, severity, confidence, exposure, category, message, file, line, counts_matter, ts from events."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "'events' AS tool", "event_type AS rule",
        "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity",
        "CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS confidence",
        "CASE user_id % 6 WHEN 0 THEN 'unauthenticated' WHEN 1 THEN 'authenticated' WHEN 2 THEN 'internal' WHEN 3 THEN 'undeployed' WHEN 4 THEN 'unreachable' ELSE '' END AS exposure",
        "CASE WHEN event_type IN ('error', 'purchase') THEN 'security' ELSE 'usage' END AS category",
        "concat(event_type, ' seen with ', get_json_object(props, '$.k'), ' keys') AS message",
        "concat('user/', user_id) AS file", "CAST(event_id % 500 AS int) AS line", "event_type = 'error' AS counts_matter", "ts",
    )


EVENT_FINDINGS_SQL = """
raw AS (
  SELECT event_id, 'events' AS tool, event_type AS rule,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
         CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS confidence,
         CASE user_id % 6 WHEN 0 THEN 'unauthenticated' WHEN 1 THEN 'authenticated' WHEN 2 THEN 'internal' WHEN 3 THEN 'undeployed' WHEN 4 THEN 'unreachable' ELSE '' END AS exposure,
         CASE WHEN event_type IN ('error', 'purchase') THEN 'security' ELSE 'usage' END AS category,
         event_type || ' seen with ' || (props ->> '$.k') || ' keys' AS message, 'user/' || user_id AS file, (event_id % 500)::INT AS line, event_type = 'error' AS counts_matter, ts
  FROM events
)"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, method and path of every page; the id in a path is a literal segment."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path",
        "CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END AS method",
    )


PAGE_ROUTES_SQL = """
routes AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END AS method FROM pages
)"""
