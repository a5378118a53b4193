"""Queries about what plugins propose: each order is a file, its lines are nodes, edges and issues, some of which break a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plugins as P
from ..sources.corpus import table

#: Orders with more lines are too long for the queries, which stand for files with too many records.
MOST = 18


def _proposed(spark, sf):
    """Three records per line: a node of the line, an edge from it to its part, an issue about it. Parts are in the graph but for one in 400."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS l", "l_partkey AS p")
    line = "concat('line:', o, ':', l)"
    path = "CASE WHEN o % 97 = 0 AND l = 1 THEN '../out' WHEN o % 89 = 0 THEN NULL ELSE concat('lines/', l) END"
    node = {"id": f"CASE WHEN o % 50 = 7 AND l = 1 THEN 'shared' ELSE {line} END", "kind": "'line'", "label": "CASE WHEN o % 50 = 7 AND l = 1 THEN concat('l', o % 3) ELSE 'l' END", "path": path, "metadata": "CASE WHEN o % 83 = 0 THEN '{' ELSE '{\"a\": 1}' END"}
    edge = {"src": line, "dst": "concat('part:', p)", "kind": "'USES'", "resolution": "CASE WHEN o % 79 = 0 AND l = 2 THEN 'sure' ELSE 'exact' END", "evidence": "'line'"}
    issue = {"severity": "CASE WHEN o % 73 = 0 THEN 'odd' ELSE 'info' END", "message": "'m'", "evidence": "'e'", "recommendation": "'r'", "node_ids": "array(concat('part:', p))"}
    null = {**{c: "CAST(NULL AS string)" for c in P.FIELDS}, "node_ids": "CAST(NULL AS array<string>)"}
    # the records of a line leave one task, as those of a file that an extractor reads
    each = ", ".join(f"named_struct('record', '{what}', {', '.join(f"'{c}', {v}" for c, v in {**null, **own}.items())})" for what, own in ((P.NODE, node), (P.EDGE, edge), (P.ISSUE, issue)))
    records = lines.selectExpr("o", "l", "concat('o', o) AS file", f"inline(array({each}))").where(f"record != '{P.EDGE}' OR l != 1 OR o % 50 != 7")
    known = table(spark, sf, "part").where("p_partkey % 400 != 3").selectExpr("concat('part:', p_partkey) AS id", "'part' AS kind", "p_name AS label", "CAST(NULL AS string) AS path")
    return records.select("file", "record", *P.FIELDS, "node_ids"), known


def plugin_withdrawn(spark, sf):
    """Files whose records are refused, and why."""
    records, known = _proposed(spark, sf)
    return P.withdrawn(records, known, MOST)


def plugin_entered(spark, sf):
    """How many records of each kind enter the graph from each file."""
    records, known = _proposed(spark, sf)
    entered, _ = P.commit(records, known, "lines", "1", MOST)
    return entered.where("id IS NULL OR id != 'shared'").groupBy("file", "record", "origin").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (plugin_withdrawn, plugin_entered)}

_OUT_SQL = f"""WITH x AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_orderkey % 50 = 7 AS odd FROM lineitem),
k AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 400 != 3),
t AS (SELECT o, count(*) * 2 + count(*) FILTER (WHERE l != 1 OR NOT odd) > {MOST} AS long FROM x GROUP BY o),
r AS (SELECT o, 'too many records' AS reason FROM t WHERE long
  UNION ALL SELECT o, CASE WHEN o % 83 = 0 AND (o % 97 != 0 OR bool_or(l != 1)) THEN 'metadata is no JSON' WHEN o % 97 = 0 AND bool_or(l = 1) THEN 'path outside the tree' WHEN o % 79 = 0 AND bool_or(l = 2) THEN 'unknown resolution' WHEN o % 73 = 0 THEN 'unknown severity' END
    FROM x JOIN t USING (o) WHERE NOT long GROUP BY o
  UNION ALL SELECT o, 'names an unknown node' FROM x WHERE p NOT IN (SELECT p FROM k)),
f AS (SELECT o, min(reason) AS reason FROM r WHERE reason IS NOT NULL GROUP BY o),
s AS (SELECT DISTINCT 'o' || o AS file, o, 'l' || (o % 3) || CASE WHEN o % 89 = 0 THEN 'n' ELSE '' END AS label FROM x WHERE odd AND l = 1 AND o NOT IN (SELECT o FROM f)),
w AS (SELECT 'o' || o AS file, reason FROM f UNION ALL SELECT file, 'another file describes the node first' FROM s WHERE label != (SELECT arg_min(label, file) FROM s))"""
ORACLES = {
    "plugin_withdrawn": f"{_OUT_SQL} SELECT file, reason FROM w",
    "plugin_entered": f"""{_OUT_SQL}, y AS (SELECT 'o' || o AS file, * FROM x WHERE 'o' || o NOT IN (SELECT file FROM w))
SELECT file, record, 'plugin:lines@1' AS origin, count(*) AS n FROM (SELECT DISTINCT file, 'node' AS record, l FROM y WHERE NOT (odd AND l = 1) UNION ALL SELECT file, 'edge', l FROM y WHERE l != 1 OR NOT odd UNION ALL SELECT file, 'issue', l FROM y) GROUP BY file, record""",
}
