"""Queries on the graph of the star schema's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import KIND_COST, KIND_DEFAULT, ORIGIN_COST, ORIGIN_DEFAULT, RESOLUTION_COST, RESOLUTION_DEFAULT, stable_id
from ..operators import graph as G
from ..sources.corpus import FK_EDGES_SQL, fk_edges, table

DEPTH = 3


def _case(column: str, costs: dict, default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in costs.items()) + f" ELSE {default} END"


_COST = f"({_case('kind', KIND_COST, KIND_DEFAULT)} + {_case('resolution', RESOLUTION_COST, RESOLUTION_DEFAULT)} + {_case('origin', ORIGIN_COST, ORIGIN_DEFAULT)})"
_E = f"WITH RECURSIVE {FK_EDGES_SQL}"


def edge_dedupe_first(spark, sf):
    return G.dedupe_edges(fk_edges(spark, sf))


def node_merge(spark, sf):
    c = table(spark, sf, "customer").selectExpr("concat('n:', c_custkey) AS id", "2 * c_custkey AS seq", "IF(c_custkey % 3 = 0, '', c_name) AS label", "c_mktsegment AS segment", "CAST(NULL AS string) AS state")
    o = table(spark, sf, "orders").selectExpr("concat('n:', o_custkey) AS id", "2 * o_orderkey + 1 AS seq", "o_orderpriority AS label", "CAST(NULL AS string) AS segment", "o_orderstatus AS state")
    return G.merge_nodes(c.unionByName(o), ["label"], ["segment", "state"])


def stable_ids(spark, sf):
    p = table(spark, sf, "part").select(stable_id("symbol", F.concat("p_name", F.lit("::"), F.col("p_partkey").cast("string"))).alias("id"), F.col("p_partkey").alias("key"))
    return p.unionByName(table(spark, sf, "supplier").select(stable_id("file", F.col("s_name")).alias("id"), F.col("s_suppkey").alias("key")))


def edge_cost(spark, sf):
    return G.with_cost(fk_edges(spark, sf)).groupBy("kind", "resolution", "origin", "cost").agg(F.count("*").alias("n"))


def hub_nodes(spark, sf):
    return G.hubs(fk_edges(spark, sf))


def degree_overview(spark, sf):
    return G.overview(fk_edges(spark, sf), ["region", "nation"], 100)


def impact_min_cost(spark, sf):
    seeds = table(spark, sf, "region").where("r_regionkey = 1").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return G.min_cost_reach(fk_edges(spark, sf), seeds, DEPTH).select("id", "cost", "hops")


def _walk_sql() -> str:
    rounds = [
        f"""{FK_EDGES_SQL},
costed AS (SELECT src, dst, kind, {_COST} AS cost FROM edges),
closed AS (SELECT src FROM edges WHERE kind = 'CONTAINS' GROUP BY src HAVING count(*) > {G.HUB}),
steps AS (
  SELECT x, y, min(cost) AS cost FROM (
    SELECT src AS x, dst AS y, cost FROM costed WHERE NOT (kind = 'CONTAINS' AND src IN (SELECT src FROM closed))
    UNION ALL SELECT dst, src, cost FROM costed
  ) GROUP BY ALL
),
r0 AS (SELECT 'region:' || r_regionkey AS id, 0 AS cost, 0 AS hops FROM region WHERE r_regionkey = 1)"""
    ]
    for i in range(1, DEPTH + 1):
        rounds.append(f'r{i} AS (SELECT id, min(cost) AS cost, min(hops) AS hops FROM (SELECT * FROM r{i - 1} UNION ALL SELECT y, r.cost + s.cost, {i} FROM r{i - 1} r JOIN steps s ON s.x = r.id) GROUP BY id)')
    return "WITH " + ",\n".join(rounds) + f"\nSELECT id, cost, hops FROM r{DEPTH}"


def confident_reach(spark, sf):
    starts = table(spark, sf, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return G.reach(G.confident(fk_edges(spark, sf)), starts, 2).groupBy("start").agg(F.count("*").alias("n"), F.max("hops").alias("far"))


def import_closure_dead(spark, sf):
    e = fk_edges(spark, sf).where("resolution != 'ambiguous'")
    starts = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    nodes = table(spark, sf, "orders").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id")).unionByName(table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id")))
    return G.unreachable(nodes, e, starts)


def firm_candidates(spark, sf):
    """What the customers of a segment are tied to through guesses alone: edges that are not exact or declared count as ambiguous."""
    starts = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    guess = F.when(F.col("resolution").isin("exact", "declared"), F.col("resolution")).otherwise("ambiguous")
    return G.only_ambiguous(fk_edges(spark, sf).withColumn("resolution", guess), starts).groupBy(F.split("id", ":")[0].alias("kind")).agg(F.count("*").alias("n"))


def induced_subgraph(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"))
    return G.induced(fk_edges(spark, sf), c.unionByName(o)).select("src", "dst", "kind", "resolution")


def unverified_stores(spark, sf):
    """Orders seen as stores that their lines touch."""
    return G.unverified_stores(fk_edges(spark, sf).select(F.col("src").alias("dst"), F.col("dst").alias("src"), "kind", "origin"))


QUERIES = {
    f.__name__: f
    for f in (edge_dedupe_first, node_merge, stable_ids, edge_cost, hub_nodes, degree_overview, impact_min_cost, confident_reach, import_closure_dead, firm_candidates, induced_subgraph, unverified_stores)
}

ORACLES = {
    "edge_dedupe_first": f"{_E} SELECT src, dst, kind, evidence, arg_min(resolution, (seq, resolution, origin)) AS resolution, arg_min(origin, (seq, resolution, origin)) AS origin FROM edges GROUP BY ALL",
    "node_merge": """WITH n AS (
  SELECT 'n:' || c_custkey AS id, 2 * c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS label, c_mktsegment AS segment, NULL AS state FROM customer
  UNION ALL SELECT 'n:' || o_custkey, 2 * o_orderkey + 1, o_orderpriority, NULL, o_orderstatus FROM orders)
SELECT id, arg_min(label, seq) FILTER (WHERE label != '') AS label, arg_max(segment, seq) FILTER (WHERE segment IS NOT NULL) AS segment, arg_max(state, seq) FILTER (WHERE state IS NOT NULL) AS state FROM n GROUP BY id""",
    "stable_ids": "SELECT 'symbol:' || left(sha1('symbol:' || p_name || '::' || p_partkey), 14) AS id, p_partkey AS key FROM part UNION ALL SELECT 'file:' || left(sha1('file:' || s_name), 14), s_suppkey FROM supplier",
    "edge_cost": f"{_E} SELECT kind, resolution, origin, {_COST} AS cost, count(*) AS n FROM edges GROUP BY ALL",
    "hub_nodes": f"{_E} SELECT src AS id, count(*) AS children FROM edges WHERE kind = 'CONTAINS' GROUP BY src HAVING count(*) > {G.HUB}",
    "degree_overview": f"{_E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT id, degree FROM d ORDER BY (split_part(id, ':', 1) IN ('region', 'nation')) DESC, degree DESC, id LIMIT 100",
    "impact_min_cost": _walk_sql(),
    "confident_reach": f"""{_E}, c AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('CALLS', 'RENDERS', 'DEFINES') AND resolution IN ('exact', 'high', 'declared')),
w AS (SELECT 'customer:' || c_custkey AS start, 'customer:' || c_custkey AS id, 0 AS hops FROM customer UNION SELECT w.start, c.dst, hops + 1 FROM w JOIN c ON c.src = w.id WHERE hops < 2),
m AS (SELECT start, id, min(hops) AS hops FROM w GROUP BY ALL) SELECT start, count(*) AS n, max(hops) AS far FROM m GROUP BY start""",
    "import_closure_dead": f"""{_E}, w AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT e.dst FROM w JOIN edges e ON e.src = w.id AND e.resolution != 'ambiguous')
SELECT id FROM (SELECT 'orders:' || o_orderkey AS id FROM orders UNION ALL SELECT 'part:' || p_partkey FROM part) n WHERE id NOT IN (SELECT id FROM w)""",
    "firm_candidates": f"""{_E}, g AS (SELECT DISTINCT src, dst, resolution IN ('exact', 'declared') AS firm FROM edges), b AS (SELECT * FROM g UNION SELECT dst, src, firm FROM g),
s AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
a AS (SELECT id FROM s UNION SELECT b.dst FROM a JOIN b ON b.src = a.id), f AS (SELECT id FROM s UNION SELECT b.dst FROM f JOIN b ON b.src = f.id AND b.firm)
SELECT split_part(id, ':', 1) AS kind, count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM f) GROUP BY 1""",
    "induced_subgraph": f"""{_E}, s AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'orders:' || o_orderkey FROM orders WHERE o_totalprice > 200000)
SELECT src, dst, kind, resolution FROM edges WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""",
    "unverified_stores": f"{_E} SELECT src AS store, count(*) AS n FROM edges WHERE kind = 'TOUCHES_STORE' GROUP BY src HAVING bool_and(origin = 'regex')",
}
