"""Queries of small relational operators: links, gaps, choices, sets and budgets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.scalars import is_test_code, is_test_path
from ..operators import links as L
from ..sources.corpus import table


def result_ordinals(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("tool"), F.col("user_id").alias("fp"))
    return L.ordinals(e, ["tool", "fp"], "event_id").select("event_id", F.col("ordinal").cast("long").alias("ordinal"))


def views_never_fixed(spark, sf):
    """Users whose views no purchase answers."""
    e = table(spark, sf, "events")
    return L.without_fix(e.where("event_type = 'view'").select("event_id", "user_id"), e.where("event_type = 'purchase'").select("user_id"), ["user_id"]).select("event_id", "user_id")


def enclosing_definitions(spark, sf):
    """Orders as definitions of a customer's file, from a line that follows their key, and events as uses of lines of the user's file."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("path"), F.col("o_orderkey").alias("name"), F.expr("o_orderkey * 37 % 5000").alias("first"), F.expr("o_orderkey * 37 % 5000 + o_orderkey * 11 % 900").alias("last"))
    u = table(spark, sf, "events").select("event_id", (F.col("user_id") % 40).alias("path"), F.expr("event_id * 13 % 6000").alias("line"))
    return L.enclosing(u, o).select("event_id", "name")


def last_binding(spark, sf):
    """What an event's user had ordered last by then: the latest binding of a name at or before a place."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("target"))
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return L.latest_before(e, o, ["user_id"], "ts", "target").select("event_id", "target")


def row_budget(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.count("*").alias("n"))
    return L.row_budget(n, 60, ["name"])


def first_of_equal(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey")
    return L.first_of(o, ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"])


def architecture_groups(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("pages"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("files"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    both = n.join(c, "k", "left").join(s, "k", "left").select("name", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("files", F.lit(0)).alias("files"))
    return L.ranked(both, ["pages", "files"], "name", 10)


def best_tag(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("evidence"))
    return L.best_tag(o.withColumn("layer", F.length("tag") % 3))


def added_and_gone(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return L.changed(o.where("status = 'F'"), o.where("status = 'O'"), "key")


def shared_stores(spark, sf):
    u = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).select(F.col("l_suppkey").alias("key"), F.concat_ws("/", "p_brand", "p_type").alias("store"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return L.shared_stores(u, s).select("a", "b", F.col("both").cast("long").alias("both"), F.col("either").cast("long").alias("either"))


def common_items(spark, sf):
    """Brands that every supplier of a nation delivers."""
    u = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return L.common_items(u, "s_nationkey", "s_suppkey", "p_brand")


def stale_exemptions(spark, sf):
    """Customers without orders, as exemptions that nothing needs."""
    return L.without_fix(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), ["key"])


def map_state(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.length("text").cast("long").alias("hash"))
    w = d.where("path % 7 != 0").unionByName(table(spark, sf, "labels").select((F.col("doc_id") + 1000000).alias("path"), F.lit(0).cast("long").alias("hash")).distinct())
    return L.map_state(d, w.select("path", F.when(F.col("path") % 5 == 0, F.col("hash") + 1).otherwise(F.col("hash")).alias("hash")))


def _store_lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("store"), F.col("l_suppkey").alias("artifact"), (F.col("l_linestatus") == "O").alias("pattern"), "l_quantity")


def known_elsewhere(spark, sf):
    lines = _store_lines(spark, sf)
    return L.known_elsewhere(lines.where("pattern").select("source", "store").distinct(), lines.where("NOT pattern AND l_quantity > 48"))


def unconfirmed_stores(spark, sf):
    lines = _store_lines(spark, sf)
    return L.unconfirmed(lines.where("pattern"), lines.where("NOT pattern AND l_quantity > 40"), "artifact")


def owned_symbols(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("concept"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("owner"), F.lit("red widget").alias("symbol"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    return L.owned_symbols(s, p)


def function_context(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    t = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("t"), "p_type", F.lit("-"), F.col("p_size").cast("string")).alias("test"))
    u = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").cast("string").alias("store"))
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("commits"))
    return L.with_tests_and_stores(p, t, u, c).select("key", F.array_join("tests", ",").alias("tests"), F.array_join("stores", ",").alias("stores"), "commits")


def related_files(spark, sf):
    """Customers' nations and those of the suppliers of their lines: which nations are tied most."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    near = table(spark, sf, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_regionkey").alias("other"))
    return L.related([l.select(F.col("c_nationkey").alias("path"), F.col("s_nationkey").alias("other")), near], 3)


def issue_locations(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("o/"), (F.col("o_orderkey") % 50).cast("string"))).alias("path"), (F.col("o_orderkey") % 400).cast("int").alias("line"))
    issues = table(spark, sf, "events").select(F.col("event_id").alias("issue"), F.concat(F.lit("o/"), (F.col("event_id") % 60).cast("string"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(":"), (F.col("event_id") % 90).cast("string"))).otherwise("")).alias("evidence"), F.array(F.col("event_id") % 997, F.col("event_id") % 499 + 1).alias("node_ids"))
    return L.issue_locations(issues, nodes)


def unexamined_inputs(spark, sf):
    skipped = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path"), F.lower("c_mktsegment").alias("status"))
    return L.unexamined(skipped, table(spark, sf, "orders").select(F.col("o_orderpriority").alias("check"), F.col("o_custkey").alias("path")).distinct(), 4)


def index_counts(spark, sf):
    p = table(spark, sf, "part")
    f = p.select(F.when(F.col("p_size") % 3 == 0, "python").otherwise("typescript").alias("language"), (F.col("p_size") > 20).alias("routed"), (F.col("p_retailprice") > 1000).alias("guarded"), (F.col("p_partkey") % 4).alias("tests"), (F.col("p_partkey") % 3).alias("homonyms"), F.col("p_name").alias("key"))
    return L.index_counts(f)


def missing_per_file(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), (F.col("o_orderstatus") == "F").alias("documented"))
    failed = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    return L.missing_per_file(s, failed, table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 7).alias("n")))


def group_evidence(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 100).alias("target"))
    g = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 100).alias("target"))
    return L.group_evidence(l, g)


def grouped_references(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_suppkey")).alias("location"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("table_name"), F.concat(F.lit("c"), (F.col("l_partkey") % 9).cast("string")).alias("column_name"))
    return L.grouped_references(r)


def affected_artefacts(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("path"))
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("tag"))
    m = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tag"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("artefact")).distinct()
    return L.affected(c, t, m)


def declared_consumers(spark, sf):
    o = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("concept"), F.col("s_suppkey").alias("owner"), F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") * 2, F.col("s_suppkey") + 1).alias("consumers"))
    return L.declared_consumers(o, table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("path")))


def issues_as_findings(spark, sf):
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "view", "info").otherwise("other")
    f = L.issues_as_findings(e.select(F.upper("event_type").alias("code"), level.alias("severity"), F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.lit("m").alias("message")))
    return f.groupBy("tool", "rule", "severity", "confidence", "category").agg(F.count("*").alias("n"))


def path_tests(spark, sf):
    """Paths made of part names and brands: which are tests, fixtures, migrations."""
    p = table(spark, sf, "part")
    top = F.element_at(F.array(*map(F.lit, ("src", "tests", "spec", "alembic", "app/migrations", "Cypress", "testdata", "lib"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("test_x.py", "x_test.py", "x.spec.mjs", "x.test.tsx", "versions/x.py", "x.cy.ts", "conftest.py", "latest.py", "x.sql"))), (F.col("p_size") % 9 + 1).cast("int"))
    path = F.concat(top, F.lit("/"), name)
    return p.select("p_partkey", is_test_path(path).alias("test"), is_test_code(path).alias("code"), P.is_migration_path(path).alias("migration"))


def names_and_plurals(spark, sf):
    p = table(spark, sf, "part")
    camel = F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return p.select("p_partkey", P.snake(camel).alias("snake"), P.pluralize(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("plural"), P.with_api_prefix(F.concat(F.when(F.col("p_size") % 2 == 0, "/api/").otherwise("x/"), "p_brand"), "api").alias("route"), P.evidence_path(F.concat_ws(":", "p_brand", F.col("p_size").cast("string"))).alias("path"), P.openapi_path(F.lit("/a/{dynamic}/b/{dynamic}")).alias("template"))


QUERIES = {
    f.__name__: f
    for f in (
        result_ordinals, views_never_fixed, enclosing_definitions, last_binding, row_budget, first_of_equal, architecture_groups, best_tag, added_and_gone, shared_stores, common_items, stale_exemptions, map_state,
        known_elsewhere, unconfirmed_stores, owned_symbols, function_context, related_files, issue_locations, unexamined_inputs, index_counts, missing_per_file, group_evidence, grouped_references,
        affected_artefacts, declared_consumers, issues_as_findings, path_tests, names_and_plurals,
    )
}

_NAMES = ("test_x.py", "x_test.py", "x.spec.mjs", "x.test.tsx", "versions/x.py", "x.cy.ts", "conftest.py", "latest.py", "x.sql")
ORACLES = {
    "result_ordinals": "SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS ordinal FROM events",
    "views_never_fixed": "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "enclosing_definitions": """WITH d AS (SELECT o_custkey % 40 AS path, o_orderkey AS name, o_orderkey * 37 % 5000 AS f, o_orderkey * 37 % 5000 + o_orderkey * 11 % 900 AS l FROM orders), u AS (SELECT event_id, user_id % 40 AS path, event_id * 13 % 6000 AS line FROM events)
SELECT event_id, arg_min(name, (-f, l, name)) AS name FROM u LEFT JOIN d ON d.path = u.path AND line BETWEEN f AND l GROUP BY event_id""",
    "last_binding": "SELECT event_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS target FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id",
    "row_budget": "WITH n AS (SELECT c_nationkey AS name, count(*) AS n FROM customer GROUP BY 1) SELECT name, n, least(n, greatest(0, 60 - coalesce(sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS shown FROM n",
    "first_of_equal": "SELECT o_custkey, o_orderstatus, min(o_totalprice) AS o_totalprice, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL",
    "architecture_groups": "SELECT * FROM (SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pages, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS files FROM nation) ORDER BY pages + files DESC, name LIMIT 10",
    "best_tag": "WITH t AS (SELECT o_custkey AS path, o_orderpriority AS tag, count(*) AS e FROM orders GROUP BY ALL) SELECT path, arg_min(tag, (-e, length(tag) % 3, tag)) AS tag FROM t GROUP BY path",
    "added_and_gone": "WITH f AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O') SELECT key, 'gone' AS change FROM f WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, 'added' FROM o WHERE key NOT IN (SELECT key FROM f)",
    "shared_stores": "WITH u AS (SELECT l_suppkey AS key, list_distinct(list(p_brand || '/' || p_type)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT a.key AS a, b.key AS b, len(list_intersect(a.s, b.s)) AS both, len(list_distinct(list_concat(a.s, b.s))) AS either FROM u a JOIN u b ON b.key = a.key + 1",
    "common_items": "WITH u AS (SELECT DISTINCT s_nationkey, s_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), m AS (SELECT s_nationkey, count(DISTINCT s_suppkey) AS m FROM u GROUP BY 1) SELECT s_nationkey, p_brand FROM u JOIN m USING (s_nationkey) GROUP BY s_nationkey, p_brand, m HAVING count(*) = m",
    "stale_exemptions": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "map_state": """WITH d AS (SELECT doc_id AS path, length(text) AS hash FROM documents), x AS (SELECT * FROM d WHERE path % 7 != 0 UNION ALL SELECT DISTINCT doc_id + 1000000, 0 FROM labels), e AS (SELECT path, CASE WHEN path % 5 = 0 THEN hash + 1 ELSE hash END AS hash FROM x)
SELECT coalesce(d.path, e.path) AS path, CASE WHEN e.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'orphan' ELSE 'stale' END AS state FROM d FULL JOIN e ON d.path = e.path WHERE d.path IS NULL OR e.path IS NULL OR d.hash != e.hash""",
    "known_elsewhere": "SELECT DISTINCT l_orderkey AS source, l_partkey AS store FROM lineitem WHERE l_linestatus = 'O' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus != 'O' AND l_quantity > 48)",
    "unconfirmed_stores": "SELECT l_suppkey AS artifact, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus != 'O' AND l_quantity > 40) GROUP BY 1",
    "owned_symbols": "SELECT DISTINCT s_suppkey AS concept, p_partkey AS target FROM supplier JOIN part ON p_name = 'red widget' AND p_brand = 'Brand#' || (s_suppkey % 5 + 1)",
    "function_context": """WITH t AS (SELECT DISTINCT p_name AS name, 't' || p_type || '-' || p_size AS test FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY test) AS place FROM t), s AS (SELECT name, string_agg(test, ',' ORDER BY test) AS tests FROM f WHERE place <= 12 GROUP BY 1),
u AS (SELECT l_partkey AS key, array_to_string(list_sort(list_distinct(list(l_suppkey::VARCHAR))), ',') AS stores FROM lineitem GROUP BY 1), c AS (SELECT p_brand, count(*) AS commits FROM part GROUP BY 1)
SELECT p_partkey AS key, coalesce(tests, '') AS tests, coalesce(stores, '') AS stores, commits FROM part LEFT JOIN s ON s.name = p_name LEFT JOIN u ON u.key = p_partkey LEFT JOIN c USING (p_brand)""",
    "related_files": """WITH l AS (SELECT c_nationkey AS path, s_nationkey AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT n_nationkey, n_regionkey FROM nation)
SELECT * FROM (SELECT path, other, count(*) AS n FROM l WHERE path != other GROUP BY path, other) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, other) <= 3""",
    "issue_locations": """WITH nodes AS (SELECT o_orderkey AS id, 'o/' || (o_orderkey % 50) AS path, (o_orderkey % 400)::INT AS line FROM orders WHERE o_orderkey % 3 != 0),
issues AS (SELECT event_id AS issue, 'o/' || (event_id % 60) AS p, CASE WHEN event_id % 4 != 0 THEN event_id % 90 END AS l, unnest([0, 1]) AS place, unnest([event_id % 997, event_id % 499 + 1]) AS id FROM events),
t AS (SELECT issue, any_value(p) AS p, any_value(l) AS l, list(path) FILTER (WHERE path IS NOT NULL) AS paths, arg_min(path, place) FILTER (WHERE path IS NOT NULL) AS fp, arg_min(line, place) FILTER (WHERE path IS NOT NULL) AS fl FROM issues LEFT JOIN nodes USING (id) GROUP BY issue)
SELECT issue, CASE WHEN l IS NOT NULL AND list_contains(paths, p) THEN p ELSE coalesce(fp, p || coalesce(':' || l, '')) END AS file, CASE WHEN l IS NOT NULL AND list_contains(paths, p) THEN l ELSE coalesce(fl, 0) END::INT AS line FROM t""",
    "unexamined_inputs": """WITH i AS (SELECT DISTINCT o_orderpriority AS c, o_custkey AS path FROM orders), l AS (SELECT c, path, lower(c_mktsegment) AS status, row_number() OVER (PARTITION BY c ORDER BY path) AS place FROM i JOIN customer ON c_custkey = path AND c_acctbal < 0),
s AS (SELECT c, array_to_string(list_sort(list(path || ' (' || status || ')')), ', ') AS listed FROM l WHERE place <= 4 GROUP BY c) SELECT c AS "check", count(*) AS n, any_value(listed) AS listed FROM l JOIN s USING (c) GROUP BY c""",
    "index_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 3 = 0) AS python, count(*) FILTER (WHERE p_size % 3 != 0) AS javascript, count(*) FILTER (WHERE p_size > 20) AS routed, count(*) FILTER (WHERE p_size > 20 AND p_retailprice > 1000) AS guarded, count(*) FILTER (WHERE p_partkey % 4 = 0) AS untested, count(*) FILTER (WHERE p_partkey % 3 > 1) AS ambiguous, count(DISTINCT p_name) AS ids FROM part",
    "missing_per_file": """WITH f AS (SELECT c_custkey AS path FROM customer WHERE c_acctbal < 0), m AS (SELECT o_custkey AS path, count(*) FILTER (WHERE o_orderstatus != 'F') AS missing FROM orders WHERE o_custkey NOT IN (SELECT path FROM f) GROUP BY 1
UNION ALL SELECT path, CASE WHEN path % 2 = 0 THEN path % 7 ELSE 0 END FROM f) SELECT path, missing FROM m WHERE missing > 0""",
    "group_evidence": "WITH l AS (SELECT DISTINCT l_suppkey AS path, l_returnflag AS k, l_partkey % 100 AS t FROM lineitem), g AS (SELECT DISTINCT l_linenumber AS name, l_returnflag AS k, l_orderkey % 100 AS t FROM lineitem) SELECT path, name, count(*) AS score FROM l JOIN g USING (k, t) GROUP BY ALL",
    "grouped_references": """WITH r AS (SELECT DISTINCT l_suppkey AS location, 't' || l_linenumber AS t, 'c' || (l_partkey % 9) AS c FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY location, t ORDER BY c) AS i FROM r),
q AS (SELECT location, t, count(*) AS n, string_agg(c, ', ' ORDER BY c) FILTER (WHERE i <= 5) AS c FROM p GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY t) AS i, t || ': ' || c || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END AS part FROM q)
SELECT location, string_agg(part, '; ' ORDER BY t) FILTER (WHERE i <= 3) || CASE WHEN count(*) > 3 THEN '; ' || (count(*) - 3) || ' more tables' ELSE '' END AS message FROM s GROUP BY location""",
    "affected_artefacts": "SELECT m.artefact, count(DISTINCT o_custkey) AS n FROM orders JOIN (SELECT DISTINCT o_orderpriority, o_orderpriority || '/' || o_orderstatus AS artefact FROM orders) m USING (o_orderpriority) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) GROUP BY 1",
    "declared_consumers": "WITH c AS (SELECT c_custkey AS path FROM customer WHERE c_acctbal > 5000) SELECT s_suppkey AS concept, 'owner' AS relation, path FROM supplier JOIN c ON path = s_suppkey UNION SELECT s_suppkey, 'consumer', path FROM supplier JOIN c ON path IN (s_suppkey + 1, s_suppkey * 2)",
    "issues_as_findings": "SELECT 'impact' AS tool, 'impact/' || upper(event_type) AS rule, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'info' ELSE 'low' END AS severity, CASE event_type WHEN 'error' THEN 'medium' ELSE 'low' END AS confidence, 'traceability' AS category, count(*) AS n FROM events GROUP BY ALL",
    "path_tests": f"""WITH p AS (SELECT p_partkey, ['src', 'tests', 'spec', 'alembic', 'app/migrations', 'Cypress', 'testdata', 'lib'][p_partkey % 8 + 1] AS top, {list(_NAMES)!r}[p_size % 9 + 1] AS name FROM part)
SELECT p_partkey, top IN ('tests', 'spec', 'Cypress', 'testdata') OR name IN ('test_x.py', 'x_test.py', 'x.spec.mjs', 'x.test.tsx', 'conftest.py') AS test, top IN ('tests', 'Cypress') OR name IN ('test_x.py', 'x_test.py', 'x.spec.mjs', 'x.test.tsx', 'conftest.py', 'x.cy.ts') AS code,
       top = 'app/migrations' OR (top = 'alembic' AND name = 'versions/x.py') AS migration FROM p""",
    "names_and_plurals": """WITH p AS (SELECT *, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part)
SELECT p_partkey, CASE WHEN b = '' THEN a ELSE a || '_' || b END AS snake, CASE WHEN regexp_matches(b, '[^aeiou]y$') THEN left(b, length(b) - 1) || 'ies' WHEN regexp_matches(b, '(s|x|z|ch|sh)$') THEN b || 'es' ELSE b || 's' END AS plural,
       CASE WHEN p_size % 2 = 0 THEN '/api/' || p_brand ELSE '/api/x/' || p_brand END AS route, p_brand AS path, '/a/{param1}/b/{param2}' AS template FROM p""",
}
