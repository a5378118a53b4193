"""Queries on texts: search, duplicates, index, scans, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract.js_facts import file_routes, js_facts
from ..extract.markers import markers
from ..extract.python_facts import python_facts
from ..extract.sql_facts import sql_facts
from ..functions.scalars import NOISE_WORDS, camel_words, redact
from ..operators import governance as V
from ..operators import graph as G
from ..operators import texts as T
from ..sources.corpus import fk_edges, table
from ..sources.sarif import read_sarif

PATTERNS = (("license", r"[Ll]icense"), ("credential", r"(password|token) ?= ?"), ("symbols", r"[#$%&*]{3}"), ("mail", r"@mail[0-9]+\.example\.com"))
LIKE = "tion thing erly that was are not their ering reer anre thent"


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")


def structural_duplicates(spark, sf):
    d = _docs(spark, sf).where(F.length("text") >= 110).select("path", F.sha2("text", 256).alias("fp"))
    return T.duplicates(d, "fp", "path")


def store_signature_clusters(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    return T.store_clusters(lines.select(F.col("l_orderkey").alias("key"), F.col("p_brand").alias("store")))


def similar_score(spark, sf):
    return T.similar(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text"), LIKE)


def seed_search(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"))
    return T.seed_search(nodes, ["red widget", "brand 4 economy", "ring"])


def source_text_hits(spark, sf):
    return T.source_hits(_docs(spark, sf), ["license", "password"]).select("path", F.round("score", 2).alias("score"), F.length("snippets").cast("long").alias("shown"))


def redact_snippets(spark, sf):
    lines = _docs(spark, sf).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.lower("line").rlike(r"(password|secret|token|api[_-]?key)\s*[:=]"))
    return lines.select("path", F.col("n").cast("long").alias("n"), F.left(redact(F.col("line")), F.lit(220)).alias("snippet"))


def token_inverted_index(spark, sf):
    return T.inverted_index(_docs(spark, sf))


def callers_blast_radius(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    calls = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("key")).join(p, "key").select("caller", "name")
    return T.callers(p, calls)


def owner_violations(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("nation:"), "s_nationkey").alias("concept"), F.col("s_name").alias("path"), "s_suppkey")
    return V.owner_violations(s.where("s_suppkey % 2 = 0").drop("s_suppkey"), s.where("s_suppkey % 3 = 0").drop("s_suppkey"))


def line_pattern_scan(spark, sf):
    return T.pattern_scan(_docs(spark, sf), list(PATTERNS))


def gate_reachability(spark, sf):
    scripts = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("script")).distinct().unionByName(spark.sql("SELECT * FROM VALUES ('License'), ('License2') AS s(script)"))
    return V.referenced_scripts(scripts, table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("surface"), "text"))


def symmetric_difference(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("item"))
    return V.difference(c, table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("item")))


def coverage_by_language(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id").distinct().withColumn("l", F.lit(True)), "doc_id", "left")
    return V.coverage(d.select("lang", F.coalesce("l", F.lit(False)).alias("documented")), "lang")


def sibling_contrast(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("checks"))
    return V.sibling_contrast(o, "o_custkey", "o_orderkey", "checks")


def owner_choice(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") % 3 == 0).alias("inside"), (F.col("s_suppkey") % 4).alias("rank"), F.floor(F.col("s_acctbal") / 1000).alias("refs"), F.col("s_name").alias("path"))
    return V.owner_choice(s, "s_nationkey")


def sarif_flatten(spark, sf):
    """Events written as SARIF documents, one for each user and type, and read back: rules by id or index, levels by result or rule."""
    k = F.from_json("props", "k int")["k"]
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", k.alias("k"))
    up = F.when(F.col("event_id") % 10 == 0, "../").otherwise("src/")
    where = F.array(F.struct(F.struct(F.struct(F.concat(up, F.col("user_id").cast("string"), F.lit(".py")).alias("uri")).alias("artifactLocation"), F.struct(F.lit(3).alias("startLine")).alias("region")).alias("physicalLocation")))
    by_index = F.col("event_id") % 2 == 1
    result = F.struct(
        F.when(~by_index, F.concat(F.lit("rule-"), F.col("k").cast("string"))).alias("ruleId"), F.when(by_index, F.col("k")).alias("ruleIndex"), F.when(F.col("event_id") % 3 == 0, "none").alias("level"),
        F.struct(F.col("event_type").alias("text")).alias("message"), where.alias("locations"),
    )
    level = lambda i: F.when(i >= 90, "error").when(i >= 40, "warning").otherwise("note")
    rules = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(F.concat(F.lit("rule-"), i.cast("string")).alias("id"), F.struct(level(i).alias("level")).alias("defaultConfiguration")))
    docs = e.groupBy("event_type", "user_id").agg(F.collect_list(result).alias("results"))
    run = F.struct(F.struct(F.struct(F.col("event_type").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), "results")
    found = read_sarif(docs.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value")))
    return found.groupBy("tool", "rule", "severity", "error").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def sql_shape_gate(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "select * from ").when((F.col("conv_id") + F.col("turn")) % 3 == 1, "Update set ").otherwise(""), "text").alias("t"))
    return t.select("conv_id", "turn", V.looks_like_sql(F.col("t")).alias("is_sql"))


def camel_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(camel_words(F.concat(F.initcap("p_name"), F.lit("_HTTPServer"), F.lower("p_type"))), " ").alias("words"))


def content_digest(spark, sf):
    return V.content_digest(table(spark, sf, "documents"), "doc_id", "text")


def _files(df, path, *lines):
    """A source file for each row: its path and its lines as SQL expressions; null lines are left out."""
    return df.select(F.expr(path).alias("path"), F.concat(F.array_join(F.array(*[F.expr(x) for x in lines]), "\n"), F.lit("\n")).alias("text"))


def python_extract(spark, sf):
    """A module for each part: a model, documented for even sizes, and a route that blocks and asks for a row."""
    files = _files(
        table(spark, sf, "part"), "concat('p/', p_partkey, '.py')", "'from time import sleep as nap'", "concat('class Part', p_partkey, '(Base):')", """IF(p_size % 2 = 0, concat('    \"\"\"', p_name, '\"\"\"'), NULL)""",
        "concat('    __tablename__ = \"part_', p_partkey, '\"')", "concat('@router.get(\"/parts/{id}/', p_partkey, '\")')", "concat('async def read_', p_partkey, '(id):')", "'    nap(1)'",
        "concat('    db.execute(', IF(p_size % 3 = 0, 'f', ''), '\"select 1 from part_', p_partkey, IF(p_size % 3 = 0, ' where id = {id}', ''), '\")')", "IF(p_size % 5 = 0, 'def broken(:', NULL)",
    )
    return python_facts(files).select("path", "fact", "name", "line", F.when(F.col("fact") != "body", F.col("detail")).alias("detail"))


def js_extract(spark, sf):
    files = _files(
        table(spark, sf, "orders"), "concat('o/', o_orderkey, '.ts')", "concat('import { a } from ', chr(39), './m', o_custkey, chr(39), ';')", "concat('export const load', o_orderkey, ' = async (x) => fetch(`/api/o/', o_orderkey, '`);')",
        "concat('// function no', o_orderkey, '() {}')", "IF(o_orderstatus = 'F', concat('class C', o_custkey, ' { go() { return api.post(\"/c\") } }'), NULL)", "concat('const s = \"class No {\"; let k = n => ', o_orderkey)",
    )
    return js_facts(files)


def sql_extract(spark, sf):
    files = _files(
        table(spark, sf, "customer"), "concat('c/', c_custkey, '.sql')", "concat('create table t', c_custkey, ' (id int primary key, n int references n', c_nationkey, '(id));')", "'-- select * from nothing;'",
        "IF(c_nationkey % 2 = 0, concat('with r as (select * from t', c_custkey, ') select * from r join u', c_nationkey, ' on true;'), NULL)", "concat('insert into log select ', c_custkey, ';')", "IF(c_custkey % 7 = 0, 'hello world;', NULL)",
    )
    return sql_facts(files)


def marker_parse(spark, sf):
    files = _files(
        table(spark, sf, "supplier"), "concat('s/', s_suppkey, '.py')", "concat('# @feature f', s_nationkey)", "IF(s_suppkey % 2 = 0, '# Layer: service', '# Layer: cellar')", "concat('# Related: a', s_suppkey, '.py,')", "IF(s_suppkey % 3 = 0, concat('#   b', s_suppkey, '.py'), NULL)", "''", "'x = 1'",
        "concat('# @feature g', s_suppkey)", "'# Tests: t.py'", "'# Other: none'",
    )
    return markers(files).where("field != 'tests'")


def file_router_routes(spark, sf):
    kinds = ("concat('src/app/(shop)/c', c_custkey, '/[id]/page.tsx')", "concat('app/api/c', c_custkey, '/route.ts')", "concat('app/d', c_custkey, '/[[...slug]]/page.tsx')", "concat('pages/e', c_custkey, '/index.tsx')", "concat('pages/api/f', c_custkey, '.ts')", "concat('lib/app/g', c_custkey, '.ts')", "'pages/_app.tsx'")
    path = "element_at(array(" + ", ".join(kinds) + "), CAST(c_custkey % 7 AS int) + 1)"
    return file_routes(table(spark, sf, "customer").selectExpr(f"{path} AS path"))


def impact_capped(spark, sf):
    """Best-first walk with budgets, replayed in order on the nodes within the depth of the seed."""
    from ..operators.capped import capped_walk

    seeds = table(spark, sf, "region").where("r_regionkey = 1").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return capped_walk(fk_edges(spark, sf), seeds, depth=3, budget=60)


QUERIES = {
    f.__name__: f
    for f in (
        structural_duplicates, store_signature_clusters, similar_score, seed_search, source_text_hits, redact_snippets, token_inverted_index, callers_blast_radius, owner_violations, line_pattern_scan,
        gate_reachability, symmetric_difference, coverage_by_language, sibling_contrast, owner_choice, sarif_flatten, sql_shape_gate, camel_tokens, content_digest, python_extract, marker_parse, sql_extract, js_extract, file_router_routes,
        impact_capped,
    )
}

_STOP = ", ".join(f"'{w}'" for w in NOISE_WORDS)
_BAG = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-zA-Z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + ")))"
_LINES = "lines AS (SELECT doc_id AS path, i - 1 AS n, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w != ''))"
_RULES = " UNION ALL ".join(f"SELECT '{r}' AS rule, path, n + 1 AS line FROM lines WHERE length(line) <= 2000 AND regexp_matches(line, '{p}')" for r, p in PATTERNS)
ORACLES = {
    "structural_duplicates": "WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 110) SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS b FROM d QUALIFY b IS NOT NULL",
    "store_signature_clusters": """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT array_to_string(s, ',') AS stores, count(*) AS n FROM s WHERE len(s) >= 2 GROUP BY s HAVING count(*) > 1""",
    "similar_score": f"SELECT doc_id AS key, len(list_intersect({_BAG.format('text')}, {_BAG.format(chr(39) + LIKE + chr(39))})) AS score FROM documents WHERE score >= 3 ORDER BY score DESC, key LIMIT 8",
    "seed_search": f"""WITH p AS (SELECT 'part:' || p_partkey AS id, p_name AS label, lower(p_name) AS l, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(p_brand || '/' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w != ''), ' ') AS p FROM part),
a AS (SELECT *, CASE WHEN l = 'brand 4 economy' THEN 100.0 WHEN p = 'brand 4 economy' THEN 98.0 ELSE 0.0 END + CASE WHEN contains(l, 'brand 4 economy') THEN 28 ELSE 0 END + CASE WHEN contains(p, 'brand 4 economy') THEN 22 ELSE 0 END AS s1 FROM p),
b AS (SELECT *, greatest(s1, CASE WHEN l = 'red widget' THEN 100.0 ELSE 0.0 END) + CASE WHEN contains(l, 'red widget') THEN 28 ELSE 0 END AS s2 FROM a),
c AS (SELECT *, greatest(s2, CASE WHEN l = 'ring' THEN 100.0 ELSE 0.0 END) + CASE WHEN contains(l, 'ring') THEN 28 ELSE 0 END AS s3 FROM b)
SELECT id, (s3 + 4 * len(list_intersect(list_distinct(string_split(l || ' ' || p, ' ')), ['red', 'widget', 'brand', '4', 'economy', 'ring'])))::DOUBLE AS score FROM c WHERE score > 0 ORDER BY score DESC, label, id LIMIT 12""",
    "source_text_hits": f"""WITH {_LINES},
h AS (SELECT path, n, line, contains(lower(line), 'license') OR contains(lower(line), 'password') AS hit, len(list_intersect({_WORDS.format("regexp_replace(line, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")}, ['license', 'password'])) AS w FROM lines),
s AS (SELECT path, n, hit, w, row_number() OVER (PARTITION BY path, hit ORDER BY n) AS place, left(regexp_replace(trim(line, ' '), '(?i)(password|secret|token|api[_-]?key)\\s*[:=]\\s*\\S+', '\\1=<redacted>', 'g'), 220) AS t FROM h WHERE hit OR w > 0)
SELECT path, round(least(36, 8 * count(*) FILTER (WHERE hit)) + least(12, 0.2 * sum(w)), 2)::DOUBLE AS score, length(coalesce(string_agg(t, ' / ' ORDER BY n) FILTER (WHERE hit AND place <= 3), '')) AS shown FROM s GROUP BY path""",
    "redact_snippets": f"WITH {_LINES} SELECT path, n, left(regexp_replace(line, '(?i)(password|secret|token|api[_-]?key)\\s*[:=]\\s*\\S+', '\\1=<redacted>', 'g'), 220) AS snippet FROM lines WHERE regexp_matches(lower(line), '(password|secret|token|api[_-]?key)\\s*[:=]')",
    "token_inverted_index": "WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS token FROM documents) SELECT token, count(*) AS files FROM t GROUP BY token",
    "callers_blast_radius": """WITH h AS (SELECT p_name, count(*) AS homonyms FROM part GROUP BY 1), c AS (SELECT p_name, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), n AS (SELECT p_name, count(*) AS n FROM c GROUP BY 1)
SELECT p_partkey AS key, homonyms, coalesce(n, 0) - CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.p_name = part.p_name AND l_suppkey = p_partkey) THEN 1 ELSE 0 END AS blast_radius FROM part JOIN h USING (p_name) LEFT JOIN n USING (p_name)""",
    "owner_violations": """SELECT 'nation:' || s_nationkey AS concept, s_name AS path, CASE WHEN s_suppkey % 6 = 0 THEN 'known' WHEN s_suppkey % 2 = 0 THEN 'resolved' ELSE 'new' END AS state FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""",
    "line_pattern_scan": f"""WITH {_LINES}, hits AS ({_RULES}), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line) AS place FROM hits)
SELECT rule, path, line FROM r WHERE place <= 20 UNION ALL SELECT rule || '-capped', NULL, NULL FROM hits GROUP BY rule HAVING count(*) > 20""",
    "gate_reachability": """WITH s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS script FROM part UNION ALL VALUES ('License'), ('License2')),
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_#]+'))) AS script FROM documents)
SELECT script, count(doc_id) AS surfaces FROM s LEFT JOIN w USING (script) GROUP BY script""",
    "symmetric_difference": """WITH c AS (SELECT DISTINCT c_nationkey AS item FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS item FROM supplier WHERE s_acctbal > 5000)
SELECT item, 'left' AS side FROM c WHERE item NOT IN (SELECT item FROM s) UNION ALL SELECT item, 'right' FROM s WHERE item NOT IN (SELECT item FROM c)""",
    "coverage_by_language": "WITH d AS (SELECT lang, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents), g AS (SELECT lang, count(*) AS symbols, count(*) FILTER (WHERE l) AS documented FROM d GROUP BY lang) SELECT lang, symbols, documented, (2000 * documented + symbols) // (2 * symbols) AS permille FROM g",
    "sibling_contrast": """WITH p AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS checking FROM orders GROUP BY 1)
SELECT o_orderkey, o_custkey, checking FROM orders JOIN p USING (o_custkey) WHERE o_orderpriority != '1-URGENT' AND checking > 0""",
    "owner_choice": "SELECT s_nationkey, arg_min(s_name, (s_suppkey % 3 != 0, s_suppkey % 4, -floor(s_acctbal / 1000), s_name)) AS owner, max(floor(s_acctbal / 1000))::BIGINT AS most FROM supplier GROUP BY s_nationkey",
    "sarif_flatten": """WITH e AS (SELECT event_id, event_type AS tool, user_id, (props ->> '$.k')::INT AS k FROM events)
SELECT tool, 'rule-' || k AS rule, CASE WHEN event_id % 3 = 0 THEN 'info' WHEN k >= 90 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN event_id % 10 = 0 THEN 'location outside the tree' END AS error, count(*) AS n,
       count(DISTINCT user_id) AS files FROM e GROUP BY ALL""",
    "sql_shape_gate": """WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'select * from ' WHEN 1 THEN 'Update set ' ELSE '' END || text AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '(?is)^\\s*(select|insert\\s+into|update|delete\\s+from|with|create|alter|drop|merge\\s+into)\\b') AND regexp_matches(t, '(?is)\\b(from|into|set|table|values|view|index)\\b') AS is_sql FROM t""",
    "camel_tokens": """WITH s AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: lower(w)) AS w, lower(p_type) AS t FROM part)
SELECT p_partkey, array_to_string(w, ' ') || ' http server' || t AS words FROM s""",
    "python_extract": """WITH p AS (SELECT p_partkey AS k, 'p/' || p_partkey || '.py' AS path, p_size % 2 = 0 AS doc, p_size % 3 = 0 AS hole, p_size % 5 = 0 AS broken, (p_size % 2 = 0)::INT AS d FROM part), g AS (SELECT * FROM p WHERE NOT broken)
SELECT path, 'could-not-scan' AS fact, 'SyntaxError' AS name, 8 + d AS line, '' AS detail FROM p WHERE broken
UNION ALL SELECT path, 'import', 'nap', 1, 'time.sleep' FROM g UNION ALL SELECT path, 'class', 'Part' || k, 2, CASE WHEN doc THEN 'documented' ELSE '' END FROM g UNION ALL SELECT path, 'base', 'Part' || k, 2, 'Base' FROM g
UNION ALL SELECT path, 'table', 'Part' || k, 3 + d, 'part_' || k FROM g UNION ALL SELECT path, 'function', 'read_' || k, 5 + d, '' FROM g UNION ALL SELECT path, 'body', 'read_' || k, 5 + d, NULL FROM g
UNION ALL SELECT path, 'route', 'read_' || k, 4 + d, 'GET /parts/{id}/' || k FROM g UNION ALL SELECT path, 'call', 'router.get', 4 + d, 'read_' || k FROM g UNION ALL SELECT path, 'call', 'nap', 6 + d, 'read_' || k FROM g
UNION ALL SELECT path, 'blocking-call', 'time.sleep', 6 + d, 'read_' || k FROM g UNION ALL SELECT path, 'call', 'db.execute', 7 + d, 'read_' || k FROM g
UNION ALL SELECT path, CASE WHEN hole THEN 'sql-built-from-string' ELSE 'sql' END, 'read_' || k, 7 + d, 'select 1 from part_' || k || CASE WHEN hole THEN ' where id = {}' ELSE '' END FROM g""",
    "js_extract": """WITH o AS (SELECT 'o/' || o_orderkey || '.ts' AS path, o_orderkey AS k, o_custkey AS c, o_orderstatus = 'F' AS f FROM orders)
SELECT path, 'import' AS fact, './m' || c AS name, 1 AS line, '' AS detail FROM o UNION ALL SELECT path, 'export', 'load' || k, 2, '' FROM o UNION ALL SELECT path, 'function', 'load' || k, 2, '' FROM o UNION ALL SELECT path, 'request', 'fetch', 2, '/api/o/' || k FROM o
UNION ALL SELECT path, 'class', 'C' || c, 4, '' FROM o WHERE f UNION ALL SELECT path, 'request', 'post', 4, '/c' FROM o WHERE f UNION ALL SELECT path, 'function', 'k', CASE WHEN f THEN 5 ELSE 4 END, '' FROM o""",
    "sql_extract": """WITH c AS (SELECT 'c/' || c_custkey || '.sql' AS path, c_custkey AS k, c_nationkey AS n, c_nationkey % 2 = 0 AS w, (c_nationkey % 2 = 0)::INT AS d FROM customer)
SELECT path, 1 AS line, 'declares' AS fact, 't' || k AS table_name, '' AS detail FROM c UNION ALL SELECT path, 1, 'column', 't' || k, x FROM c, (VALUES ('id'), ('n')) v(x) UNION ALL SELECT path, 1, 'foreign-key', 't' || k, 'n' || n FROM c
UNION ALL SELECT path, 3, 'reads', 't' || k, '' FROM c WHERE w UNION ALL SELECT path, 3, 'reads', 'u' || n, '' FROM c WHERE w UNION ALL SELECT path, 3 + d, 'writes', 'log', '' FROM c UNION ALL SELECT path, 4 + d, 'unsupported-statement', NULL, 'hello world' FROM c WHERE k % 7 = 0""",
    "marker_parse": """WITH s AS (SELECT 's/' || s_suppkey || '.py' AS path, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT path, 2 AS line, 'f' || n AS feature, 'layer' AS field, CASE WHEN k % 2 = 0 THEN 'service' ELSE 'cellar' END AS value FROM s UNION ALL SELECT path, 3, 'f' || n, 'related', 'a' || k || '.py,' || CASE WHEN k % 3 = 0 THEN ' b' || k || '.py' ELSE '' END FROM s""",
    "file_router_routes": """WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS m FROM customer)
SELECT 'src/app/(shop)/c' || k || '/[id]/page.tsx' AS path, 'page' AS kind, '/c' || k || '/{dynamic}' AS route, false AS catch_all FROM c WHERE m = 0 UNION ALL SELECT 'app/api/c' || k || '/route.ts', 'handler', '/api/c' || k, false FROM c WHERE m = 1
UNION ALL SELECT 'app/d' || k || '/[[...slug]]/page.tsx', 'page', '/d' || k || x, y FROM c, (VALUES ('/{dynamic}', true), ('', false)) v(x, y) WHERE m = 2 UNION ALL SELECT 'pages/e' || k || '/index.tsx', 'page', '/e' || k, false FROM c WHERE m = 3
UNION ALL SELECT 'pages/api/f' || k || '.ts', 'handler', '/api/f' || k, false FROM c WHERE m = 4""",
    "content_digest": """WITH e AS (SELECT doc_id, sha256(doc_id || '|read|' || octet_length(encode(text)) || '|' || coalesce(text, '')) AS d FROM documents), r AS (SELECT doc_id // 4096 AS run, count(*) AS n, sha256(string_agg(d, '' ORDER BY doc_id)) AS d FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS files, sha256(string_agg(d, '' ORDER BY run)) AS digest FROM r""",
}
