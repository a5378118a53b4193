"""Queries that match routes and resolve names, on pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import group_name, normalise_route, route_segments
from ..operators import resolve as R
from ..sources.corpus import PAGE_ROUTES_SQL, page_routes, table

#: Handlers: id, method, route.
HANDLERS = (
    (1, "GET", "/en/{id}"), (2, "POST", "/fr/{id}"), (3, "ANY", "/de/{id}"), (4, "GET", "/es/{id}"), (5, "GET", "/{lang}/825"), (6, "DELETE", "/en/{id}"), (7, "GET", "/{lang}/{id}/history"), (8, "PATCH", "/es/{id}"),
)
_HANDLERS_SQL = "handlers(handler_id, h_method, a, b) AS (VALUES (1, 'GET', 'en', '{dynamic}'), (2, 'POST', 'fr', '{dynamic}'), (3, 'ANY', 'de', '{dynamic}'), (4, 'GET', 'es', '{dynamic}'), (5, 'GET', '{dynamic}', '825'), (6, 'DELETE', 'en', '{dynamic}'), (8, 'PATCH', 'es', '{dynamic}'))"
_NORMAL = "CASE WHEN regexp_replace(regexp_replace(path, '//+', '/', 'g'), '(.)/+$', '\\1') = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '//+', '/', 'g'), '(.)/+$', '\\1') END"
_CALLS_SQL = f"""WITH {PAGE_ROUTES_SQL}, {_HANDLERS_SQL},
calls AS (SELECT page_id AS call_id, method, list_filter(string_split({_NORMAL}, '/'), lambda x: x != '') AS s FROM routes),
met AS (SELECT call_id, handler_id, method, h_method FROM calls JOIN handlers ON len(s) = 2 AND (s[1] = a OR a = '{{dynamic}}') AND (s[2] = b OR b = '{{dynamic}}'))"""
_FIT = "(h_method = 'ANY' OR h_method = method OR (method = 'HEAD' AND h_method = 'GET'))"


def _calls(spark, sf):
    return page_routes(spark, sf).select(F.col("page_id").alias("call_id"), "method", route_segments(normalise_route(F.col("path"))).alias("segments"))


def _handlers(spark):
    rows = ", ".join(f"({i}, '{m}', '{r}')" for i, m, r in HANDLERS)
    h = spark.sql(f"SELECT * FROM VALUES {rows} AS h(handler_id, h_method, route)")
    return h.select("handler_id", "h_method", route_segments(normalise_route(F.col("route"))).alias("h_segments"))


def endpoint_match(spark, sf):
    return R.match_endpoints(_calls(spark, sf), _handlers(spark))


def method_mismatch(spark, sf):
    return R.method_mismatch(_calls(spark, sf), _handlers(spark))


def method_mismatch_below(spark, sf):
    """As above with catch-alls and open tails: one page in five is asked for below ``files``, one in seven goes on at run time."""
    page = F.col("call_id")
    below = F.when(page % 5 == 0, F.concat(F.array(F.lit("files")), "segments")).otherwise(F.col("segments"))
    handlers = spark.sql("SELECT * FROM VALUES ('PUT', array('files', '{dynamic}'), true), ('DELETE', array('files', 'en', '{dynamic}'), NULL), ('GET', array('en', '{dynamic}'), false), ('POST', array('de', '{dynamic}'), true), ('UNKNOWN', array('es', '{dynamic}'), false) AS h(h_method, h_segments, catch_all)")
    return R.method_mismatch(_calls(spark, sf).withColumns({"segments": below, "open_tail": page % 7 == 0}), handlers)


def endpoint_status(spark, sf):
    routes = page_routes(spark, sf).withColumn("id", normalise_route(F.col("path")))
    endpoints = routes.groupBy("id").agg((F.max(F.col("page_id") % 5 == 0)).alias("served"), F.max(F.col("page_id") % 11 == 0).alias("open"))
    calls = routes.where("page_id % 3 != 0").select("id", (F.col("page_id") % 2 == 0).alias("linked"), F.col("host").startswith("m.").alias("from_test"))
    return R.endpoint_status(endpoints, calls)


def feature_groups(spark, sf):
    """Pages and hosts per feature; a host's layer is the highest that any of its pages has."""
    r = page_routes(spark, sf).select("page_id", "host", group_name(F.col("path"), True).alias("feature"), F.when(F.col("method") == "POST", 0).when(F.col("method") == "HEAD", 2).otherwise(1).alias("layer"))
    per = r.groupBy("feature", "host").agg(F.count("*").alias("pages"), F.min("layer").alias("layer"))
    return per.groupBy("feature").agg(F.sum("pages").alias("pages"), F.count("*").alias("hosts"), F.count_if(F.col("layer") == 0).alias("routers"))


def route_normalise(spark, sf):
    return page_routes(spark, sf).select("page_id", normalise_route(F.col("path")).alias("route"), group_name(F.col("path"), True).alias("feature"))


def name_call_resolution(spark, sf):
    """Words of part names call the words that other parts define, within a size class."""
    p = table(spark, sf, "part")
    calls = p.select(F.concat(F.lit("part:"), "p_partkey").alias("source"), F.concat(F.lit("brand/"), "p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("file"), F.col("p_type").alias("language"), F.element_at(F.split("p_name", " "), 1).alias("name"))
    defs = p.select(F.concat(F.lit("part:"), "p_partkey").alias("target"), F.concat(F.lit("brand/"), "p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("d_file"), F.col("p_type").alias("d_language"), F.element_at(F.split("p_name", " "), 1).alias("name"))
    return R.resolve_names(calls, defs)


_NAMES_SQL = """WITH p AS (SELECT 'part:' || p_partkey AS id, 'brand/' || p_brand || '/' || p_size AS file, p_type AS lang, split_part(p_name, ' ', 1) AS name FROM part),
near AS (SELECT a.id AS source, a.name, b.id AS target, 0 AS tier FROM p a JOIN p b ON a.name = b.name AND a.lang = b.lang AND a.file = b.file AND a.id != b.id),
usable AS (SELECT name, lang FROM p GROUP BY ALL HAVING count(*) <= 13),
far AS (SELECT a.id AS source, a.name, b.id AS target, 1 AS tier FROM p a JOIN usable USING (name, lang) JOIN p b ON a.name = b.name AND a.lang = b.lang AND a.id != b.id WHERE a.id NOT IN (SELECT source FROM near)),
f AS (SELECT *, count(*) OVER (PARTITION BY source, name) AS n FROM (SELECT * FROM near UNION ALL SELECT * FROM far))
SELECT source, name, target, CASE WHEN n > 1 THEN 'ambiguous' WHEN tier = 0 THEN 'exact' ELSE 'high' END AS resolution FROM f WHERE n <= 12"""


def import_longest_prefix(spark, sf):
    files = page_routes(spark, sf).select("page_id", F.concat("host", "path").alias("path"))
    roots = files.where("page_id % 7 = 0").select(F.regexp_extract("path", "^([^/]+)", 1).alias("root")).unionByName(files.where("page_id % 13 = 0").select(F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("root")))
    return R.nearest_root(files.select("path").distinct(), roots)


def unknown_columns(spark, sf):
    """Event types refer to the keys of their props; a schema from early events declares some; one type's columns are unknowable."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("column_name"), "event_id", "ts")
    catalog = e.where("event_id % 40 = 0").select("table_name", "column_name").distinct()
    opaque = spark.sql("SELECT 'view' AS table_name")
    return R.unknown_columns(e, catalog, opaque).groupBy("table_name", "column_name").agg(F.count("*").alias("n"))


def lookup_cascade(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_brand", F.lit("::"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_name").alias("name"))
    wanted = spark.sql("SELECT * FROM VALUES ('Brand#4::2'), ('17'), ('red widget'), ('brand#2::1'), ('nothing here') AS w(q)")
    return R.lookup_cascade(p, wanted)


def _tier_calls(spark, sf):
    """Calls made of pages: some go on at run time, some stand behind a configured origin, some have runtime segments."""
    r = page_routes(spark, sf).withColumn("s", route_segments(normalise_route(F.col("path"))))
    last = F.element_at("s", -1)
    kinds = F.expr("CAST(page_id % 6 AS int)")
    segments = F.when(kinds == 1, F.array(F.get("s", F.lit(0)), F.concat(F.left(last, F.lit(1)), F.lit(".")))).when(kinds == 2, F.array(F.lit("{dynamic}"), last)).when(kinds == 3, F.array(F.get("s", F.lit(0)), F.lit("{dynamic}"))).when(kinds == 4, F.array(F.lit("items"), F.lit("{dynamic}"))).when(kinds == 5, F.array(F.lit("files"), F.lit("a"), last)).otherwise(F.col("s"))
    return r.select(F.col("page_id").alias("call_id"), "method", segments.alias("segments"), (kinds == 1).alias("open_tail"), (kinds == 4).alias("open_head"))


#: Handlers of the wider query: id, method, route, whether the last segment takes all that follows.
TIER_HANDLERS = (
    (1, "GET", "/en/{id}", False), (2, "POST", "/fr/{id}", False), (3, "ANY", "/de/export", False), (4, "GET", "/es/{id}", False), (5, "GET", "/{lang}/825", False), (6, "ANY", "/api/items/{id}", False),
    (7, "ANY", "/v2/api/items/all", False), (8, "ANY", "/files/{path}", True), (9, "GET", "/en/1.csv", False), (10, "GET", "/en/2.csv", False), (11, "ANY", "/fr/a", False), (12, "ANY", "/fr/b", False), (13, "ANY", "/fr/7.x", False),
)


def _tier_handlers(spark):
    rows = ", ".join(f"({i}, '{m}', '{r}', {str(c).lower()})" for i, m, r, c in TIER_HANDLERS)
    h = spark.sql(f"SELECT * FROM VALUES {rows} AS h(handler_id, h_method, route, catch_all)")
    return h.select("handler_id", "h_method", route_segments(normalise_route(F.col("route"))).alias("h_segments"), "catch_all")


def endpoint_match_tiers(spark, sf):
    return R.match_endpoints(_tier_calls(spark, sf), _tier_handlers(spark), 2)


def endpoints_too_open(spark, sf):
    return R.too_open(_tier_calls(spark, sf), _tier_handlers(spark), 2)


def endpoint_gaps(spark, sf):
    """Shapes of pages as endpoints: which are called without a handler, and which have one that nothing calls."""
    r = page_routes(spark, sf).select("page_id", F.concat_ws(" ", "method", normalise_route(F.col("path"))).alias("id"), "method")
    endpoints = r.groupBy("id", "method").agg(F.max(F.col("page_id") % 4 == 1).alias("handled"))
    calls = r.where("page_id % 3 != 0").select("id", F.col("page_id").cast("string").alias("site"), (F.col("page_id") % 5 == 0).alias("dead"))
    others = r.where("page_id % 7 = 2").groupBy("id").agg(F.lit("PUT").alias("methods"))
    return R.endpoint_gaps(endpoints, calls, r.where("page_id % 11 = 0").select("id"), others)


QUERIES = {f.__name__: f for f in (endpoint_match_tiers, endpoints_too_open, endpoint_gaps, endpoint_match, method_mismatch, method_mismatch_below, endpoint_status, feature_groups, route_normalise, name_call_resolution, import_longest_prefix, unknown_columns, lookup_cascade)}

_GROUP = "coalesce(list_filter(list_transform(list_filter(string_split(path, '/'), lambda x: x != '' AND lower(x) != 'api' AND NOT regexp_matches(x, '^[vV][0-9]+$')), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x != '')[1], 'home')"
_TIER_ROWS = ", ".join(f"({i}, '{m}', [{', '.join(repr('{dynamic}' if x.startswith('{') else x) for x in r.strip('/').split('/'))}], {c})" for i, m, r, c in TIER_HANDLERS)
_TIERS = f"""WITH {PAGE_ROUTES_SQL}, r AS (SELECT page_id, method, list_filter(string_split({_NORMAL}, '/'), lambda x: x != '') AS s FROM routes),
c AS (SELECT page_id AS call_id, method, CASE page_id % 6 WHEN 1 THEN [s[1], left(s[-1], 1) || '.'] WHEN 2 THEN ['{{dynamic}}', s[-1]] WHEN 3 THEN [s[1], '{{dynamic}}'] WHEN 4 THEN ['items', '{{dynamic}}'] WHEN 5 THEN ['files', 'a', s[-1]] ELSE s END AS s, page_id % 6 = 1 AS tail, page_id % 6 = 4 AS head FROM r),
h(handler_id, m, hs, every) AS (VALUES {_TIER_ROWS}),
k AS (SELECT *, hs[skip + 1:] AS t FROM (SELECT *, unnest(range(0, len(hs))) AS skip FROM h)),
met AS (SELECT call_id, handler_id, tail, skip, s, t, every, list_has_any(s, ['{{dynamic}}']) AS runtime FROM c JOIN k ON (skip = 0 OR (head AND len(list_filter(s, lambda x: x != '{{dynamic}}')) > 0)) AND (m = 'ANY' OR m = method OR (method = 'HEAD' AND m = 'GET'))),
fit AS (SELECT *, CASE
    WHEN every AND t[-1] = '{{dynamic}}' THEN (len(s) > len(t) - 1 OR (tail AND len(s) = len(t) - 1)) AND {{0}}(list_transform(range(1, len(t)), lambda i: s[i] = t[i] OR t[i] = '{{dynamic}}'))
    WHEN tail THEN len(t) >= len(s) AND {{0}}(list_transform(range(1, len(s)), lambda i: s[i] = t[i] OR t[i] = '{{dynamic}}')) AND (t[len(s)] IN (s[-1], '{{dynamic}}') OR (starts_with(t[len(s)], s[-1]) AND (ends_with(s[-1], '.') OR substr(t[len(s)], length(s[-1]) + 1, 1) = '.')))
    ELSE len(s) = len(t) AND {{0}}(list_transform(range(1, len(s) + 1), lambda i: s[i] = t[i] OR t[i] = '{{dynamic}}')) END AS strict,
  NOT tail AND runtime AND CASE WHEN every AND t[-1] = '{{dynamic}}' THEN len(s) > len(t) - 1 AND {{0}}(list_transform(range(1, len(t)), lambda i: s[i] = t[i] OR t[i] = '{{dynamic}}' OR s[i] = '{{dynamic}}'))
    ELSE len(s) = len(t) AND {{0}}(list_transform(range(1, len(s) + 1), lambda i: s[i] = t[i] OR t[i] = '{{dynamic}}' OR s[i] = '{{dynamic}}')) END AS loose FROM met),
tiers AS (SELECT call_id, handler_id, tail, min(CASE WHEN skip = 0 AND strict THEN 0 WHEN skip = 0 AND loose THEN 1 WHEN skip > 0 AND strict THEN 2 END) AS tier FROM fit GROUP BY ALL),
best AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n FROM (SELECT * FROM tiers WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY call_id)))""".replace("{0}", "list_bool_and").replace("list_transform(range(1, ", "list_transform(range(0, ").replace("lambda i: ", "lambda i: i = 0 OR ")  # never of an empty list
ORACLES = {
    "endpoint_match_tiers": f"{_TIERS} SELECT call_id, handler_id, CASE WHEN tier = 2 OR ((tier = 1 OR tail) AND n > 1) THEN 'ambiguous' ELSE 'probable' END AS resolution FROM best WHERE n <= 2 OR NOT (tier = 1 OR tail)",
    "endpoints_too_open": f"{_TIERS} SELECT DISTINCT call_id, n FROM best WHERE n > 2 AND (tier = 1 OR tail)",
    "endpoint_gaps": f"""WITH {PAGE_ROUTES_SQL}, r AS (SELECT page_id, method, method || ' ' || {_NORMAL} AS id FROM routes), e AS (SELECT id, method, bool_or(page_id % 4 = 1) AS handled FROM r GROUP BY ALL),
c AS (SELECT id, bool_and(page_id % 5 = 0) AS dead FROM r WHERE page_id % 3 != 0 GROUP BY id),
g AS (SELECT e.id, handled, c.id IS NOT NULL AS called, dead, NOT handled AND c.id IS NOT NULL AND method != 'OPTIONS' AND e.id NOT IN (SELECT id FROM r WHERE page_id % 11 = 0) AS gap, e.id IN (SELECT id FROM r WHERE page_id % 7 = 2) AS other FROM e LEFT JOIN c USING (id))
SELECT id, CASE WHEN gap AND other THEN 'API_METHOD_MISMATCH' WHEN gap THEN 'API_CALL_WITHOUT_HANDLER' ELSE 'API_HANDLER_WITHOUT_STATIC_CALLER' END AS code, CASE WHEN gap AND NOT dead THEN 'warning' ELSE 'info' END AS severity, CASE WHEN gap AND other THEN 'PUT' END AS methods FROM g WHERE gap OR (handled AND NOT called)""",
    "endpoint_match": f"{_CALLS_SQL} SELECT call_id, handler_id, 'probable' AS resolution FROM met WHERE {_FIT}",
    "method_mismatch": f"{_CALLS_SQL} SELECT call_id, array_to_string(list_sort(list_distinct(list(h_method))), ',') AS methods FROM met GROUP BY call_id HAVING NOT bool_or({_FIT})",
    "method_mismatch_below": f"""{_CALLS_SQL},
asked AS (SELECT call_id, method, CASE WHEN call_id % 5 = 0 THEN list_prepend('files', s) ELSE s END AS s FROM calls WHERE call_id % 7 != 0),
hit AS (SELECT call_id, method, s, unnest(list_filter([CASE WHEN len(s) >= 2 AND s[1] = 'files' THEN 'PUT' END, CASE WHEN len(s) = 3 AND s[1] = 'files' AND s[2] = 'en' THEN 'DELETE' END,
  CASE WHEN len(s) = 2 AND s[1] = 'en' THEN 'GET' END, CASE WHEN len(s) >= 2 AND s[1] = 'de' THEN 'POST' END], lambda x: x IS NOT NULL)) AS h_method FROM asked)
SELECT call_id, string_agg(DISTINCT h_method, ',' ORDER BY h_method) AS methods FROM hit GROUP BY call_id HAVING NOT bool_or({_FIT})""",
    "endpoint_status": f"""WITH {PAGE_ROUTES_SQL}, r AS (SELECT *, {_NORMAL} AS id FROM routes), e AS (SELECT id, bool_or(page_id % 5 = 0) AS served, bool_or(page_id % 11 = 0) AS open FROM r GROUP BY id),
c AS (SELECT id, bool_and(page_id % 2 = 0) AS linked FROM r WHERE page_id % 3 != 0 AND NOT starts_with(host, 'm.') GROUP BY id)
SELECT e.id, CASE WHEN served THEN 'served' WHEN open THEN 'open' WHEN linked IS NULL THEN 'uncalled' WHEN linked THEN 'matched' ELSE 'unserved' END AS status FROM e LEFT JOIN c ON c.id = e.id""",
    "feature_groups": f"""WITH {PAGE_ROUTES_SQL}, r AS (SELECT host, {_GROUP} AS feature, CASE method WHEN 'POST' THEN 0 WHEN 'HEAD' THEN 2 ELSE 1 END AS layer FROM routes), p AS (SELECT feature, host, count(*) AS pages, min(layer) AS layer FROM r GROUP BY ALL)
SELECT feature, sum(pages)::BIGINT AS pages, count(*) AS hosts, count(*) FILTER (WHERE layer = 0) AS routers FROM p GROUP BY feature""",
    "route_normalise": f"WITH {PAGE_ROUTES_SQL} SELECT page_id, {_NORMAL} AS route, {_GROUP} AS feature FROM routes",
    "name_call_resolution": _NAMES_SQL,
    "import_longest_prefix": f"""WITH {PAGE_ROUTES_SQL}, f AS (SELECT page_id, host || path AS path FROM routes),
roots AS (SELECT regexp_extract(path, '^([^/]+)', 1) AS root FROM f WHERE page_id % 7 = 0 UNION SELECT regexp_extract(path, '^([^/]+/[^/]+)', 1) FROM f WHERE page_id % 13 = 0)
SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM f) LEFT JOIN roots ON starts_with(path, root || '/') AND root != '' GROUP BY path""",
    "unknown_columns": """WITH e AS (SELECT event_type AS t, 'k' || (props ->> '$.k') AS c, event_id FROM events), k AS (SELECT DISTINCT t, c FROM e WHERE event_id % 40 = 0)
SELECT t AS table_name, c AS column_name, count(*) AS n FROM e WHERE t != 'view' AND t IN (SELECT t FROM k) AND (t, c) NOT IN (SELECT t, c FROM k) GROUP BY ALL""",
    "lookup_cascade": """WITH p AS (SELECT p_brand || '::' || p_partkey AS key, p_partkey::VARCHAR AS source_id, p_name AS name FROM part), w(q) AS (VALUES ('Brand#4::2'), ('17'), ('red widget'), ('brand#2::1'), ('nothing here')),
x AS (SELECT q, key, 0 AS tier FROM w JOIN p ON q = key UNION ALL SELECT q, key, 1 FROM w JOIN p ON q = source_id UNION ALL SELECT q, key, 2 FROM w JOIN p ON q = name UNION ALL SELECT q, key, 3 FROM w JOIN p ON contains(lower(key), lower(q))),
b AS (SELECT DISTINCT q, key, tier FROM x QUALIFY tier = min(tier) OVER (PARTITION BY q))
SELECT q, key, tier, row_number() OVER (PARTITION BY q ORDER BY length(key), key) AS place FROM b QUALIFY place <= 12""",
}
