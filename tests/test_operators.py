"""Operators on small made-up tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.extract import python_facts, sql_facts
from evigraph.extract.markers import marker_issues, markers
from evigraph.functions.scalars import camel_words, is_test_code, is_test_path, magnitudes, normalise_route, redact, score_table, topic_words
from evigraph.operators import findings as O
from evigraph.operators import graph as G
from evigraph.operators import resolve as R
from evigraph.operators.capped import capped_walk, walk


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_scores_cover_all_cells():
    table = score_table()
    assert len(table) == 90
    assert ("info", "medium", "internal", 0.17, "P3") in table
    assert ("critical", "high", "unauthenticated", 15.0, "P0") in table


def test_scalars(spark):
    assert one(spark, "HTTPServer/fooBar_baz", camel_words) == ["http", "server", "foo", "bar", "baz"]
    assert one(spark, "took 12 s, 3 of 148, 0.41, found 7", magnitudes) == [3, 7]
    assert one(spark, "//a/${x}/{id}//", normalise_route) == "/a/{dynamic}/{dynamic}"
    assert one(spark, "/", normalise_route) == "/"
    for route, shape in (("a/{x}-{y}/", "a/{dynamic}-{dynamic}"), ("", "/"), ("/a/{}", "/a/{}"), ("/p/${a/b}/$x", "/p/{dynamic}/$x"), ("/open/{x", "/open/{x")):
        assert one(spark, route, normalise_route) == shape
    for message, counts in (("1.2.3 and .5 of 9/8, 12ms 12 minutely v7 x", [12, 7]), ("no number", []), ("2 minutes 3 min 4 mints 5. 6", [4, 5, 6]), ("10 of 20", [10])):
        assert one(spark, message, magnitudes) == counts
    assert one(spark, "getHTTPServer for fooBar_baz and a", topic_words) == ["httpserver", "foo", "bar", "baz"]


def test_test_paths(spark):
    tests = ["a/tests/x.py", "test_a.py", "b/a_test.py", "conftest.py", "x.spec.mjs", "x.test.tsx", "x.spec.cts", "Cypress/a.ts", "e2e/a.md"]
    fixtures = ["spec/a.yaml", "x/__fixtures__/a.json", "testdata/a.sql"]
    none = ["src/app.py", "tests.py", "contest.py", "a/test", "latest/x.py", "x.spec.py", "spec.ts"]
    for path in tests:
        assert one(spark, path, is_test_path) and one(spark, path, is_test_code), path
    for path in fixtures:
        assert one(spark, path, is_test_path) and not one(spark, path, is_test_code), path
    assert one(spark, "a.cy.ts", is_test_code) and not one(spark, "a.cy.ts", is_test_path)
    for path in none:
        assert not one(spark, path, is_test_path) and not one(spark, path, is_test_code), path


def test_chains_longer_than_a_hundred(spark):
    edges = spark.range(130).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.closure(edges, spark.range(1)).count() == 131


def test_lookup_by_parts_of_keys(spark):
    records = spark.createDataFrame([("Brand#4::2", "1", "a"), ("brand#44", "2", "b"), ("x4", "3", "c")], "key string, source_id string, name string")
    wanted = spark.createDataFrame([("D#4",), ("4",), ("44",), ("zzz",), ("x4",)], "q string")
    got = {(r.q, r.key, r.tier) for r in R.lookup_cascade(records, wanted).collect()}
    assert got == {("D#4", "Brand#4::2", 3), ("D#4", "brand#44", 3), ("4", "Brand#4::2", 3), ("4", "brand#44", 3), ("4", "x4", 3), ("44", "brand#44", 3), ("x4", "x4", 0)}
    assert one(spark, "api-key: abc x", redact) == "api-key=<redacted> x"


def finding(message, n, ts=0):
    return (n, "t", "r", "high", "high", "", "c", message, "f", n, True, ts)


COLUMNS = "event_id int, tool string, rule string, severity string, confidence string, exposure string, category string, message string, file string, line int, counts_matter boolean, ts int"


def test_mark_new_by_count_and_magnitude(spark):
    def frame(*messages):
        rows = [finding(m, i) for i, m in enumerate(messages)]
        return O.with_occurrence(O.with_fingerprint(O.with_score(spark.createDataFrame(rows, COLUMNS))), "event_id")

    for before, now, expected in ((["4 calls"], ["2 calls"], [False]), (["2 calls"], ["4 calls"], [True]), (["3 calls"], ["3 calls"], [False]), (["3 calls"], ["3 calls", "3 calls"], [False, True])):
        counts, numbers = O.baseline(frame(*before))
        assert [r.is_new for r in O.mark_new(frame(*now), counts, numbers).orderBy("occurrence").collect()] == expected
    assert O.mark_new(frame("x"), None).first().is_new is None


def test_edges_merge_and_hubs(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", "e", 2, "exact"), ("a", "b", "CALLS", "e", 1, "high"), ("a", "c", "CALLS", "e", 3, "exact")], "src string, dst string, kind string, evidence string, seq int, resolution string")
    assert values(G.dedupe_edges(edges), "src", "dst", "resolution") == [("a", "b", "high"), ("a", "c", "exact")]
    contains = spark.range(61).select(F.lit("h").alias("src"), F.col("id").cast("string").alias("dst"), F.lit("CONTAINS").alias("kind"))
    assert values(G.hubs(contains), "id", "children") == [("h", 61)]
    assert G.hubs(contains.limit(60)).isEmpty()


def test_min_cost_reaches_by_hops_and_cost(spark):
    rows = [("s", "n", "REFERENCES", "syntax"), ("s", "m", "IMPORTS", "exact"), ("m", "n", "IMPORTS", "exact"), ("n", "t", "IMPORTS", "exact")]
    edges = spark.createDataFrame([(*r, "ast") for r in rows], "src string, dst string, kind string, resolution string, origin string")
    seeds = spark.createDataFrame([("s",)], "id string")
    assert values(G.min_cost_reach(edges, seeds, 2), "id", "cost", "hops") == [("m", 1, 1), ("n", 2, 1), ("s", 0, 0), ("t", 7, 2)]


def test_closure_with_cycle_and_unknown_starts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "id string")
    start = nodes.where("id = 'a'")
    assert values(G.unreachable(nodes, edges, start), "id") == [("x",), ("y",)]
    assert G.unreachable(nodes, edges, start, unknown=True).isEmpty()
    assert G.closure(edges, start.limit(0)).isEmpty()


def test_capped_walk_fixes_first_discovery():
    steps = {"s": [("n", 5), ("m", 1)], "m": [("n", 1)], "n": [("t", 1)]}
    assert walk(steps, ["s"], 2, 10, 1.0, lambda n: n) == [("s", 0, 0), ("n", 2, 1), ("m", 1, 1)]
    assert len(walk(steps, ["s"], 2, 2, 1.0, lambda n: n)) == 2


def test_capped_walk_of_a_large_ball_fetches_what_the_budget_allows(spark):
    rows = spark.range(101_000).selectExpr("concat('s', id % 3) AS src", "concat(IF(id % 2 = 0, 'a:', 'b:'), id % 100000) AS dst", "IF(id % 5 = 0, 'IMPORTS', 'REFERENCES') AS kind", "'exact' AS resolution", "'ast' AS origin")
    seeds = spark.createDataFrame([("s0",)], "id string")
    steps = {}
    for at, to, cost in G._steps(rows, seeds, G.HUB).toPandas().sort_values(["at", "cost", "to"]).itertuples(index=False):
        steps.setdefault(at, []).append((to, cost))
    for budget, share in ((5, 0.5), (60, 0.5)):
        expected = [(n, c, h, i) for i, (n, c, h) in enumerate(walk(steps, ["s0"], 3, budget, share, lambda n: n.split(":")[0]))]
        assert [tuple(r) for r in capped_walk(rows, seeds, 3, budget, share).orderBy("place").collect()] == expected


def test_endpoint_matching_tiers(spark):
    calls = spark.createDataFrame([(1, "GET", ["items", "42"]), (2, "GET", ["items", "{dynamic}", "{dynamic}"]), (3, "HEAD", ["items", "1"]), (4, "PUT", ["items", "1"])], "call_id int, method string, segments array<string>")
    handlers = spark.createDataFrame([(1, "GET", ["items", "{dynamic}"]), (2, "GET", ["items", "{dynamic}", "approve"]), (3, "GET", ["items", "export"])], "handler_id int, h_method string, h_segments array<string>")
    assert values(R.match_endpoints(calls, handlers), "call_id", "handler_id", "resolution") == [(1, 1, "probable"), (2, 2, "probable"), (3, 1, "probable")]
    assert values(R.method_mismatch(calls, handlers), "call_id", "methods") == [(4, "GET")]
    wide = spark.createDataFrame([("GET", ["files", "{dynamic}"], True), ("ANY", ["any", "{dynamic}"], True), ("UNKNOWN", ["odd"], None)], "h_method string, h_segments array<string>, catch_all boolean")
    asked = [(1, "PUT", ["files", "a", "b"], False), (2, "PUT", ["files"], False), (3, "PUT", ["files", "a"], True), (4, "PUT", ["any", "x", "y"], None), (5, "PUT", ["odd"], False), (6, "HEAD", ["files", "a"], False), (7, "PUT", [], False)]
    asked = spark.createDataFrame(asked, "call_id int, method string, segments array<string>, open_tail boolean")
    assert values(R.method_mismatch(asked, wide), "call_id", "methods") == [(1, "GET")]


def test_ambiguous_names(spark):
    for n, expected in ((1, 1), (12, 12), (13, 0)):
        defs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("target"), F.concat(F.lit("f"), "id").alias("d_file"), F.lit("py").alias("d_language"), F.lit("go").alias("name"))
        calls = spark.createDataFrame([("s", "here", "py", "go")], "source string, file string, language string, name string")
        found = R.resolve_names(calls, defs).collect()
        assert len(found) == expected
        assert all(r.resolution == ("ambiguous" if n > 1 else "high") for r in found)


def test_python_facts():
    found = python_facts.facts('class A(B):\n    __tablename__ = "t"\n    async def f(self):\n        requests.get("u")\n        while 1:\n            db.execute("select " + x)\n')
    assert {("class", "A", 1, ""), ("base", "A", 1, "B"), ("table", "A", 2, "t"), ("blocking-call", "requests.get", 4, "A.f"), ("sql-built-from-string", "A.f", 6, "select {}"), ("query-in-loop", "A.f", 6, "db.execute")} <= set(found)
    assert python_facts.facts("def (") == [("could-not-scan", "SyntaxError", 1, "")]


def test_sql_statements_and_facts():
    text = "select ';' from a; /* x /* ; */ y */ create function f() as $$ begin; end $$;\nwith c as (select 1 from b) insert into T select * from c, \"Q\"\n"
    assert [line for line, _ in sql_facts.statements(text)] == [1, 1, 2]
    found = {(kind, name) for _, kind, name, _ in sql_facts.facts(text)}
    assert {("reads", "a"), ("reads", "b"), ("writes", "t")} <= found
    assert ("reads", "c") not in found


def test_markers(spark):
    files = spark.createDataFrame([("x.py", "# @feature f\n# Layer: cellar\n# Related: a.py,\n#   b.py\n\ny = 1\n"), ("n.py", "")], "path string, text string")
    found = markers(files)
    assert values(found, "feature", "field", "value") == [("f", "layer", "cellar"), ("f", "related", "a.py, b.py")]
    tracked = spark.createDataFrame([("a.py",)], "path string")
    assert values(marker_issues(found, tracked), "issue") == [("dangling-related",), ("unknown-layer",)]


def test_blocking_calls_by_any_name():
    text = "from time import sleep as nap\nimport requests as r, os\nasync def f():\n    nap(1)\n    r.get('u')\n    os.sleep(1)\ndef g():\n    nap(1)\n"
    assert [(f[1], f[2]) for f in python_facts.facts(text) if f[0] == "blocking-call"] == [("time.sleep", 4), ("requests.get", 5)]
