"""Reports, and facts from JavaScript by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.extract.js_facts import file_routes, js_facts
from evigraph.operators.findings import with_fingerprint, with_score
from evigraph.operators.links import row_budget
from evigraph.operators.pages import page_lines, write_page
from evigraph.operators.render import markdown_report, mermaid
from evigraph.operators.running import running_before


def test_markdown_escapes_and_caps(spark):
    rows = [("t", "r", "high", "high", "", "c|d", f"<b>{'x' * 300}|", "f", i, False) for i in range(20)]
    findings = with_fingerprint(with_score(spark.createDataFrame(rows, "tool string, rule string, severity string, confidence string, exposure string, category string, message string, file string, line int, counts_matter boolean")))
    text = markdown_report(findings)
    assert text.count("\n- ") == 15 and "| c\\|d | 20 | 0 | 20 | 0 | 0 |" in text and "<b>" not in text and "…" in text


def test_mermaid_quotes(spark):
    nodes = spark.createDataFrame([("a", 'x"];b'), ("b", "y")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "z", "CALLS")], "src string, dst string, kind string")
    assert mermaid(nodes, edges) == "flowchart LR\n  n0[\"x']'b\"]\n  n1[\"y\"]\n  n0 -->|CALLS| n1\n"


def test_js_facts(spark):
    text = "import a from './a'\nexport async function load() { await fetch(`/api/${id}`) }\nconst f = (x) => api.post('/b')\nclass C {}\n"
    got = {(r.fact, r.name, r.line, r.detail) for r in js_facts(spark.createDataFrame([("x.ts", text), ("n.ts", None)], "path string, text string")).collect()}
    assert got == {
        ("import", "./a", 1, ""), ("function", "load", 2, ""), ("export", "load", 2, ""), ("request", "fetch", 2, "/api/${id}"), ("function", "f", 3, ""), ("request", "post", 3, "/b"), ("class", "C", 4, ""),
    }


def test_js_tokens_and_facts():
    from evigraph.extract.js_facts import facts
    from evigraph.extract.js_tokens import tokens

    text = """// function no() {}
/* class No {} */ const s = "function no2() {"; const re = /[/"']function x/g;
export default class A extends B { method() { return this.function } }
export { a as b, c } from "./m"; export * from './n';
import type { T } from "t"; import("./lazy"); const q = require('q');
const g = async <T>(x: T): Promise<T> => x, h = 1;
let k: Handler = async x => client.get<Item[]>("/k");
var v = x / y; function* gen() {}
""" + "const long = () => 0;" + " " * 5000 + "function far() { useSWR(`/f/${nested(`${1}`)}`) }"
    assert [t.kind for t in tokens("a /b/ c")] == ["word", "sign", "word", "sign", "word"]
    got = {(f, n, d) for f, n, _, d in facts(text)}
    assert got == {
        ("class", "A", ""), ("export", "A", ""), ("export", "b", ""), ("export", "c", ""), ("import", "./m", ""), ("import", "./n", ""), ("import", "t", ""), ("import", "./lazy", ""), ("import", "q", ""),
        ("function", "g", ""), ("function", "k", ""), ("request", "get", "/k"), ("function", "gen", ""), ("function", "long", ""), ("function", "far", ""), ("request", "useSWR", "/f/${nested(`${1}`)}"),
    }


def test_file_routes(spark):
    paths = ["src/app/(shop)/orders/[id]/page.tsx", "app/api/orders/route.ts", "app/docs/[[...slug]]/page.tsx", "pages/index.tsx", "pages/api/x.ts", "pages/_app.tsx", "lib/app/x.ts", "app/page.tsx"]
    got = {(r.path, r.kind, r.route, r.catch_all) for r in file_routes(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {
        (paths[0], "page", "/orders/{dynamic}", False), (paths[1], "handler", "/api/orders", False), (paths[2], "page", "/docs/{dynamic}", True), (paths[2], "page", "/docs", False), (paths[3], "page", "/", False),
        (paths[4], "handler", "/api/x", False), (paths[7], "page", "/", False),
    }


def test_running_totals_over_ranges(spark):
    rows = spark.range(2_000).selectExpr("id", "(id * 7919) % 2003 AS k", "CASE WHEN id % 10 != 0 THEN id % 5 END AS n")
    found = running_before(rows, "n", [F.desc("k")])
    total = 0
    for r in sorted(found.collect(), key=lambda r: -r.k):
        assert r.before == total
        total += r.n or 0
    assert running_before(rows.limit(0), "n", ["k"]).collect() == []
    budget = row_budget(rows.selectExpr("k AS name", "coalesce(n, 0) AS n"), 500, ["name"])
    assert budget.agg(F.sum("shown")).first()[0] == 500
    plan = budget._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_page_of_a_budget_is_written_in_order(spark, tmp_path):
    words = "priority string, score double, rule string, category string, severity string, confidence string, exposure string, file string, line int, message string, n int"
    some = [("P1", 9.0 - i % 3, f"r{i % 4}", "c", "high", "low", None, f"f{i}", i, "<script>'\"&" if i == 0 else "x" * 10, i) for i in range(40)] + [("P0", 20.0, "top", "c", "high", "high", "e", "a&b", None, "y" * 3_000, 99)]
    findings = spark.createDataFrame(some, words)
    lines = page_lines(findings, "n", total=16, per_group=6)
    write_page(lines, str(tmp_path / "page"), "A <title>")
    page = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "page").glob("part-*")) if p.stat().st_size)
    assert page.startswith("<!doctype html>") and "A &lt;title&gt;" in page and "<script>" not in page
    kept = [line for line in page.split("\n") if line.startswith("<tr>")]
    assert len(kept) == 16 and page.count("<details>") == page.count("</details>") == 4
    assert page.index(" · top · ") < page.index(" · r0 · ") < page.index(" · r1 · ") < page.index(" · r2 · ") and " · r3 · " not in page
    assert "&lt;script&gt;&#x27;&quot;&amp;" in page and "a&amp;b</td>" in page and "y" * 1_999 + "…</td>" in page and "y" * 2_000 not in page
    assert "<p>4 more</p>" in page and "<p>7 more</p>" in page and page.endswith("<p>1 rules not shown, 10 findings</p>")
    write_page(page_lines(findings.limit(0), "n"), str(tmp_path / "none"), "t")
    assert sum("<h1>t</h1>" in p.read_text() for p in (tmp_path / "none").glob("part-*")) == 1
