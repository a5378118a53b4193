"""Paths named by their ends, plugins and scanner reports on small made-up tables."""

from __future__ import annotations

import json

import pytest

from evigraph.operators import plugins as P
from evigraph.operators import suffixes as S
from evigraph.sources.scanners import read_reports


def test_ends_are_whole_segments_and_unique_or_nothing(spark):
    files = spark.createDataFrame([("app/api/orders/route.ts",), ("app/api/users/route.ts",), ("lib/x.ts",), ("x.ts",), ("a/b/c.ts",)] * 2, "path string")
    wanted = spark.createDataFrame([(1, "orders/route.ts"), (2, "route.ts"), (3, "x.ts"), (4, "rders/route.ts"), (5, "./b/c.ts"), (6, None), (7, ""), (8, "z/a/b/c.ts"), (1, "lib/x.ts")], "q int, token string")
    found = sorted((r.q, r.path or "", r.hits, r.state) for r in S.by_end(wanted, files).collect())
    assert found == [
        (1, "app/api/orders/route.ts", 1, "unique"), (1, "lib/x.ts", 1, "exact"), (2, "", 2, "ambiguous"), (3, "x.ts", 2, "exact"), (4, "", 0, "none"), (5, "a/b/c.ts", 1, "unique"), (6, "", 0, "none"), (7, "", 0, "none"), (8, "", 0, "none")
    ]
    assert S.by_end(wanted, files.limit(0)).where("state != 'none'").count() == 0
    assert S.by_end(wanted.limit(0), files).count() == 0


def test_a_common_name_is_counted_where_it_is_read(spark):
    files = spark.range(20_000).selectExpr("concat('d', id, '/index.ts') AS path")
    wanted = spark.range(5_000).selectExpr("id AS q", "CASE WHEN id < 0 THEN 'other.ts' ELSE 'index.ts' END AS token")
    found = S.by_end(wanted, files)
    assert {(r.state, r.hits) for r in found.select("state", "hits").distinct().collect()} == {("ambiguous", 20_000)} and found.count() == 5_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folders_of_other_machines(spark):
    files = spark.createDataFrame([("backend/app/main.py",), ("app/run.py",), ("tools/one.py",), ("a/two.py",), ("b/two.py",)], "path string")
    homes = S.home_folder(spark.createDataFrame([(1, "/srv/x/backend/app"), (2, "/app"), (3, "C:\\y\\backend\\app"), (4, "/srv/./backend/../app"), (5, None)], "q int, path string"), S.folders_of(files))
    assert sorted((r.q, r.folder) for r in homes.collect()) == [(1, "backend/app"), (3, "backend/app"), (4, "backend/app")]
    wanted = spark.createDataFrame([(1, "/srv/backend/app/main.py"), (2, "/srv/app/run.py"), (3, "/x/two.py"), (4, "nothing.py"), (5, "../../one.py"), (6, None)], "q int, token string")
    got = {r.q: (r.path, r.state) for r in S.deployed_files(wanted, files).collect()}
    assert got == {1: ("backend/app/main.py", "mapped"), 2: ("app/run.py", "unique"), 3: (None, "ambiguous"), 4: (None, "blocking"), 5: ("tools/one.py", "unique"), 6: (None, "blocking")}


def lines():
    """A plugin of a class that tasks need not import."""

    class Lines:
        """A node for each line that is a word; a line ``!`` fails, ``>x`` is an edge to the part x."""

        api, name, version, endings = P.API, "lines", "2", (".txt",)

        def analyze(self, path, text):
            for i, line in enumerate(text.split("\n")):
                if line == "!":
                    raise RuntimeError("cannot read on")
                if line.startswith(">"):
                    yield {"record": P.EDGE, "src": f"{path}:{i - 1}", "dst": line[1:], "kind": "USES", "resolution": "exact", "evidence": str(i)}
                else:
                    yield {"record": P.NODE, "id": line if line.startswith("same") else f"{path}:{i}", "kind": "line", "label": path if line.startswith("same") else line, "metadata": "{}"}

    return Lines


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("part", "part", "p", None), ("sameold", "line", "other", None)], "id string, kind string, label string, path string")


def test_a_file_enters_whole_or_not_at_all(spark, known):
    files = spark.createDataFrame([("a.txt", "one\n>part"), ("b.txt", "one\n!\ntwo"), ("c.txt", "one\n>nowhere"), ("d.txt", "same\nx"), ("e.txt", "same\ny"), ("f.txt", "sameold"), ("g.md", "!"), ("h.TXT", "w"), ("i.txt", None)], "path string, text string")
    entered, out = P.commit(P.extract(files, P.checked(lines()(), "lines"), rows=1), known, "lines", "2")
    reasons = {r.file: r.reason for r in out.collect()}
    assert reasons == {"b.txt": "failed: RuntimeError: cannot read on", "c.txt": "names an unknown node", "e.txt": "another file describes the node first", "f.txt": "node is described differently"}
    assert sorted((r.file, r.record, r.id or r.dst, r.origin) for r in entered.collect()) == [(f, k, i, "plugin:lines@2") for f, k, i in (("a.txt", "edge", "part"), ("a.txt", "node", "a.txt:0"), ("d.txt", "node", "d.txt:1"), ("d.txt", "node", "same"), ("h.TXT", "node", "h.TXT:0"))]


def test_one_bad_row_among_twenty_thousand_removes_its_file_alone(spark, known):
    rest = [f"CAST(NULL AS string) AS {c}" for c in ("src", "dst", "resolution", "evidence", "severity", "message", "recommendation")]
    rows = spark.range(80_001).selectExpr("CASE WHEN id < 80000 THEN concat('f', id % 4) ELSE 'f3' END AS file", "id DIV 4 AS i").selectExpr("file", "'node' AS record", "concat(file, ':', i) AS id", "'k' AS kind", "'l' AS label", "CASE WHEN file = 'f1' AND i = 777 THEN '/etc' END AS path", "CAST(NULL AS string) AS metadata", *rest, "CAST(NULL AS array<string>) AS node_ids")
    entered, out = P.commit(rows, known, "x", "1")
    assert {r.file: r.reason for r in out.collect()} == {"f1": "path outside the tree", "f3": "too many records"}
    assert {r.file: r["count"] for r in entered.groupBy("file").count().collect()} == {"f0": 20_000, "f2": 20_000}


def test_plugins_that_cannot_be_run():
    class Odd(lines()):
        api, version, endings = 2, "", ("TXT",)

    with pytest.raises(ValueError, match="interface 1 and has no version and names no endings"):
        P.checked(Odd(), "lines")
    with pytest.raises(ValueError, match="another name"):
        P.checked(lines()(), "else")
    with pytest.raises(ValueError, match="installed 0 times"):
        P.load(["surely-not-installed"])
    assert "surely-not-installed" not in P.installed()


def test_reports_that_cannot_be_read_are_rows(spark):
    reports = [
        (1, "ruff", None, "[]"), (2, "ruff", None, "{"), (3, "bandit", "f", "[]"), (4, "odd", None, "{}"), (5, "semgrep", None, json.dumps({"errors": [{"path": "a.py", "type": "Cut"}, {"message": "bad rule"}], "results": [{}]})),
        (6, "ruff", None, None), (7, None, None, "{}"), (8, "osv-scanner", None, json.dumps({"results": [{"packages": [{"package": {"name": "p"}, "vulnerabilities": [{"id": "V"}]}]}]})), (9, "bandit", None, json.dumps({"results": [{"test_id": "B1"}], "errors": "none"})),
        (10, "pip-audit", "req.txt", json.dumps({"dependencies": [{"name": "q", "version": "1", "vulns": [{"id": "X", "fix_versions": None}]}]})),
    ]
    found = read_reports(spark.createDataFrame(reports, "report_id int, tool string, file string, text string")).collect()
    errors = {r.report_id: r.error for r in found if r.error}
    assert errors == {2: "no JSON", 3: "another type of document", 4: "unknown tool", 5: "bad rule", 6: "no JSON", 7: "unknown tool"}
    assert {r.report_id: (r.rule, r.severity, r.file, r.message, r.line) for r in found if not r.error} == {
        8: ("deps/V", "high", "", "p: V", 0), 9: ("bandit/B1", "low", "", "", 0), 10: ("deps/X", "high", "req.txt", "q 1: X", 0)
    }
