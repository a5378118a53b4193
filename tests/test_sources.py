"""Source trees, SARIF and the stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evigraph.sources.sarif import read_sarif
from evigraph.sources.tree import source_tree, write_sarif
from evigraph.streaming.feed import run_once, windowed_counts


def test_source_tree(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {"a.py": b"x = 1\n", "lib/b.ts": b"\xef\xbb\xbfok", "node_modules/c.js": b"no", "d.bin": b"no", "e.sql": b"a\x00b", "f.md": b"\xff\xfe", "g.py": b"y" * 50, "buildx/h.py": b"z", "lib/__init__.py": b"", "dist/x.py": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.path: (r.status, r.text, r.language) for r in source_tree(spark, str(root), max_bytes=40).collect()}
    assert got == {
        "a.py": ("read", "x = 1\n", "python"), "lib/b.ts": ("read", "ok", "typescript"), "e.sql": ("binary", None, "sql"), "f.md": ("invalid_utf8", None, "markdown"), "g.py": ("too_large", None, "python"),
        "buildx/h.py": ("read", "z", "python"), "lib/__init__.py": ("read", "", "python"),
    }


def test_sarif(spark, tmp_path):
    def result(uri, **more):
        return {"message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": 3}}}], **more}

    rules = [{"id": "R1", "defaultConfiguration": {"level": "error"}}, {"id": "R2"}]
    doc = {"runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "results": [result("a%20b.py", ruleIndex=0), result("../x", ruleId="R2"), result("c", ruleId="R2", ruleIndex=0)]}]}
    got = sorted((r.rule, r.severity, r.file, r.error or "") for r in read_sarif(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect())
    assert got == [("R1", "high", "a b.py", ""), ("R2", "medium", "../x", "location outside the tree"), ("R2", "medium", "c", "rule id and index differ")]
    rules = [{"id": "S", "properties": {"security-severity": "9.1"}}, {"id": "S2", "defaultConfiguration": {"level": "note"}}]
    bases = {"SRC": {"uri": "src/", "uriBaseId": "ROOT"}, "ROOT": {"uri": "file:///work/tree/"}, "A": {"uri": "a/", "uriBaseId": "B"}, "B": {"uri": "b/", "uriBaseId": "A"}}

    def at(location, **more):
        return {"message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": location}}], **more}

    cases = [
        (at({"uri": "x.py", "uriBaseId": "SRC"}, ruleId="S"), ("S", "critical", "src/x.py", None)), (at({"index": 1}, ruleId="S2"), ("S2", "low", "lib/y+z.py", None)),
        (at({"index": 7}, ruleId="S2"), ("S2", "low", "", "artifact index is out of range")), (at({"uri": "q", "uriBaseId": "A"}, rule={"index": 1}), ("S2", "low", "q", "bases of the location are a circle")),
        (at({"uri": "q", "uriBaseId": "NO"}, ruleId="S2/sub", level="error"), ("S2/sub", "high", "q", "base of the location is unknown")), (at({"uri": "file:///etc/passwd"}, ruleId="S2"), ("S2", "low", "file:///etc/passwd", "location outside the tree")),
        (at({"uri": "C:/x.py"}, ruleId="S2"), ("S2", "low", "C:/x.py", "location outside the tree")), (at({"uri": "http://h/x.py"}, ruleId="S2"), ("S2", "low", "http://h/x.py", "location outside the tree")),
        ({"message": {"text": "m"}, "ruleId": "S2", "properties": {"security-severity": "5"}}, ("S2", "medium", "", None)),
    ]
    doc = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "originalUriBaseIds": bases, "artifacts": [{}, {"location": {"uri": "./lib%2Fy+z.py"}}], "results": [c[0] for c in cases]}, {"tool": {"driver": {"name": "u"}}}]}
    documents = spark.createDataFrame([(json.dumps(doc),), ("no json",), (json.dumps({**doc, "version": "2.0.0"}),), (None,)], "value string")
    assert [(r.rule, r.severity, r.file, r.error) for r in read_sarif(documents, root="/work/tree").collect()] == [*[c[1] for c in cases], (None, None, None, "document is no JSON"), (None, None, None, "document of another version")]
    findings = spark.createDataFrame([("t", "r", "high", "m", "f", 1, "p")], "tool string, rule string, severity string, message string, file string, line int, fp string")
    runs = spark.createDataFrame([("t", None, None), ("clean", None, None), ("gone", "no config", None)], "tool string, skipped string, error string")
    write_sarif(findings, runs, str(tmp_path / "s"))
    back = {r["tool"]["driver"]["name"]: r["results"] for r in spark.read.json(str(tmp_path / "s")).collect()}
    assert back["gone"] is None and back["clean"] == [] and back["t"][0]["level"] == "error"


def test_sarif_messages_and_deep_bases(spark):
    bases = {f"B{i}": {"uri": f"d{i}/", "uriBaseId": f"B{i + 1}"} for i in range(30)} | {"B30": {"uri": "top/"}}
    place = [{"physicalLocation": {"artifactLocation": {"uri": "x.py", "uriBaseId": "B0"}}}]
    driver = {"name": "t", "rules": [{"id": "R", "messageStrings": {"a": {"text": "{0} not {1} but {7}{"}}}], "messageStrings": {"b": {"markdown": "**{0}**"}}, "globalMessageStrings": {"c": {"text": "all"}, "a": {"text": "no"}}}
    cases = [
        ({"text": "plain {0}"}, "plain {0}"), ({"text": "", "markdown": "*m*"}, "*m*"), ({"id": "a", "arguments": ["{1}", 5]}, "{1} not 5 but {7}{"), ({"id": "b", "arguments": ["x\ny"]}, "**x\ny**"),
        ({"id": "c"}, "all"), ({"id": "none"}, None), ({}, None), ({"text": "{99999999999}", "arguments": ["z"]}, "{99999999999}"),
    ]
    doc = {"version": "2.1.0", "runs": [{"tool": {"driver": driver}, "originalUriBaseIds": bases, "results": [{"ruleId": "R", "message": m, "locations": place} for m, _ in cases]}, {"results": []}]}
    got = read_sarif(spark.createDataFrame([(json.dumps(doc),), ("{}",), ('{"version": "2.1.0", "runs": []}',)], "value string")).collect()
    assert [r.message for r in got[:-1]] == [m for _, m in cases]
    assert {r.file for r in got[:-1]} == {"top/" + "".join(f"d{i}/" for i in reversed(range(30))) + "x.py"}
    assert [r.error for r in got] == [None if m else "result has no message" for _, m in cases] + ["document has no runs"]


def test_stream_counts_each_finding_once(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 01:10:00", "a"), ("2024-01-01 02:00:00", "b"), ("2024-01-09 00:00:00", "c")], "ts string, fp string")
    rows.select(F.to_timestamp("ts").alias("ts"), "fp", F.lit("high").alias("severity")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, fp string, severity string").parquet(str(tmp_path / "in"))
    run_once(windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [(str(r.start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("2024-01-01 00:00:00", 2)]
