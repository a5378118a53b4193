"""Queries over reports of scanners, which are made of events: each event is a report of one of five tools, some of them broken."""

from __future__ import annotations

from ..sources import scanners as S
from ..sources.corpus import table
from ..sources.sarif import read_sarif

_RUFF = """concat('[{"code": ', CASE WHEN n % 9 = 0 THEN 'null' ELSE concat('"', element_at(array('S608', 'S101', 'S324', 'ASYNC210', 'PERF401', 'B006', 'E501'), CAST(n % 7 + 1 AS int)), '"') END,
 ', "filename": "', f, '", "location": {"row": ', n, '}, "message": "told ', n, '", "url": null}]')"""
_BANDIT = """concat('{"errors": [', CASE WHEN n % 8 = 0 THEN concat('{"filename": "', f, '", "reason": "syntax ', n, '"}') ELSE '' END, '], "results": [{"test_id": "B', n % 50, '", "test_name": "t", "issue_severity": "',
 element_at(array('HIGH', 'MEDIUM', 'UNDEFINED'), CAST(n % 3 + 1 AS int)), '", "issue_confidence": "LOW", "filename": "', f, '", "line_number": ', n, ', "issue_text": "told ', n, '", "more_info": "see"}]}')"""
_SEMGREP = """concat('{"errors": [', CASE n % 7 WHEN 0 THEN '{"type": "RuleError"}' WHEN 1 THEN concat('{"path": "', f, '", "message": "cut"}') ELSE '' END, '], "results": [{"check_id": "c', n % 50, '", "path": "', f,
 '", "start": {"line": ', n, '}, "extra": {"severity": "', element_at(array('ERROR', 'WARNING', 'INFO', 'ODD'), CAST(n % 4 + 1 AS int)), '", "message": "told ', n, '", "metadata": {"confidence": "', CASE WHEN n % 2 = 0 THEN 'HIGH' ELSE 'none' END, '"}}}]}')"""
_OSV = """concat('{"results": [{"source": {"path": "', f, '"}, "packages": [{"package": {"name": "p', n % 10, '", "version": "1.', n % 3, '"}, "vulnerabilities": [{"id": "V', n, '", "database_specific": {"severity": "',
 element_at(array('MODERATE', 'CRITICAL', 'LOW', 'WILD'), CAST(n % 4 + 1 AS int)), '"}}, {"id": "W', n, '", "summary": "short"}]}, {"package": {}, "vulnerabilities": []}]}]}')"""
_PIP = """concat('{"dependencies": [{"name": "p', n % 10, '", "version": "2", "vulns": [{"id": "V', n, '", "fix_versions": [', CASE WHEN n % 2 = 0 THEN '"3", "4"' ELSE '' END, ']}]}, {"name": "skipped"}]}')"""


def scanner_reports(spark, sf):
    """Findings of five kinds of report; one in eleven is cut off, one in thirteen has a list for an object or the reverse."""
    e = table(spark, sf, "events").selectExpr("event_id AS n", "concat('user/', user_id, '.py') AS f", "event_id % 5 AS t")
    whole = f"CASE t WHEN 0 THEN {_RUFF} WHEN 1 THEN {_BANDIT} WHEN 2 THEN {_SEMGREP} WHEN 3 THEN {_OSV} ELSE {_PIP} END"
    text = f"CASE WHEN n % 11 = 0 THEN left({whole}, 20) WHEN n % 13 = 0 THEN CASE WHEN t = 0 THEN '{{}}' ELSE '[]' END ELSE {whole} END"
    tools = "element_at(array('ruff', 'bandit', 'semgrep', 'osv-scanner', 'pip-audit'), CAST(t + 1 AS int))"
    return S.read_reports(e.selectExpr("n AS report_id", f"{tools} AS tool", "f AS file", f"{text} AS text"))


_SARIF = """concat('{"version": "', IF(n % 13 = 0, '2.0.0', '2.1.0'), '", "runs": [{"tool": {"driver": {"name": "t", "messageStrings": {"s": {"markdown": "*{0}*"}}, "rules": [{"id": "r',
 n % 5, '", "messageStrings": {"m": {"text": "{1} at {0} of {2}"}}}]}}, "results": [{"ruleIndex": 0, "message": ', CASE n % 5 WHEN 0 THEN concat('{"text": "told ', n, '"}') WHEN 1 THEN concat('{"id": "m", "arguments": ["{1}", ', n, ']}')
 WHEN 2 THEN concat('{"markdown": "_', n, '_"}') WHEN 3 THEN concat('{"id": "s", "arguments": ["', n, '"]}') ELSE '{"id": "unknown"}' END, ', "locations": [{"physicalLocation": {"artifactLocation": {"uri": "', f, '"}, "region": {"startLine": ', n, '}}}]}]}]}')"""


def sarif_messages(spark, sf):
    """Findings of SARIF documents made of events, with messages of five kinds; one in eleven is cut off, one in thirteen of another version."""
    e = table(spark, sf, "events").selectExpr("event_id AS n", "concat('user/', user_id, '.py') AS f")
    return read_sarif(e.selectExpr(f"IF(n % 11 = 0, left({_SARIF}, 40), {_SARIF}) AS value"))


QUERIES = {f.__name__: f for f in (scanner_reports, sarif_messages)}

ORACLES = {
    "sarif_messages": """WITH e AS (SELECT event_id AS n, event_id % 11 != 0 AND event_id % 13 != 0 AS good, 'user/' || user_id || '.py' AS f FROM events)
SELECT CASE WHEN good THEN 't' END AS tool, CASE WHEN good THEN 'r' || (n % 5) END AS rule, CASE WHEN good THEN 'medium' END AS severity,
  CASE WHEN good THEN CASE n % 5 WHEN 0 THEN 'told ' || n WHEN 1 THEN n || ' at {1} of {2}' WHEN 2 THEN '_' || n || '_' WHEN 3 THEN '*' || n || '*' END END AS message,
  CASE WHEN good THEN f END AS file, CASE WHEN good THEN n::INT END AS line,
  CASE WHEN n % 11 = 0 THEN 'document is no JSON' WHEN n % 13 = 0 THEN 'document of another version' WHEN n % 5 = 4 THEN 'result has no message' END AS error FROM e""",
    "scanner_reports": """WITH e AS (SELECT event_id AS n, 'user/' || user_id || '.py' AS f, ['ruff', 'bandit', 'semgrep', 'osv-scanner', 'pip-audit'][event_id % 5 + 1] AS tool,
  CASE WHEN event_id % 11 = 0 THEN 'no JSON' WHEN event_id % 13 = 0 THEN 'another type of document' WHEN event_id % 5 = 2 AND event_id % 7 = 0 THEN 'RuleError' END AS error FROM events),
g AS (SELECT * FROM e WHERE error IS NULL),
c AS (SELECT *, ['S608', 'S101', 'S324', 'ASYNC210', 'PERF401', 'B006', 'E501'][n % 7 + 1] AS code FROM g WHERE tool = 'ruff' AND n % 9 != 0),
lost AS (SELECT n, tool, f, '' AS why FROM g WHERE tool = 'ruff' AND n % 9 = 0 UNION ALL SELECT n, tool, f, 'syntax ' || n FROM g WHERE tool = 'bandit' AND n % 8 = 0 UNION ALL SELECT n, tool, f, 'cut' FROM g WHERE tool = 'semgrep' AND n % 7 = 1)
SELECT n AS report_id, tool, 'ruff/' || code AS rule, CASE code WHEN 'S608' THEN 'high' WHEN 'S324' THEN 'medium' WHEN 'ASYNC210' THEN 'medium' ELSE 'low' END AS severity, CASE code WHEN 'ASYNC210' THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN code LIKE 'S%' THEN 'security' WHEN code IN ('ASYNC210', 'PERF401') THEN 'performance' ELSE 'correctness' END AS category, f AS file, n AS line, 'told ' || n AS message, '' AS remedy, NULL::VARCHAR AS error FROM c
UNION ALL SELECT n, tool, 'bandit/B' || (n % 50) || '-t', ['high', 'medium', 'low'][n % 3 + 1], 'low', 'security', f, n, 'told ' || n, 'see', NULL FROM g WHERE tool = 'bandit'
UNION ALL SELECT n, tool, 'semgrep/c' || (n % 50), ['high', 'medium', 'low', 'medium'][n % 4 + 1], CASE WHEN n % 2 = 0 THEN 'high' ELSE 'medium' END, 'security', f, n, 'told ' || n, '', NULL FROM g WHERE tool = 'semgrep'
UNION ALL SELECT n, tool, 'deps/V' || n, ['medium', 'critical', 'low', 'high'][n % 4 + 1], 'high', 'dependencies', f, 0, 'p' || (n % 10) || ' 1.' || (n % 3) || ': V' || n, 'Upgrade to a fixed version.', NULL FROM g WHERE tool = 'osv-scanner'
UNION ALL SELECT n, tool, 'deps/W' || n, 'high', 'high', 'dependencies', f, 0, 'p' || (n % 10) || ' 1.' || (n % 3) || ': short', 'Upgrade to a fixed version.', NULL FROM g WHERE tool = 'osv-scanner'
UNION ALL SELECT n, tool, 'deps/V' || n, 'high', 'high', 'dependencies', f, 0, 'p' || (n % 10) || ' 2: V' || n, 'Upgrade to: ' || CASE WHEN n % 2 = 0 THEN '3, 4' ELSE 'none published' END, NULL FROM g WHERE tool = 'pip-audit'
UNION ALL SELECT n, tool, tool || '/could-not-scan', 'medium', 'high', 'security', f, 0, tool || ' could not scan this file: ' || CASE WHEN tool = 'ruff' THEN 'told ' || n ELSE why END, 'Fix what stops it parsing; until then no rule of this tool sees the file.', NULL FROM lost
UNION ALL SELECT n, tool, tool || '/unreadable-report', 'medium', 'high', 'security', f, 0, tool || ' left no report that can be read: ' || error, '', error FROM e WHERE error IS NOT NULL""",
}
