"""Queries on findings made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import magnitudes, score_table
from ..operators import findings as O
from ..operators.pages import page_lines
from ..sources.corpus import CUTOFF, EVENT_FINDINGS_SQL, event_findings, table

_SCORES = ", ".join(f"('{s}', '{c}', '{e}', {v}, '{p}')" for s, c, e, v, p in score_table())
#: Findings with score, priority and fingerprint, for the SQL of all queries here.
_SQL = f"""WITH {EVENT_FINDINGS_SQL},
scores(severity, confidence, exposure, score, priority) AS (VALUES {_SCORES}),
f AS (
  SELECT raw.*, score::DOUBLE AS score, priority, left(sha256(tool || '|' || rule || '|' || file || '|' || regexp_replace(message, '[0-9]+', '#', 'g')), 20) AS fp
  FROM raw JOIN scores USING (severity, confidence, exposure)
)"""
_ORDER = "priority, score DESC, category, rule, file, line, event_id"


def _findings(spark, sf):
    return O.with_fingerprint(O.with_score(event_findings(spark, sf)))


def finding_score_priority(spark, sf):
    return O.with_score(event_findings(spark, sf)).groupBy("severity", "confidence", "exposure", "score", "priority").agg(F.count("*").alias("n"))


def finding_fingerprint(spark, sf):
    found = _findings(spark, sf).select("event_id", "fp", "rule", "file", F.posexplode_outer(magnitudes(F.col("message"))).alias("i", "number"))
    # distinct numbers are combined before the shuffle, so a popular fingerprint costs no more
    return found.groupBy("fp", "rule", "file").agg(F.count_if(F.expr("i IS NULL OR i = 0")).alias("n"), F.array_join(F.array_sort(F.collect_set("number")), ",").alias("numbers"))


def finding_occurrence(spark, sf):
    return O.with_occurrence(_findings(spark, sf), "event_id").select("event_id", "fp", F.col("occurrence").cast("long").alias("occurrence"))


def _marked(spark, sf):
    numbered = _findings(spark, sf)
    old = O.with_occurrence(numbered.where(F.col("ts") < CUTOFF), "event_id")
    new = O.with_occurrence(numbered.where(F.col("ts") >= CUTOFF), "event_id")
    counts, numbers = O.baseline(old)
    return O.mark_new(new, counts, numbers)


_MARKED_SQL = f"""{_SQL},
old AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY {_ORDER}) - 1 AS occurrence FROM f WHERE ts < TIMESTAMP '{CUTOFF}'),
new AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY {_ORDER}) - 1 AS occurrence FROM f WHERE ts >= TIMESTAMP '{CUTOFF}'),
counts AS (SELECT fp, count(*) AS known FROM old GROUP BY fp),
marked AS (
  SELECT new.*, new.occurrence >= coalesce(known, 0) OR (new.counts_matter AND coalesce(regexp_extract(new.message, '[0-9]+')::INT > regexp_extract(o.message, '[0-9]+')::INT, false)) AS is_new
  FROM new LEFT JOIN counts USING (fp) LEFT JOIN old o ON o.fp = new.fp AND o.occurrence = new.occurrence AND o.counts_matter
)"""


def finding_mark_new(spark, sf):
    return _marked(spark, sf).select("event_id", F.col("occurrence").cast("long").alias("occurrence"), "is_new")


def report_summary_matrix(spark, sf):
    return O.summary_matrix(O.with_score(event_findings(spark, sf)))


def report_top_per_rule(spark, sf):
    return O.top_per_rule(O.with_score(event_findings(spark, sf)), 15, "event_id").select("rule", F.col("place").cast("long").alias("place"), "event_id", "score", "priority")


#: Findings of the report page in all, and of one rule.
PAGE, PAGE_RULE = 300, 8


def report_page(spark, sf):
    """Lines of a page of findings; rules go by user too, so there are many of them, and messages hold markup."""
    f = O.with_score(event_findings(spark, sf)).withColumns({"rule": F.expr("concat(rule, '<', file)"), "message": F.concat("message", F.lit(' & "'), "exposure", F.lit('"'))})
    return page_lines(f, "event_id", PAGE, PAGE_RULE).select("priority", "rule", "part", "place", "line")


def report_gate(spark, sf):
    return O.blocking(_marked(spark, sf), "P1").groupBy("rule", "priority").agg(F.count("*").alias("n"))


def required_tools(spark, sf):
    runs = event_findings(spark, sf).groupBy(F.col("rule").alias("tool")).agg(F.when(F.count("*") % 2 == 0, "not configured").alias("skipped"), F.lit(None).cast("string").alias("error"))
    required = table(spark, sf, "events").select(F.col("event_type").alias("tool")).distinct().unionByName(spark.sql("SELECT 'audit' AS tool"))
    return O.unmet_tools(required, runs)


def ratchet_diff(spark, sf):
    counts = event_findings(spark, sf).withColumnRenamed("file", "path")
    old = counts.where(F.col("ts") < CUTOFF).groupBy("path").agg(F.count("*").alias("n"))
    return O.ratchet(old, counts.where(F.col("ts") >= CUTOFF).groupBy("path").agg(F.count("*").alias("n")))


def suppress_antijoin(spark, sf):
    f = _findings(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("user/"), (F.col("doc_id") % 150).cast("string")).alias("file")).distinct()
    return O.suppress(f, f.join(toxic, "file", "left_semi").select("fp").distinct()).groupBy("rule", "file").agg(F.count("*").alias("n"))


def issue_relevance(spark, sf):
    e = table(spark, sf, "events")
    issues = e.groupBy(F.floor(F.col("event_id") / 3).alias("issue")).agg(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))).alias("m"))
    issues = issues.select("issue", F.expr("transform(m, x -> x.user_id)").alias("all")).withColumn("node_ids", F.expr("slice(all, 1, cast(issue % 4 AS int))")).drop("all")
    selected = e.where("user_id % 7 = 0").select(F.col("user_id").alias("id")).distinct()
    return O.relevant_issues(issues, selected).select(F.col("issue").cast("long").alias("issue"), F.size("node_ids").cast("long").alias("nodes"))


def incomplete_reasons(spark, sf):
    issues = table(spark, sf, "events").select(F.upper("event_type").alias("code"), F.format_string("%08d", "event_id").alias("evidence"))
    return O.incomplete_reasons(issues, ["ERROR", "SIGNUP", "FILE_SCAN_FAILED"])


def doctor_summary(spark, sf):
    f = event_findings(spark, sf)
    return f.groupBy("severity", F.col("rule").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def rls_last_state(spark, sf):
    """Last action of each family per user decides; the site is that of the last action that switches on."""
    e = table(spark, sf, "events")
    at = F.struct("ts", "event_id")
    last = lambda on, off: F.max_by(F.col("event_type") == on, F.when(F.col("event_type").isin(on, off), at))
    return e.groupBy("user_id").agg(
        F.coalesce(last("signup", "error"), F.lit(False)).alias("enabled"), F.coalesce(last("purchase", "view"), F.lit(False)).alias("forced"), F.max(F.when(F.col("event_type") == "signup", at))["event_id"].alias("site")
    )


def churn(spark, sf):
    return table(spark, sf, "events").groupBy(F.concat(F.lit("user/"), "user_id").alias("path")).agg(F.countDistinct(F.to_date("ts")).alias("commits"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("latest"))


QUERIES = {
    f.__name__: f
    for f in (
        finding_score_priority, finding_fingerprint, finding_occurrence, finding_mark_new, report_summary_matrix, report_top_per_rule, report_page, report_gate, required_tools, ratchet_diff, suppress_antijoin,
        issue_relevance, incomplete_reasons, doctor_summary, rls_last_state, churn,
    )
}

ORACLES = {
    "finding_score_priority": f"{_SQL} SELECT severity, confidence, exposure, score, priority, count(*) AS n FROM f GROUP BY ALL",
    "finding_fingerprint": f"{_SQL}, n AS (SELECT fp, rule, file, count(*) AS n, list_sort(list_distinct(list(regexp_extract(message, '[0-9]+')::INT))) AS l FROM f GROUP BY ALL) SELECT fp, rule, file, n, array_to_string(l, ',') AS numbers FROM n",
    "finding_occurrence": f"{_SQL} SELECT event_id, fp, row_number() OVER (PARTITION BY fp ORDER BY {_ORDER}) - 1 AS occurrence FROM f",
    "finding_mark_new": f"{_MARKED_SQL} SELECT event_id, occurrence, is_new FROM marked",
    "report_summary_matrix": f"{_SQL} SELECT category, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE priority = '{p}') AS {p.lower()}" for p in ("P0", "P1", "P2", "P3"))
    + " FROM f GROUP BY category",
    "report_top_per_rule": f"{_SQL} SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY priority, score DESC, category, file, line, event_id) AS place, event_id, score, priority FROM f QUALIFY place <= 15",
    "report_page": f"""{_SQL}, m AS (SELECT *, rule || '<' || file AS r2, message || ' & "' || exposure || '"' AS m2 FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY priority, r2 ORDER BY score DESC, category, file, line, event_id) AS place, count(*) OVER (PARTITION BY priority, r2) AS all_, max(score) OVER (PARTITION BY priority, r2) AS worst FROM m),
g AS (SELECT priority, r2, worst, all_, least(all_, {PAGE_RULE}) AS n, category, severity, confidence FROM p WHERE place = 1),
b AS (SELECT *, least(n, greatest(0, {PAGE} - coalesce(sum(n) OVER (ORDER BY priority, worst DESC, r2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS shown FROM g),
h AS (SELECT *, replace(r2, '<', '&lt;') AS r3 FROM b WHERE shown > 0)
SELECT priority, r2 AS rule, 0 AS part, 0 AS place, '<details><summary>' || priority || ' · ' || r3 || ' · ' || category || ' · ' || severity || '/' || confidence || ' · ' || all_ || '</summary><table>' AS line FROM h
UNION ALL SELECT priority, r2, 2, 0, '</table>' || CASE WHEN all_ > shown THEN '<p>' || (all_ - shown) || ' more</p>' ELSE '' END || '</details>' FROM h
UNION ALL SELECT p.priority, p.r2, 1, place, '<tr><td>' || file || ':' || line || '</td><td>' || replace(replace(m2, '&', '&amp;'), '"', '&quot;') || '</td><td>' || exposure || '</td></tr>' FROM p JOIN h USING (priority, r2) WHERE place <= shown
UNION ALL SELECT '~', '', 3, 0, '<p>' || count(*) || ' rules not shown, ' || sum(all_)::BIGINT || ' findings</p>' FROM b WHERE shown = 0 HAVING count(*) > 0""",
    "report_gate": f"{_MARKED_SQL} SELECT rule, priority, count(*) AS n FROM marked WHERE is_new AND confidence != 'low' AND priority <= 'P1' GROUP BY ALL",
    "required_tools": "WITH runs AS (SELECT event_type AS tool, count(*) % 2 = 0 AS skipped FROM events GROUP BY ALL) SELECT tool FROM (SELECT DISTINCT event_type AS tool FROM events UNION ALL SELECT 'audit') r WHERE tool NOT IN (SELECT tool FROM runs WHERE NOT skipped)",
    "ratchet_diff": f"""{_SQL}, o AS (SELECT file AS path, count(*) AS was FROM f WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY ALL), n AS (SELECT file AS path, count(*) AS now FROM f WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY ALL)
SELECT path, coalesce(was, 0) AS was, coalesce(now, 0) AS now, CASE WHEN was IS NULL THEN 'NEW FILE' WHEN coalesce(now, 0) > was THEN 'INCREASED' WHEN coalesce(now, 0) < was THEN 'improved' ELSE 'same' END AS change FROM o FULL JOIN n USING (path)""",
    "suppress_antijoin": f"{_SQL}, gone AS (SELECT DISTINCT fp FROM f WHERE file IN (SELECT 'user/' || doc_id % 150 FROM labels WHERE toxic = 1)) SELECT rule, file, count(*) AS n FROM f WHERE fp NOT IN (SELECT fp FROM gone) GROUP BY ALL",
    "issue_relevance": """WITH i AS (SELECT event_id // 3 AS issue, list(user_id ORDER BY event_id) AS l FROM events GROUP BY 1), c AS (SELECT issue, l[1:issue % 4] AS node_ids FROM i)
SELECT issue, len(node_ids) AS nodes FROM c WHERE len(node_ids) > 0 AND CASE WHEN len(node_ids) <= 2 THEN len(list_filter(node_ids, lambda x: x % 7 = 0)) > 0 ELSE node_ids[1] % 7 = 0 END""",
    "incomplete_reasons": """WITH e AS (SELECT upper(event_type) AS code, printf('%08d', event_id) AS evidence FROM events WHERE event_type IN ('error', 'signup'))
SELECT code, count(*) AS n, array_to_string(list(evidence ORDER BY evidence)[1:3], ', ') AS examples FROM e GROUP BY code""",
    "doctor_summary": f"{_SQL} SELECT severity, rule AS code, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY ALL",
    "rls_last_state": """SELECT user_id, coalesce(arg_max(event_type = 'signup', (ts, event_id)) FILTER (WHERE event_type IN ('signup', 'error')), false) AS enabled,
coalesce(arg_max(event_type = 'purchase', (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'view')), false) AS forced, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS site FROM events GROUP BY user_id""",
    "churn": "SELECT 'user/' || user_id AS path, count(DISTINCT ts::DATE) AS commits, strftime(max(ts), '%Y-%m-%d') AS latest FROM events GROUP BY user_id",
}
